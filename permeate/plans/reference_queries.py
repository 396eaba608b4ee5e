"""Queries of the sequence, structure, text and retrieval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeate.functions import sequence as seq
from permeate.functions import text_clean as tc
from permeate.functions import vectors as v
from permeate.models import backends
from permeate.operators import batch, helix, hierarchy, retrieval, spatial, statistics
from permeate.session import spread, table
from permeate.sources import json_flatten, rest, xml

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- retrieval

PROMPT = "Which buffer was used?"
DIMENSION = 64
_VALID = f"embedding is not null and len(embedding) = {DIMENSION}"
_QUERY_SQL = f"q as (select embedding::double[] as qe from vector_database where {_VALID} and list_aggregate(embedding, 'sum') <> 0 order by vec_id limit 1)"
_SIM_SQL = f"""sims as (select vec_id, doi, chunk_index,
  case when sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) * sqrt(list_sum(list_transform(qe, lambda x: x * x))) = 0 then 0.0
       else list_sum(list_transform(list_zip(embedding::double[], qe), lambda p: p[1] * p[2])) /
            (sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) * sqrt(list_sum(list_transform(qe, lambda x: x * x)))) end as similarity
  from vector_database, q where {_VALID})"""


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The first valid vector: one row, the scalar that a search is made with."""
    rows = table(spark, d, "vector_database").where((F.size("embedding") == DIMENSION) & (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) != 0))
    return [float(x) for x in rows.orderBy("vec_id").select("embedding").first()[0]]


@query(f"with {_QUERY_SQL}, {_SIM_SQL} select vec_id, doi, chunk_index, round(similarity, 6) as similarity from sims where similarity >= 0.1 order by sims.similarity desc, vec_id limit 100")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.similar_chunks(table(spark, d, "vector_database"), query_vector(spark, d), 0.1, 100)
    return hits.select("vec_id", "doi", "chunk_index", F.round("similarity", 6).alias("similarity"))


@query(f"with {_QUERY_SQL}, {_SIM_SQL} select vec_id, round(similarity, 6) as similarity from sims where similarity >= 0.3")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.similar_chunks(table(spark, d, "vector_database"), query_vector(spark, d), 0.3).select("vec_id", F.round("similarity", 6).alias("similarity"))


_LATEST_SQL = "latest as (select * from (select doi, chunk_index, chunk_text, text_id, row_number() over (partition by doi, chunk_index order by text_id desc) as rn from text_database) where rn = 1)"


def _budget_sql(source: str, grp: str, order: str, text: str, budget: int) -> str:
    return f"""b0 as (select *, length({text}) as n, row_number() over (partition by {grp} order by {order}) as rk,
  coalesce(sum(length({text}) + 2) over (partition by {grp} order by {order} rows between unbounded preceding and 1 preceding), 0) as prev from {source} where {text} is not null),
b1 as (select *, prev + n > {budget} as over_ from b0),
b2 as (select *, coalesce(max(over_::int) over (partition by {grp} order by rk rows between unbounded preceding and 1 preceding), 0) as stopped from b1),
b3 as (select {grp}, rk, case when not over_ then {text} when {budget} - prev > 100 then regexp_replace({text}[1:({budget} - prev)::bigint], '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') end as piece, over_ from b2 where stopped = 0),
b4 as (select {grp}, regexp_replace(string_agg(piece, chr(10) || chr(10) order by rk), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') as combined from b3 where piece is not null and (not over_ or piece <> '') group by {grp})"""


@query(
    f"""with {_QUERY_SQL}, {_SIM_SQL}, {_LATEST_SQL},
joined as (select h.vec_id, h.doi, h.similarity, l.chunk_text from sims h join latest l on h.doi = l.doi and h.chunk_index = l.chunk_index where h.similarity >= 0.0),
{_budget_sql("joined", "doi", "similarity desc, vec_id", "chunk_text", 12000)}
select doi, '{PROMPT}' || chr(10) || chr(10) || '**Context:**' || chr(10) || combined || chr(10) || chr(10) || '**Answer:' as combined_prompt from b4 where combined <> ''"""
)
def rag_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every hit of the search without a row cap, join, ordered concatenation under the reference's budget, template."""
    return retrieval.build_prompts(table(spark, d, "vector_database"), table(spark, d, "text_database"), query_vector(spark, d), PROMPT, 0.0, None, 12_000)


@query(f"with {_LATEST_SQL} select doi, chunk_index, chunk_text, text_id from latest")
def chunk_lookup_lastwins(spark: SparkSession, d: str) -> DataFrame:
    return batch.last_wins(table(spark, d, "text_database").select("doi", "chunk_index", "chunk_text", "text_id"), ["doi", "chunk_index"], "text_id")


@query(f"with {_budget_sql('(select * from text_database where doi is not null)', 'doi', 'chunk_index nulls first, text_id', 'chunk_text', 12000)} select doi, combined from b4 where combined <> ''")
def budget_concat(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.budget_concat(table(spark, d, "text_database").where("doi is not null"), "doi", ["chunk_index", "text_id"], "chunk_text", 12000)


@query(
    f"""select vec_id, list_transform(embedding::double[], lambda x: round(x / case when n = 0 then 1 else n end, 6)) as unit
from (select vec_id, embedding, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from vector_database where {_VALID})"""
)
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vector_database").where(F.size("embedding") == DIMENSION)
    return rows.select("vec_id", F.transform(v.normalised(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


@query("select count(prompt) as n_prompts, avg(length(prompt)) as mean_chars, min(length(prompt)) as min_chars, max(length(prompt)) as max_chars from llm_responses")
def prompt_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.prompt_stats(table(spark, d, "llm_responses"), "prompt")


# ---------------------------------------------------------------- text

_RS = "regexp_replace({}, '[\\s\\x{{00A0}}]+$', '')"


@query("select doc_id, case when text <> '' then regexp_replace(regexp_replace(regexp_replace(text, '\\s\\{ECO:[^\\n]+?\\}\\.', '', 'g'), '\\(PubMed:[^\\n]+?\\)', '', 'g'), '[\\s\\x{00A0}]+$', '') end as cleaned from documents where text like 'FUNCTION%'")
def clean_function(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").startswith("FUNCTION")).select("doc_id", tc.function_text(F.col("text")).alias("cleaned"))


@query(
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(text[23:], ' Note=', 1), '\s\{[^\n]+\}', '', 'g'),
'; Multi-pass membrane protein\.\s*', '. ', 'g'), '; Single-pass membrane protein[.;]\s*', '. ', 'g'), '; Single-pass type II membrane protein[.;]\s*', '. ', 'g'), '; Single-pass type I membrane protein[.;]\s*', '. ', 'g'),
'\[[^\n]+\]:\s', '', 'g'), '[\s\x{00A0}]+$', '') as cleaned from documents where text like 'SUBCELLULAR LOCATION%'"""
)
def clean_subcellular(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").startswith("SUBCELLULAR LOCATION")).select("doc_id", tc.subcellular_location(F.col("text")).alias("cleaned"))


@query(
    r"""select doc_id, r[1:length(r) - 1] as cleaned from (select doc_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '/e[^\n]+?\d";?\s?', '', 'g'), 'DO[^\n]+?;\s', '', 'g'), '"', ''), '/n[^\n]+?=', '', 'g'), '[\s\x{00A0}]+$', '') as r
from documents where text like 'DOMAIN%')"""
)
def clean_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").startswith("DOMAIN")).select("doc_id", tc.domain_text(F.col("text")).alias("cleaned"))


@query(
    r"""select doc_id, regexp_replace(regexp_replace(upper(t[1:1]) || t[2:], '\s\{ECO:[^\n]+?\}\.', '', 'g'), '[\s\x{00A0}]+$', '') as cleaned
from (select doc_id, regexp_replace(text, 'SIM[^\n]+the\s', '', 'g') as t from documents where text like 'SIMILARITY%')"""
)
def clean_similarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").startswith("SIMILARITY")).select("doc_id", tc.similarity_text(F.col("text")).alias("cleaned"))


@query(
    """with s as (select row_id, emdb_id, structure_determination_list[1].specimen_preparation_list.specimen_preparation[1] as s, admin from emdb_entries),
b as (select row_id, emdb_id, s.buffer as b, s.details as details, admin.keywords as keywords, admin.title as title from s),
p as (select *, list_transform(list_filter(b.component, lambda c: c is not null), lambda c:
  case when c.name is null or contains(lower(c.name), 'detergent') then c.formula else c.name end || ': ' ||
  case when c.concentration is null then '' else coalesce(c.concentration.valueOf_, '') || ' ' || coalesce(c.concentration.units, '') end) as parts, 'pH ' || coalesce(b.ph, 'None') as ph from b),
t as (select *, case when b is null then null when b.component is null then ph when len(list_filter(parts, lambda x: x is null)) > 0 then null else array_to_string(list_append(parts, ph), ' + ') end as txt from p),
e as (select *, case when title is null then 'no title' when b is null then 'no buffer' when txt is null then 'no formula' end as error from t)
select row_id, emdb_id, case when error is null then txt end as components, case when error is null then details end as details,
       case when error is null then keywords end as keywords, case when error is null then title end as title, error from e"""
)
def buffer_to_text(spark: SparkSession, d: str) -> DataFrame:
    return rest.first_specimen(table(spark, d, "emdb_entries"))


@query("""select doc_id, regexp_replace(regexp_replace(title, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'), '[/\\\\ ]', '_', 'g') as stem from documents""")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    """Titles as names that are safe for files."""
    return table(spark, d, "documents").select("doc_id", tc.file_stem(F.col("title")).alias("stem"))


_ROOT = "http://localhost/"


@query(
    f"""select structure_id, '{_ROOT}data/memprotmd/simulations/' || lower(rcsb_id) || '_default_dppc/files/contacts/by_resid_postprocess.csv' as contacts,
'{_ROOT}uniprotkb/accessions?accessions=' || array_to_string(list_filter([rcsb_id, structure_id::varchar], lambda x: x is not null), ',') || '&fields=accession,ft_transmem&format=tsv' as accessions from structures"""
)
def url_build(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of per-structure tables and of batches of accessions."""
    codes = F.array("rcsb_id", F.col("structure_id").cast("string"))
    return table(spark, d, "structures").select("structure_id", tc.simulation_url(_ROOT, F.col("rcsb_id")).alias("contacts"), tc.accessions_url(_ROOT.rstrip("/"), codes, ("accession", "ft_transmem")).alias("accessions"))


_STRIPPED = r"nullif(upper(regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')), '')"


@query(
    f"""select structure_id, id, case when contains(id, '_') then 'polymer_entities' when contains(id, '.') then 'polymer_entity_instances' when contains(id, '-') then 'assemblies' when length(id) = 4 then 'entries' end as kind
from (select structure_id, c || case structure_id % 4 when 0 then '' when 1 then '_1' when 2 then '.A' else '-1' end as id from (select structure_id, {_STRIPPED.format("rcsb_id")} as c from structures))"""
)
def id_classify(spark: SparkSession, d: str) -> DataFrame:
    """The codes of all rows, in four forms of ids; a null or blank code is no id and has no kind."""
    flat = F.upper(F.regexp_replace("rcsb_id", r"(?U)^\s+|\s+$", ""))
    form = F.get(F.array(F.lit(""), F.lit("_1"), F.lit(".A"), F.lit("-1")), (F.col("structure_id") % 4).cast("int"))
    code = F.when(flat != "", F.concat(flat, form))
    return table(spark, d, "structures").select("structure_id", code.alias("id"), F.when(code.isNotNull(), batch.id_kind(code)).alias("kind"))


# ---------------------------------------------------------------- nested records

ENTRY = "struct<rcsb_id: string, rcsb_primary_citation: struct<pdbx_database_id_DOI: string>, exptl: array<struct<method: string, method_details: string, details: string>>, struct: struct<title: string>>"
SPEC = {"rcsb_id": [], "exptl": ["method", "details"], "struct": ["title"], "rcsb_primary_citation": ["pdbx_database_id_DOI"]}


@query(
    """with ok as (select response_id, body::json as j from pdb_responses where json_valid(body)),
e as (select response_id, unnest(range(json_array_length(j, '$.data.entries')::bigint)) as entry, j from ok where json_type(j, '$.data.entries') = 'ARRAY'),
x as (select response_id, entry, j -> ('$.data.entries[' || entry || ']') as e from e),
n as (select *, case when json_type(e, '$.exptl') = 'ARRAY' then json_array_length(e, '$.exptl') else 0 end as k from x where json_type(e) = 'OBJECT'),
y as (select *, unnest(case when k = 0 then [-1] else range(k::bigint) end) as i from n)
select response_id, entry, e ->> '$.rcsb_id' as rcsb_id, e ->> ('$.exptl[' || i || '].method') as "exptl.method", e ->> ('$.exptl[' || i || '].details') as "exptl.details",
       e ->> '$.struct.title' as "struct.title", e ->> '$.rcsb_primary_citation.pdbx_database_id_DOI' as "rcsb_primary_citation.pdbx_database_id_DOI"
from (select response_id, entry, e, case when i = -1 then 999999 else i end as i from y)"""
)
def json_flatten_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = json_flatten.entries_of(table(spark, d, "pdb_responses"), "body", ENTRY, ("response_id",))
    return json_flatten.flatten(entries, SPEC, ("response_id", "entry"))


_TEXT_AT = "case when json_type(e, '$.{0}') = 'OBJECT' then e ->> '$.{0}.{1}' end"


@query(
    f"""with ok as (select response_id, body::json as j from pdb_responses where json_valid(body)),
e as (select response_id, unnest(range(json_array_length(j, '$.data.entries')::bigint)) as entry, j from ok where json_type(j, '$.data.entries') = 'ARRAY'),
x as (select response_id, entry, j -> ('$.data.entries[' || entry || ']') as e from e),
n as (select *, case when json_type(e, '$.exptl') = 'ARRAY' then json_array_length(e, '$.exptl') else 0 end as k from x where json_type(e) = 'OBJECT'),
y as (select *, unnest(case when k = 0 then [999999] else range(k::bigint) end) as i from n)
select response_id, entry, e ->> '$.rcsb_id' as rcsb_id, {_TEXT_AT.format("rcsb_primary_citation", "pdbx_database_id_DOI")} as "rcsb_primary_citation.pdbx_database_id_DOI",
       e ->> ('$.exptl[' || i || '].method') as "exptl.method", e ->> ('$.exptl[' || i || '].method_details') as "exptl.method_details", e ->> ('$.exptl[' || i || '].details') as "exptl.details",
       {_TEXT_AT.format("rcsb_entry_info", "experimental_method")} as "rcsb_entry_info.experimental_method", {_TEXT_AT.format("struct", "title")} as "struct.title", {_TEXT_AT.format("struct_keywords", "text")} as "struct_keywords.text" from y"""
)
def json_flatten_default(spark: SparkSession, d: str) -> DataFrame:
    """The default fields with the schema inferred over all bodies; fields of varying shape are their JSON text."""
    entries = json_flatten.entries_of(table(spark, d, "pdb_responses"), "body", None, ("response_id",))
    return json_flatten.flatten(entries, None, ("response_id", "entry"))


@query("select event_id, (props::json ->> '$.k')::bigint as k from events")
def json_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("select row_id, structure_determination_list[1].specimen_preparation_list.specimen_preparation[1].buffer.ph as ph from emdb_entries")
def list_first_element(spark: SparkSession, d: str) -> DataFrame:
    """pH of the first specimen of the first determination: two list fields without subfields, element 0 of each."""
    first = json_flatten.flatten(table(spark, d, "emdb_entries"), {"structure_determination_list": []}, ("row_id",))
    specimens = first.select("row_id", F.col("structure_determination_list.specimen_preparation_list.specimen_preparation").alias("specimens"))
    return json_flatten.flatten(specimens, {"specimens": []}, ("row_id",)).select("row_id", F.col("specimens.buffer.ph").alias("ph"))


@query("select event_id, [(props::json ->> '$.k'), event_id::varchar] as first from events")
def map_first_values(spark: SparkSession, d: str) -> DataFrame:
    """First value of every map of a list."""
    maps = F.array(F.from_json("props", "map<string,string>"), F.create_map(F.lit("id"), F.col("event_id").cast("string")))
    return table(spark, d, "events").select("event_id", tc.first_values(maps).alias("first"))


@query(
    """select o_orderkey, l_linenumber, l_quantity from orders left join lineitem on l_orderkey = o_orderkey"""
)
def explode_outer_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of each order as a list and back; orders without items keep one row of nulls."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("items"))
    orders = table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    flat = json_flatten.flatten(orders, {"o_orderkey": [], "items": ["l_linenumber", "l_quantity"]})
    return flat.toDF("o_orderkey", "l_linenumber", "l_quantity")


# ---------------------------------------------------------------- XML


def _tag(name: str, value) -> F.Column:
    safe = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"<{name}>"), safe, F.lit(f"</{name}>")))


_XML = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
_XML_ROW = {c: _XML.format(c) for c in ("group_name", "subgroup", "main_struc", "main_name", "main_res", "main_species", "main_taxdom", "member_struc", "member_name")}


@query(
    f"""select row_id, {", ".join(f"{x} as {c}" for c, x in _XML_ROW.items())},
case when has then {_XML_ROW["main_species"]} end as member_species, case when has then {_XML_ROW["main_taxdom"]} end as member_taxdom, case when has then {_XML_ROW["main_res"]} end as member_res
from (select *, member_struc is not null or member_name is not null as has from mpstruc)"""
)
def xml_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each row written as an XML group and read back through the nested reader, which drops outer white space; a blank
    element is null."""
    return _groups(table(spark, d, "mpstruc"))


def _groups(rows: DataFrame) -> DataFrame:
    member = F.concat(F.lit("<memberProteins><memberProtein>"), _tag("pdbCode", F.col("member_struc")), _tag("name", F.col("member_name")), F.lit("</memberProtein></memberProteins>"))
    protein = F.concat(
        F.lit("<protein>"),
        _tag("pdbCode", F.col("main_struc")),
        _tag("name", F.col("main_name")),
        _tag("resolution", F.col("main_res")),
        _tag("species", F.col("main_species")),
        _tag("taxonomicDomain", F.col("main_taxdom")),
        F.when(F.col("member_struc").isNull() & F.col("member_name").isNull(), "").otherwise(member),
        F.lit("</protein>"),
    )
    text = F.concat(F.lit("<group>"), _tag("name", F.col("group_name")), F.lit("<subgroups><subgroup>"), _tag("name", F.col("subgroup")), F.lit("<proteins>"), protein, F.lit("</proteins></subgroup></subgroups></group>"))
    parsed = rows.select("row_id", xml.xml_column(text, xml.GROUP).alias("g")).select("row_id", "g.*")
    out = xml.group_rows(parsed, keep=("row_id",))
    return out.select("row_id", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in out.columns if c != "row_id"])


@query(
    r"""select upper(regexp_replace(rcsb_id, '[\t\n\r]', ' ', 'g')) as "pdbCode", structure_id::varchar as topdb_id, case when regexp_matches(method, '[^ \t\n\r]') then method end as membrane
from structures where rcsb_id is not null"""
)
def xml_topology(spark: SparkSession, d: str) -> DataFrame:
    """Each row written as a topology entry and read back: a null code is no structure, its entry has no row; a null or blank
    method gives no membrane."""
    return _topology(table(spark, d, "structures"))


def _regions(rows: DataFrame) -> DataFrame:
    """Each helix row written as an XML chain: the segment before with the type of the side, the region, the segment behind."""
    part = lambda c: F.coalesce(c, F.lit(""))
    n, m, k = F.char_length(part("n_flank")), F.char_length(part("region_seq")), F.char_length(part("c_flank"))

    def region(kind, begin, end) -> F.Column:
        return F.concat(F.lit('<REGION seq_beg="'), begin.cast("string"), F.lit('" pdb_beg="'), begin.cast("string"), F.lit('" seq_end="'), end.cast("string"), F.lit('" pdb_end="'), end.cast("string"), F.lit('" type="'), kind, F.lit('"/>'))

    text = F.concat(
        F.lit('<x:pdbtm xmlns:x="urn:pdbtm" ID="'),
        F.col("row_id").cast("string"),
        F.lit('"><x:CHAIN CHAINID="'),
        part("chain_id"),
        F.lit('" NUM_TM="'),
        part(F.col("num_tm").cast("string")),
        F.lit('" TYPE="'),
        part("chain_type"),
        F.lit('"><SEQ>'),
        part("n_flank"),
        F.lit("\n "),
        part("region_seq"),
        part("c_flank"),
        F.lit("</SEQ>"),
        F.when(n > 0, region(part("prev_type"), F.lit(1), n)).otherwise(F.lit("")),
        region(part("region_type"), n + 1, n + m),
        F.when(k > 0, region(F.lit("1"), n + m + 1, n + m + k)).otherwise(F.lit("")),
        F.lit("</x:CHAIN></x:pdbtm>"),
    )
    return rows.select(xml.xml_column(text, xml.CHAINS).alias("c")).select("c.*")


_CHAIN_SQL = """c as (select row_id::varchar as "pdbCode", nullif(trim(chain_id), '') as chain_id, num_tm, nullif(trim(chain_type), '') as chain_type, coalesce(n_flank, '') as n, coalesce(region_seq, '') as r, coalesce(c_flank, '') as k,
  region_type, case when coalesce(n_flank, '') <> '' then prev_type else '0' end as prev_type from pdbtm)"""


@query(f"""with {_CHAIN_SQL} select "pdbCode", chain_id, num_tm, chain_type, n || r || k as sequence, 1 + (n <> '')::int + (k <> '')::int as n_regions from c""")
def xml_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains read from XML: one row each with its sequence without white space."""
    chains = xml.chain_rows(_regions(table(spark, d, "pdbtm")))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    return chains.select("pdbCode", blank("chain_id"), "num_tm", blank("chain_type"), F.coalesce("sequence", F.lit("")).alias("sequence"), F.size("regions").alias("n_regions"))


@query(
    f"""with {_CHAIN_SQL} select "pdbCode", region_type, coalesce(prev_type, '') as prev_type, length(n) + 1 as region_beg, length(n) + length(r) as region_end, n[greatest(length(n) - 4, 1):] as n_flank, r as region_seq, k[:5] as c_flank
from c where region_type = 'H' and n || r || k <> ''"""
)
def xml_helices(spark: SparkSession, d: str) -> DataFrame:
    """Helix rows read from XML: region, type of the region before, flanks of five residues."""
    rows = helix.helix_rows(xml.chain_rows(_regions(table(spark, d, "pdbtm"))), 5)
    return rows.where("region_seq is not null").select("pdbCode", "region_type", "prev_type", "region_beg", "region_end", "n_flank", "region_seq", "c_flank")


def _topology(rows: DataFrame) -> DataFrame:
    text = F.concat(F.lit('<TOPDB xmlns="https://topdb.unitmp.org" ID="'), F.col("structure_id").cast("string"), F.lit('" type="x"><Topology>'), _tag("Membrane", F.col("method")), F.lit('</Topology><CrossRef><PDB ID="'), F.lower("rcsb_id"), F.lit('"/></CrossRef></TOPDB>'))
    return xml.topology_rows(rows.select(xml.topology_from_text(text).alias("t")).select("t.*")).select("topdb_id", "pdbCode", "membrane")


@query(
    """with r as (select l_orderkey, l_linenumber, l_returnflag, coalesce(lag(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag), '0') as prev_type from lineitem)
select l_orderkey, l_linenumber, prev_type from r where l_returnflag = 'N' and prev_type not in ('R', '0')"""
)
def lag_prev_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lag over all rows of a chain, then the filters."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    chains = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("regions"))
    rows = chains.select("l_orderkey", F.explode(helix.lagged_regions(F.col("regions"), "l_returnflag")).alias("x"))
    out = rows.select("l_orderkey", F.col("x.region.l_linenumber").alias("l_linenumber"), F.col("x.region.l_returnflag").alias("flag"), "x.prev_type")
    return out.where((F.col("flag") == "N") & ~F.coalesce(F.col("prev_type").isin("R", "0"), F.lit(False))).select("l_orderkey", "l_linenumber", "prev_type")


_SEQ = "coalesce(n_flank, '') || coalesce(region_seq, '') || coalesce(c_flank, '')"


@query(
    f"""select row_id, case when b > 1 then s[greatest(b - 5, 1):b - 1] else '' end as n5, s[b:e] as region, s[e + 1:e + 5] as c5
from (select row_id, {_SEQ} as s, length(coalesce(n_flank, '')) + 1 as b, length(coalesce(n_flank, '')) + length(coalesce(region_seq, '')) as e from pdbtm) where e >= b"""
)
def tm_flanks(spark: SparkSession, d: str) -> DataFrame:
    """Slice and flanks of each region cut anew from the whole segment."""
    part = lambda c: F.coalesce(c, F.lit(""))
    begin, end = F.char_length(part("n_flank")) + 1, F.char_length(part("n_flank")) + F.char_length(part("region_seq"))
    rows = table(spark, d, "pdbtm").select("row_id", F.concat(part("n_flank"), part("region_seq"), part("c_flank")).alias("s"), begin.alias("b"), end.alias("e")).where("e >= b")
    before, behind = tc.flanks(F.col("s"), F.col("b"), F.col("e"), 5)
    return rows.select("row_id", before.alias("n5"), tc.slice_1based(F.col("s"), F.col("b"), F.col("e")).alias("region"), behind.alias("c5"))


@query(
    """with h as (select row_id, "pdbCode", chain_id, num_tm, try_cast(prev_type as int) as prev_type, region_seq, n_flank || region_seq || c_flank as flanked_region_seq from pdbtm
where region_type = 'H' and (prev_type is null or prev_type not in ('F', 'H', 'U', 'L', 'I', '0')))
select *, case when prev_type = 2 then reverse(region_seq) else region_seq end as region_seq_aligned, case when prev_type = 2 then reverse(flanked_region_seq) else flanked_region_seq end as flanked_region_seq_aligned from h"""
)
def helix_align(spark: SparkSession, d: str) -> DataFrame:
    return helix.helix_view(table(spark, d, "pdbtm").where("region_type = 'H'"), align=True)


@query("select row_id, region_seq[3:7] as part from pdbtm")
def zero_based_slices(spark: SparkSession, d: str) -> DataFrame:
    """Residues 2 to 6, counted from 0, both inclusive."""
    return table(spark, d, "pdbtm").select("row_id", tc.slice_0based(F.col("region_seq"), F.lit(2), F.lit(6)).alias("part"))


# ---------------------------------------------------------------- sequence statistics

_GROUPED = "regexp_replace(translate(upper({0}), 'LV', 'II'), '[^ICAMWFPGRNDEQHKSTY]', '', 'g')"
_ENTROPY = "list_sum(list_transform(list_filter(string_split('ICAMWFPGRNDEQHKSTY', ''), lambda g: contains(t, g)), lambda g: -((length(t) - length(replace(t, g, ''))) / length(t)) * log2((length(t) - length(replace(t, g, ''))) / length(t))))"


@query(f"select row_id, case when length(t) > 0 then round({_ENTROPY}, 6) else -1 end as entropy from (select row_id, {_GROUPED.format('region_seq')} as t from pdbtm where region_seq is not null)")
def seq_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pdbtm").where("region_seq is not null").select("row_id", "region_seq")
    return seq.add_group_entropy(rows, "region_seq", "entropy").select("row_id", F.round("entropy", 6).alias("entropy"))


@query(
    f"""with w as (select row_id, i, {_GROUPED.format('region_seq[i:i + 11]')} as t from (select row_id, region_seq, unnest(range(1, (length(region_seq) - 10)::bigint)) as i from pdbtm where length(region_seq) >= 12))
select row_id, i as start, round({_ENTROPY}, 6) as entropy from w"""
)
def entropy_windows(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of every window of 12 residues."""
    return helix.window_rows(spread(table(spark, d, "pdbtm").select("row_id", "region_seq")), "row_id", "region_seq").select("row_id", "start", F.round("entropy", 6).alias("entropy"))


_SCALES = ", ".join(f"('{k}', {i}, {o}, {x})" for k, (i, o, x) in seq.HYDROPHOBICITY.items())


@query(
    f"""with k(aa, i, o, x) as (values {_SCALES}),
c as (select row_id, pos, coalesce(o::double, 0) as o, coalesce(i::double, 0) as i, coalesce(x::double, 0) as x from
  (select row_id, pos, upper(region_seq[pos]) as aa from (select row_id, region_seq, unnest(range(1, length(region_seq)::bigint + 1)) as pos from pdbtm where length(region_seq) >= 19)) left join k using (aa)),
w as (select row_id, pos - 18 as start, sum(o) over r as o, sum(i) over r as i, sum(x) over r as x from c window r as (partition by row_id order by pos rows 18 preceding))
select row_id, start, round(o, 4) + 0 as octanol, round(i, 4) + 0 as interface, round(x, 4) + 0 as difference from w where start >= 1"""
)
def hydrophobicity_windows(spark: SparkSession, d: str) -> DataFrame:
    """Summed scales of every window of 19 residues."""
    rows = helix.window_rows(spread(table(spark, d, "pdbtm").select("row_id", "region_seq")), "row_id", "region_seq").where("octanol is not null")
    return rows.select("row_id", "start", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("octanol", "interface", "difference")])


@query(
    f"""with k(aa, i, o, x) as (values {_SCALES}), s as (select distinct upper(region_seq) as s from pdbtm where region_seq is not null)
select row_id, round(octanol, 4) + 0 as octanol, round(interface, 4) + 0 as interface, round(difference, 4) + 0 as difference from pdbtm join
(select s, sum((length(s) - length(replace(s, aa, ''))) * o::double) as octanol, sum((length(s) - length(replace(s, aa, ''))) * i::double) as interface, sum((length(s) - length(replace(s, aa, ''))) * x::double) as difference from s, k group by s) t
on upper(region_seq) = t.s"""
)
def seq_hydrophobicity(spark: SparkSession, d: str) -> DataFrame:
    """Summed scales of whole regions."""
    rows = table(spark, d, "pdbtm").where("region_seq is not null").select("row_id", "region_seq")
    return seq.add_hydrophobicity(rows, "region_seq").select("row_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("octanol", "interface", "difference")])


@query("select l_returnflag, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std, median(l_quantity) as median from lineitem group by l_returnflag")
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "median")


@query("with m as (select l_returnflag, median(l_quantity) as m from lineitem group by l_returnflag) select l_returnflag, median(abs(l_quantity - m)) as mad from lineitem join m using (l_returnflag) group by l_returnflag")
def median_deviation(spark: SparkSession, d: str) -> DataFrame:
    return statistics.median_deviation(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query(
    """with z as (select l_orderkey, l_linenumber, l_discount * 30 as e, l_tax * 50 - 3 as h from lineitem),
q as (select *, power(e - 2.4, 2) / power(0.30, 2) + power(h + 0.64, 2) / power(2.85, 2) as z0 from z),
r as (select *, case when 0.436 * 0.30 * (h + 0.64) < -1 * 2.85 * (e - 2.4) then -z0 else z0 end as zz from q)
select l_orderkey, l_linenumber, round(zz, 6) as zscore, case when zz >= -3.29 then 'complex' when zz <= -5.41 then 'simple' else 'twilight' end as class from r"""
)
def zscore_classify(spark: SparkSession, d: str) -> DataFrame:
    z = seq.signed_zscore(F.col("l_discount") * 30, F.col("l_tax") * 50 - 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(z, 6).alias("zscore"), seq.segment_class(z).alias("class"))


@query(
    """with z as (select l_orderkey, l_linenumber, l_discount * 30 - 2.4 as de, l_tax * 50 - 3 + 0.64 as dh from lineitem),
q as (select *, de * de / power(0.30, 2) + dh * dh / power(2.85, 2) - 2 * 0.5 * de * dh / (0.30 * 2.85) as z0 from z)
select l_orderkey, l_linenumber, round(case when 0.436 * 0.30 * dh < -1 * 2.85 * de then -z0 else z0 end, 6) as zscore from q"""
)
def zscore_correlated(spark: SparkSession, d: str) -> DataFrame:
    """Signed z-score with a correlation of 0.5 between its two parts."""
    z = seq.signed_zscore(F.col("l_discount") * 30, F.col("l_tax") * 50 - 3, 0.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(z, 6).alias("zscore"))


@query("select vec_id, case when len(x) > 0 then round(list_avg(x), 6) else -1 end as mean, case when len(x) > 0 then round(list_stddev_pop(x), 5) else -1 end as std from (select vec_id, embedding::double[] as x from vector_database where embedding is not null)")
def list_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of each list; -1 for an empty one."""
    rows = table(spark, d, "vector_database").where("embedding is not null").select("vec_id", seq.mean_std(F.col("embedding").cast("array<double>")).alias("m"))
    return rows.select("vec_id", F.round("m.mean", 6).alias("mean"), F.round("m.std", 5).alias("std"))


_RESIDUES = "map {" + ", ".join(f"'{k}': {x}::double" for k, (_, _, x) in seq.HYDROPHOBICITY.items()) + "}"


@query(
    f"""with recursive s as (select row_id, n_flank || region_seq || c_flank as q, length(n_flank)::bigint as l, (length(n_flank) + length(region_seq) - 1)::bigint as e, 19 - length(region_seq) as k
  from pdbtm where region_seq <> '' and n_flank is not null and c_flank is not null),
g as (select *, 0 as step from s union all
  select row_id, q, case when a is null and b is null or b is null or a <= b then l - 1 else l end, case when a is null and b is null or a is null or a > b or a = b then e + 1 else e end, k, step + 1
  from (select *, case when l >= 1 then coalesce({_RESIDUES}[upper(q[l])], {seq.UNKNOWN_RESIDUE}) end as a, case when e + 1 < length(q) then coalesce({_RESIDUES}[upper(q[e + 2])], {seq.UNKNOWN_RESIDUE}) end as b from g)
  where step < k and e - l + 1 < 19),
h as (select row_id, case when l < 0 then right(q, -l) else substring(q, l + 1, e - l + 1) end as h from (select row_id, arg_max(q, step) as q, arg_max(l, step) as l, arg_max(e, step) as e from g group by row_id)),
d as (select distinct h from h),
w as (select h, avg(case when length(t) > 0 then {_ENTROPY} else -1 end) as e from (select h, {_GROUPED.format('h[i:i + 11]')} as t from (select h, unnest(range(1, (length(h) - 10)::bigint)) as i from d where length(h) >= 12)) group by h),
x as (select h, avg(list_sum(list_transform(string_split(upper(h[i:i + 18]), ''), lambda c: coalesce({_RESIDUES}[c], 0)))) as x from (select h, unnest(range(1, (length(h) - 17)::bigint)) as i from d where length(h) >= 19) group by h),
z as (select d.h, coalesce(w.e, -1) - {seq.ENTROPY_CENTRE} as de, coalesce(x.x, -1) - {seq.HYDRO_CENTRE} as dh from d left join w using (h) left join x using (h)),
c as (select h, (case when {seq.SIGN_SLOPE} * {seq.ENTROPY_SPREAD} * dh < -{seq.HYDRO_SPREAD} * de then -1 else 1 end) * (de * de / pow({seq.ENTROPY_SPREAD}, 2) + dh * dh / pow({seq.HYDRO_SPREAD}, 2)) as z from z)
select row_id, case when z >= {seq.COMPLEX_FROM} then 'complex' when z <= {seq.SIMPLE_TO} then 'simple' else 'twilight' end as class from h join c using (h)"""
)
def tm_classify(spark: SparkSession, d: str) -> DataFrame:
    """Class of each helix from its segment within the flanked sequence."""
    rows = table(spark, d, "pdbtm").where("region_seq <> '' and n_flank is not null and c_flank is not null")
    start = F.char_length("n_flank")
    text = F.concat(start.cast("string"), F.lit(","), (start + F.char_length("region_seq") - 1).cast("string"))
    rows = rows.select("row_id", F.concat("n_flank", "region_seq", "c_flank").alias("sequence"), text.alias("segments"))
    return helix.classified_segments(spread(rows), "sequence", "segments").select("row_id", F.get("segment_classes", F.lit(0)).alias("class"))


# ---------------------------------------------------------------- structures in space


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """The first three numbers of each embedding, times 20, as carbon atoms; the label is the structure."""
    e = table(spark, d, "embeddings")
    xyz = [(F.get("embedding", F.lit(i)).cast("double") * 20).alias(n) for i, n in enumerate("xyz")]
    return e.select(F.col("label").cast("string").alias("structure_id"), F.col("vec_id").alias("atom_id"), F.lit("C").alias("element"), *xyz)


_ATOMS_SQL = "a as (select label::varchar as structure_id, vec_id as atom_id, embedding[1]::double * 20 as x, embedding[2]::double * 20 as y, embedding[3]::double * 20 as z from embeddings)"
_SPHERE_SQL = "p as (select k, cos(k * pi() * (3 - sqrt(5))) * sqrt(1 - pow((1 - 1.0 / {n}) - k * 2.0 / {n}, 2)) as px, sin(k * pi() * (3 - sqrt(5))) * sqrt(1 - pow((1 - 1.0 / {n}) - k * 2.0 / {n}, 2)) as py, (1 - 1.0 / {n}) - k * 2.0 / {n} as pz from range({n}) t(k))"


@query(f"with {_SPHERE_SQL.format(n=100)} select k, round(px, 6) as x, round(py, 6) as y, round(pz, 6) as z from p")
def sphere_points(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, round(x, 6), round(y, 6), round(z, 6)) for k, (x, y, z) in enumerate(spatial.sphere_points(100))]
    return spark.createDataFrame(rows, "k long, x double, y double, z double")


@query(f"with {_ATOMS_SQL} select i.atom_id, j.atom_id as other_id, round(pow(i.x - j.x, 2) + pow(i.y - j.y, 2) + pow(i.z - j.z, 2), 4) as d2 from a i join a j on i.atom_id <> j.atom_id and pow(i.x - j.x, 2) + pow(i.y - j.y, 2) + pow(i.z - j.z, 2) <= 4.0")
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    """All pairs within 2 angstrom, across structures."""
    pairs = spatial.radius_join(atoms(spark, d).withColumn("r", F.lit(1.7)), F.lit(2.0), 2.0)
    return pairs.select("atom_id", "other_id", F.round("d2", 4).alias("d2"))


_SASA_SQL = f"""{_ATOMS_SQL}, {_SPHERE_SQL.format(n=100)},
free as (select a.structure_id, a.atom_id, count(*) filter (where not exists (select 1 from a b where b.structure_id = a.structure_id and b.atom_id <> a.atom_id
  and pow(a.x + 3.1 * px - b.x, 2) + pow(a.y + 3.1 * py - b.y, 2) + pow(a.z + 3.1 * pz - b.z, 2) <= 3.1 * 3.1)) as n_free from a, p group by 1, 2)"""


@query(f"with {_SASA_SQL} select structure_id, atom_id, n_free, round(n_free * 3.1 * 3.1 * 4 * pi() / 100, 4) as sasa from free")
def sasa_atoms(spark: SparkSession, d: str) -> DataFrame:
    return spatial.surface(atoms(spark, d)).select("structure_id", "atom_id", "n_free", F.round("sasa", 4).alias("sasa"))


@query(f"with {_SASA_SQL} select structure_id, round(sum(n_free * 3.1 * 3.1 * 4 * pi() / 100), 4) as sasa from free group by structure_id")
def sasa_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Surface summed per structure."""
    return spatial.surface(atoms(spark, d), level="S").select("structure_id", F.round("sasa", 4).alias("sasa"))


_PARTS_SQL = f"{_SASA_SQL}, parts as (select structure_id, 1 as model_id, atom_id % 2 as chain_id, atom_id % 7 as residue_id, n_free * 3.1 * 3.1 * 4 * pi() / 100 as sasa from free)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return atoms(spark, d).withColumns({"model_id": F.lit(1), "chain_id": F.col("atom_id") % 2, "residue_id": F.col("atom_id") % 7})


@query(f"with {_PARTS_SQL} select structure_id, model_id, chain_id, residue_id, round(sum(sasa), 4) as sasa from parts group by all")
def sasa_residues(spark: SparkSession, d: str) -> DataFrame:
    return spatial.surface(_parts(spark, d), level="R").withColumn("sasa", F.round("sasa", 4))


@query(f"with {_PARTS_SQL} select structure_id, model_id, chain_id, round(sum(sasa), 4) as sasa from parts group by all")
def sasa_chains(spark: SparkSession, d: str) -> DataFrame:
    return spatial.surface(_parts(spark, d), level="C").withColumn("sasa", F.round("sasa", 4))


@query(f"with {_PARTS_SQL} select structure_id, model_id, round(sum(sasa), 4) as sasa from parts group by all")
def sasa_models(spark: SparkSession, d: str) -> DataFrame:
    return spatial.surface(_parts(spark, d), level="M").withColumn("sasa", F.round("sasa", 4))


_RADII_SQL = "map {" + ", ".join(f"'{k}': {v}" for k, v in (spatial.RADII | {"C": 1.75}).items()) + "}"


@query(f"select p_partkey, upper(p_name[1:1]) as element, coalesce({_RADII_SQL}[upper(p_name[1:1])], {spatial.OTHER_RADIUS})::double as radius from part")
def atom_radii(spark: SparkSession, d: str) -> DataFrame:
    """Radius by element (here the first letter of a name), with one overridden and the default for unknown ones."""
    element = F.substring("p_name", 1, 1)
    return table(spark, d, "part").select("p_partkey", F.upper(element).alias("element"), spatial.atom_radius(element, {"c": 1.75}).alias("radius"))


# ---------------------------------------------------------------- hierarchy, batches, lookups


@query(
    """with f as (select *, main_struc is not null and row_id = min(row_id) over (partition by main_struc) as lead_, coalesce(member_struc, '') <> '' as has from mpstruc),
filled as (select row_id, 0 as part, main_struc, main_struc as member_struc, main_name as member_name, main_res as member_res from f where lead_ and has
union all select row_id, 1, main_struc, case when lead_ and not has then main_struc else member_struc end, case when lead_ and not has then main_name else member_name end, case when lead_ and not has then main_res else member_res end from f)
select * from filled"""
)
def hierarchy_fill(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_self_members(table(spark, d, "mpstruc")).select("row_id", "part", "main_struc", "member_struc", "member_name", "member_res")


@query(
    """select r_name, n_name, round(sum(c_acctbal), 2) as balance, grouping(r_name, n_name)::bigint as level from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)"""
)
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return hierarchy.rollup_sums(joined, ["r_name", "n_name"], "c_acctbal").select("r_name", "n_name", F.round("sum_c_acctbal", 2).alias("balance"), F.col("level").cast("long").alias("level"))


@query("select * exclude (rn) from (select row_id, main_struc, main_name, row_number() over (partition by main_struc order by row_id) as rn from mpstruc) where rn = 1")
def first_of_group(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.first_per_key(table(spark, d, "mpstruc").select("row_id", "main_struc", "main_name"), ["main_struc"], "row_id")


@query("select doi, (row_number() over (order by doi) - 1) // 99 as batch from (select distinct doi from text_database where doi is not null)")
def distinct_batches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys in batches of 99 for a request source."""
    keys = table(spark, d, "text_database").where("doi is not null").select("doi").distinct()
    return batch.with_position(keys, ["doi"]).select("doi", batch.batch_number(F.col("pos"), 99).alias("batch"))


@query("select text_id, ntile(7) over (order by text_id) - 1 as shard from text_database")
def balanced_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_database").select("text_id")
    total = rows.count()
    return batch.with_position(rows, ["text_id"]).select("text_id", batch.balanced_shard(F.col("pos"), F.lit(total), 7).alias("shard"))


@query(
    """select resp_id, l.doi, prompt, item_id, passage from (select *, row_number() over (order by resp_id) as p from llm_responses) l join (select *, row_number() over (order by item_id) as p from eval_items) using (p)"""
)
def zip_positional(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of two tables side by side, by position."""
    left, right = table(spark, d, "llm_responses").select("resp_id", "doi", "prompt"), table(spark, d, "eval_items").select("item_id", "passage")
    return batch.zip_rows(left, right, ["resp_id"], ["item_id"]).drop("pos")


@query("select vec_id, doi, chunk_index from vector_database v where not exists (select 1 from text_database t where t.doi = v.doi and t.chunk_index = v.chunk_index)")
def anti_existing(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose chunk is not stored."""
    wanted = table(spark, d, "vector_database").select("vec_id", "doi", "chunk_index")
    return batch.missing_keys(wanted, table(spark, d, "text_database"), ["doi", "chunk_index"]).select("vec_id", "doi", "chunk_index")


@query("select doi, source from (select doi, 'text' as source from text_database union all select doi, 'vector' from vector_database union all select doi, 'response' from llm_responses)")
def union_batches(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("doi", F.lit(n).alias("source")) for t, n in (("text_database", "text"), ("vector_database", "vector"), ("llm_responses", "response"))]
    return batch.union_all(parts)


@query("select doi, min_by(text_id, length(chunk_text)) as shortest from (select doi, text_id, chunk_text, row_number() over (partition by doi order by length(chunk_text), text_id) as rn from text_database where chunk_text is not null) where rn = 1 group by doi")
def shortest_chunk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "text_database").where("chunk_text is not null")
    return rows.groupBy("doi").agg(F.min_by("text_id", F.struct(F.char_length("chunk_text"), "text_id")).alias("shortest"))


# ---------------------------------------------------------------- models


@query()
def embed_stub(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks from the stand-in model."""
    return backends.embed(spread(table(spark, d, "text_database").select("text_id", "chunk_text")), "chunk_text", backends.hash_embedder).select("text_id", "embedding")


@query(
    r"""select resp_id, case when prompt is not null then trim('You answer. ' || array_to_string((list_filter(string_split_regex(prompt, '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+'), lambda w: w <> ''))[-5:], ' ')) end as response,
case when prompt is null then 'AttributeError: ' || chr(39) || 'NoneType' || chr(39) || ' object has no attribute ' || chr(39) || 'split' || chr(39) end as error from llm_responses"""
)
def chat_stub(spark: SparkSession, d: str) -> DataFrame:
    """Answers to all prompts from the stand-in model."""
    return backends.chat(table(spark, d, "llm_responses").select("resp_id", "prompt"), backends.echo_chat, "You answer.").select("resp_id", "response", "error")


@query()
def rest_stub(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of all codes from a stand-in transport that fails on one batch in many."""

    def transport(keys: list[str]) -> list[str]:
        if keys[0].startswith("9"):
            raise OSError("no answer")
        return [f'{{"id": "{k}"}}' for k in keys]

    return rest.fetch(table(spark, d, "structures").where("rcsb_id is not null"), "rcsb_id", transport, 50)
