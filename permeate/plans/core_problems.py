"""Queries of the general training-data problems 1, 3 and 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permeate.operators import nested, orphans, quantities
from permeate.session import spread, table

COMPONENT = nested.Node("component", "component", fields=(("name", "name"), ("formula", "formula"), ("concentration.valueOf_", "amount"), ("concentration.units", "units")))
BUFFER = nested.Node("buffer", "buffer", indexed=False, children=(COMPONENT,), fields=(("ph", "ph"),))
SPECIMEN = nested.Node("specimen_preparation", "specimen_preparation_list.specimen_preparation", children=(BUFFER,), fields=(("details", "details"),))
DETERMINATION = nested.Node("determination", "structure_determination_list", emit=False, children=(SPECIMEN,))


def _children(spark: SparkSession, d: str) -> DataFrame:
    emdb = nested.child_records(table(spark, d, "emdb_entries"), "row_id", DETERMINATION).withColumn("source_table", F.lit("emdb_entries"))
    nodes = nested.json_nodes(spread(table(spark, d, "pdb_responses").select("response_id", "body")), "response_id", "body", "struct_keywords")
    pdb = nested.string_children(nodes, "struct_keywords").drop("value").withColumn("source_table", F.lit("pdb_responses"))
    return emdb.unionByName(pdb)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _children(spark, d).select("source_table", "row_id", "child", "path")


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows per child kind and structural variant (automaton state)."""
    return nested.variants(_children(spark, d))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_records(table(spark, d, "emdb_entries"), "row_id", DETERMINATION, typed=True)


def p1_specimens(spark: SparkSession, d: str) -> DataFrame:
    """Typed table of the specimens with variant and parent link."""
    return nested.subtype_table(_typed(spark, d), SPECIMEN)


def p1_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Typed table of the buffers with variant and parent link."""
    return nested.subtype_table(_typed(spark, d), BUFFER)


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    """Typed table of the components with variant, parent link and all leaf fields."""
    return nested.subtype_table(_typed(spark, d), COMPONENT)


def p1_bare_components(spark: SparkSession, d: str) -> DataFrame:
    """Typed table of one variant of the components, those with a name but neither formula nor concentration."""
    return nested.subtype_table(_typed(spark, d), COMPONENT, "(t00)", "name,formula,concentration")


def p1_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keyword table of the JSON bodies with its entry as parent."""
    nodes = nested.json_nodes(spread(table(spark, d, "pdb_responses").select("response_id", "body")), "response_id", "body", "struct_keywords")
    return nested.string_children(nodes, "struct_keywords").select("row_id", "parent_path", "path", "value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities.quantities(table(spark, d, "emdb_entries"))


def p3_missing_units(spark: SparkSession, d: str) -> DataFrame:
    """Amounts without a unit: predicted and converted, or routed for review."""
    return quantities.predict_units(table(spark, d, "emdb_entries"))


def p3_unit_quality(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the predicted units on stated amounts of the test fold whose unit is hidden, per route."""
    return quantities.unit_quality(table(spark, d, "emdb_entries"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    a = orphans.references(table(spark, d, "pdbtm"), "pdbtm", "row_id", "pdbCode", "added_at")
    b = orphans.references(table(spark, d, "mpstruc"), "mpstruc", "row_id", "member_struc", "added_at")
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Step 0 of the cascade: references without a structure of their own. The rounds after it add only inherited orphans."""
    return orphans.find_orphans(_refs(spark, d), orphans.presence(table(spark, d, "structures")), max_rounds=0).select("ref_table", "row_id", "ref_field", "status", "period")


def _all_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans: structures <- mpstruc members <- pdbtm helices and mpstruc groups of the member.

    Both tables refer to structures, so direct orphans of both start the cascade; a row that is one is never inherited.
    """
    pdbtm = table(spark, d, "pdbtm").select("row_id", orphans.code_key(F.col("pdbCode")).alias("code"))
    mpstruc = table(spark, d, "mpstruc").select("row_id", orphans.code_key(F.col("member_struc")).alias("code"), orphans.code_key(F.col("main_struc")).alias("main"))
    edges = [orphans.ForeignKey("pdbtm", ("code",), "mpstruc", ("code",)), orphans.ForeignKey("mpstruc", ("main",), "mpstruc", ("code",))]
    tables, ids = {"pdbtm": pdbtm, "mpstruc": mpstruc}, {"pdbtm": "row_id", "mpstruc": "row_id"}
    return orphans.find_orphans(_refs(spark, d), orphans.presence(table(spark, d, "structures")), tables, ids, edges)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, period, origin (direct or inherited) and status. A row that is inherited but has no reference of
    its own to structures counts under a null period."""
    return _all_orphans(spark, d).groupBy("ref_table", "period", "origin", "status").agg(F.count("*").alias("n_rows"))


def p6_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and depth."""
    return _all_orphans(spark, d).groupBy("ref_table", "origin", "depth").agg(F.count("*").alias("n_rows"))


QUERIES = {
    "p1_found": p1_found,
    "p1_variants": p1_variants,
    "p1_specimens": p1_specimens,
    "p1_buffers": p1_buffers,
    "p1_components": p1_components,
    "p1_bare_components": p1_bare_components,
    "p1_keywords": p1_keywords,
    "p3_found": p3_found,
    "p3_missing_units": p3_missing_units,
    "p3_unit_quality": p3_unit_quality,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_cascade": p6_cascade,
}

_CODE = r"regexp_replace(upper(regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')), '^PDB_0000(.{{4}})$', '\1')"
_SQL_REFS = f"""
refs as (
  select 'pdbtm' as ref_table, row_id, 'pdbCode' as ref_field, {_CODE.format('pdbCode')} as code, added_at from pdbtm
  union all
  select 'mpstruc', row_id, 'member_struc', {_CODE.format('member_struc')}, added_at from mpstruc),
stays as (select distinct {_CODE.format('rcsb_id')} as code, arrived_at, removed_at from structures where arrived_at is not null),
firsts as (select code, min(arrived_at) as first_at from stays where code <> '' group by code),
found as (
  select r.ref_table, r.row_id, r.ref_field,
         case when f.code is null then 'missing' when r.added_at < f.first_at then 'late' else 'removed' end as status,
         strftime(r.added_at, '%Y-%m') as period
  from refs r left join firsts f on f.code = r.code
  where r.code <> '' and not exists (select 1 from stays s where s.code = r.code and s.arrived_at <= r.added_at
                                     and (s.removed_at is null or s.removed_at > r.added_at)))"""
# The rounds of the cascade written out; chains in these tables end before.
_ROUNDS = 12
_MAIN = _CODE.format("main_struc")


def _round(k: int) -> str:
    return f"""
x{k} as materialized (select m.code from m left join b{k - 1} b using (row_id) where m.code <> '' group by m.code having count(*) = count(b.row_id)),
b{k} as materialized (select * from b{k - 1} union all select row_id, {k} from m where main in (select code from x{k}) and row_id not in (select row_id from b{k - 1}))"""


_SQL_CASCADE = f"""{_SQL_REFS},
m as materialized (select row_id, added_at, {_CODE.format("member_struc")} as code, {_MAIN} as main from mpstruc),
b0 as materialized (select row_id, 0 as depth from found where ref_table = 'mpstruc'),{",".join(_round(k) for k in range(1, _ROUNDS + 1))},
death as (select code, min(k) as depth from ({" union all ".join(f"select code, {k} as k from x{k}" for k in range(1, _ROUNDS + 1))}) group by code),
orphan as (
  select ref_table, period, 'direct' as origin, status, 0 as depth from found
  union all
  select 'mpstruc', case when m.code <> '' then strftime(m.added_at, '%Y-%m') end, 'inherited', 'inherited', b.depth from b{_ROUNDS} b join m using (row_id) where b.depth > 0
  union all
  select 'pdbtm', period, 'inherited', 'inherited', depth from (select row_id, strftime(added_at, '%Y-%m') as period, {_CODE.format("pdbCode")} as code from pdbtm) join death using (code)
  where row_id not in (select row_id from found where ref_table = 'pdbtm'))"""
_TEXT = "case when {0} is null then '0' when trim({0}) = '' then 'b' else 't' end"
_PART = "case when {0} is null then '0' else 'v' end"
_SQL_SPECIMENS = f"""
d as (select row_id, unnest(structure_determination_list) as d, generate_subscripts(structure_determination_list, 1) - 1 as i from emdb_entries),
s as (select row_id, i::varchar as parent_path, i || '.' || (generate_subscripts(d.specimen_preparation_list.specimen_preparation, 1) - 1) as path,
             unnest(d.specimen_preparation_list.specimen_preparation) as s from d),
c0 as (select row_id, path as parent_path, path || '.' || (generate_subscripts(s.buffer.component, 1) - 1) as path, unnest(s.buffer.component) as c from s),
specimens as (select row_id, parent_path, path, '(' || {_PART.format("s.buffer")} || {_TEXT.format("s.details")} || ')' as shape, s.details as details from s where s is not null),
buffers as (select row_id, path as parent_path, path, '(' || {_TEXT.format("s.buffer.ph")} || {_PART.format("s.buffer.component")} || ')' as shape, s.buffer.ph as ph from s where s.buffer is not null),
components as (select row_id, parent_path, path, '(' || {_TEXT.format("c.name")} || {_TEXT.format("c.formula")} || {_PART.format("c.concentration")} || ')' as shape,
             c.name as name, c.formula as formula, c.concentration.valueOf_ as amount, c.concentration.units as units from c0 where c is not null)"""
_SQL_KEYWORDS = r"""
j as (select response_id as row_id, body::json as j from pdb_responses where json_valid(body)),
e as (select row_id, j, unnest(range(json_array_length(j, '$.data.entries')::bigint)) as entry from j where json_type(j, '$.data.entries') = 'ARRAY'),
k as (select row_id, entry, j -> ('$.data.entries[' || entry || ']') as e from e),
n as (select row_id, entry, (e -> '$.struct_keywords') as node, []::bigint[] as place from k where json_type(e) = 'OBJECT' and (e -> '$.struct_keywords') is not null
  union all
  select row_id, entry, case json_type(node) when 'ARRAY' then (node -> ('$[' || i || ']')) else (node -> '$.text') end, list_append(place, i)
  from (select *, unnest(case json_type(node) when 'ARRAY' then range(json_array_length(node)::bigint) when 'OBJECT' then [0] else [] end) as i from n) where json_type(node) in ('ARRAY', 'OBJECT')),
strings as (select row_id, entry, place, (node ->> '$') as value from n where json_type(node) = 'VARCHAR' and not regexp_full_match((node ->> '$'), '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]*')),
keywords as (select row_id, entry::varchar as parent_path, entry || '.' || (row_number() over (partition by row_id, entry order by place) - 1) as path, value from strings)""".replace("\\\\", "\\")

ORACLE = {
    "p6_found": f"with {_SQL_REFS} select * from found",
    "p6_report": f"with {_SQL_CASCADE} select ref_table, period, origin, status, count(*) as n_rows from orphan group by all",
    "p6_cascade": f"with {_SQL_CASCADE} select ref_table, origin, depth, count(*) as n_rows from orphan group by all",
    "p1_found": f"""with recursive {_SQL_SPECIMENS}, {_SQL_KEYWORDS}
select 'emdb_entries' as source_table, row_id, 'specimen_preparation' as child, path from specimens
union all select 'emdb_entries', row_id, 'buffer', path from buffers
union all select 'emdb_entries', row_id, 'component', path from components
union all select 'pdb_responses', row_id, 'struct_keywords', path from keywords""",
    "p1_variants": f"""with recursive {_SQL_SPECIMENS}, {_SQL_KEYWORDS},
roots as (select row_id, entry, json_type(node) as kind from n where len(place) = 0),
depth as (select row_id, entry, max(len(place)) as most, count(*) as k from strings group by all),
records as (select 'specimen_preparation' as child, shape, row_id, 1 as k from specimens union all select 'buffer', shape, row_id, 1 from buffers union all select 'component', shape, row_id, 1 from components
  union all select 'struct_keywords', case when kind = 'VARCHAR' then 'text' when kind = 'OBJECT' then 'object' when most = 1 then 'texts' else 'objects' end, row_id, k from depth join roots using (row_id, entry))
select child, shape, sum(k)::bigint as n_records, count(distinct row_id) as n_rows from records group by all""",
    "p1_specimens": f"with {_SQL_SPECIMENS} select * from specimens",
    "p1_buffers": f"with {_SQL_SPECIMENS} select * from buffers",
    "p1_components": f"with {_SQL_SPECIMENS} select * from components",
    "p1_bare_components": f"with {_SQL_SPECIMENS} select row_id, parent_path, path, shape, name from components where shape = '(t00)'",
    "p1_keywords": f"with recursive {_SQL_KEYWORDS} select row_id, parent_path, path, value from keywords",
}
