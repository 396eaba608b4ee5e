"""Planner that flattens nested entries by a field specification.

The specification maps a field to its subfields, ``{"exptl": ["method"], "struct": ["title"], "rcsb_id": []}``.
Columns come in its order and are named ``field`` or ``field.sub``; fields that an entry type lacks are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields asked for when no specification is given.
DEFAULT_FIELDS = {
    "rcsb_id": [],
    "rcsb_primary_citation": ["pdbx_database_id_DOI"],
    "exptl": ["method", "method_details", "details"],
    "rcsb_entry_info": ["experimental_method"],
    "struct": ["title"],
    "struct_keywords": ["text"],
}


@dataclass(frozen=True)
class Rule:
    """How one field is read: kind is primitive, struct, first (list element 0), list (kept whole), expand, nest or missing."""

    field: str
    kind: str
    subfields: tuple[str, ...]


def column_names(spec: dict[str, list[str]]) -> list[str]:
    return [name for f, subs in spec.items() for name in ([f"{f}.{s}" for s in subs] or [f])]


def plan(schema: T.StructType, spec: dict[str, list[str]]) -> list[Rule]:
    """One rule per field. The first list of structs with subfields is expanded to rows, later ones become arrays
    (never a cross product)."""
    rules, expanded = [], False
    for name, subs in spec.items():
        kind = schema[name].dataType if name in schema.fieldNames() else None
        if kind is None:
            rules.append(Rule(name, "missing", tuple(subs)))
        elif isinstance(kind, T.StructType):
            rules.append(Rule(name, "struct" if subs else "primitive", tuple(subs)))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and subs:
            rules.append(Rule(name, "nest" if expanded else "expand", tuple(subs)))
            expanded = True
        elif isinstance(kind, T.ArrayType):
            # a list that is empty wherever it occurs has nothing to index
            rules.append(Rule(name, "list" if isinstance(kind.elementType, T.NullType) else "first", tuple(subs)))
        else:
            rules.append(Rule(name, "primitive", tuple(subs)))
    return rules


def _has(kind: T.DataType, sub: str) -> bool:
    return isinstance(kind, T.StructType) and sub in kind.fieldNames()


def flatten(entries: DataFrame, spec: dict[str, list[str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries as a flat table: one row per entry, or per item of the first list of structs (a null or empty list
    gives one row of nulls). Null items of that list are skipped. Built of projections and at most one generator."""
    spec = spec or DEFAULT_FIELDS
    out = entries
    rules = plan(entries.schema, spec)
    for r in rules:
        if r.kind == "expand":
            live = F.filter(F.col(f"`{r.field}`"), lambda x: x.isNotNull())
            out = out.select("*", F.explode_outer(live).alias(f"_x_{r.field}"))
    cols: list[Column] = [F.col(k) for k in keep]
    for r in rules:
        kind = entries.schema[r.field].dataType if r.kind != "missing" else None
        value = F.col(f"`{r.field}`") if r.kind != "missing" else F.lit(None).cast("string")
        if r.kind == "list":
            empty = F.coalesce(value.cast("array<string>"), F.array().cast("array<string>"))
            cols += [empty.alias(name) for name in column_names({r.field: list(r.subfields)})]
            continue
        if not r.subfields:
            cols.append((F.get(value, F.lit(0)) if r.kind == "first" else value).alias(r.field))
            continue
        for sub in r.subfields:
            null = F.lit(None).cast("string")
            if r.kind == "struct":
                got = value.getField(sub) if _has(kind, sub) else null
            elif r.kind == "expand":
                got = F.col(f"_x_{r.field}").getField(sub) if _has(kind.elementType, sub) else null
            elif r.kind == "nest":
                got = value.getField(sub) if _has(kind.elementType, sub) else null  # of an array of structs: an array
            elif r.kind == "primitive" and isinstance(kind, T.StringType):
                got = F.get_json_object(value, f"$.{sub}")  # of a field whose shape differs between entries: its JSON text
            elif r.kind == "first":
                got = F.get(value, F.lit(0)) if not isinstance(kind.elementType, T.StructType) else null
            else:
                got = null
            cols.append(got.alias(f"{r.field}.{sub}"))
    return out.select(*cols)


def describe(schema: T.StructType, spec: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """(field, rule, columns) of a plan, for reports."""
    return [(r.field, r.kind, ", ".join(column_names({r.field: list(r.subfields)}))) for r in plan(schema, spec)]


def infer_entries(responses: DataFrame, body: str, kind: str = "entries") -> T.StructType:
    """Schema of the entries under ``data.<kind>``, merged over all bodies map-side; damaged bodies say nothing.

    A field whose shape differs between entries is text (its JSON), as is one that is always null; a list that is empty
    wherever it occurs has elements of the null type.
    """
    entries = F.try_variant_get(F.try_parse_json(F.col(body)), f"$.data.{kind}", "array<variant>")
    one = responses.select(F.explode(entries).alias("e")).where("e is not null")
    found = one.agg(F.schema_of_variant_agg("e")).first()[0]
    ddl = (found or "VOID").replace("OBJECT<", "STRUCT<")
    if not ddl.startswith("STRUCT<"):
        return T.StructType([])
    return _plain_types(T.DataType.fromDDL(ddl.replace("VARIANT", "STRING")))


def _plain_types(kind: T.DataType, inside_list: bool = False) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain_types(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain_types(kind.elementType, True))
    if isinstance(kind, T.NullType):
        return kind if inside_list else T.StringType()
    return T.DoubleType() if isinstance(kind, T.DecimalType) else kind


def _readable(kind: T.DataType) -> T.DataType:
    """The same with text for elements of the null type, which no reader knows."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _readable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_readable(kind.elementType))
    return T.StringType() if isinstance(kind, T.NullType) else kind


def entries_of(responses: DataFrame, body: str, entry_schema: str | T.StructType | None = None, keep: tuple[str, ...] = (), kind: str = "entries") -> DataFrame:
    """Entries under ``data.<kind>`` of JSON bodies as typed columns, with their position ``entry``; null entries
    and damaged bodies give no rows. Without a schema it is inferred over all rows (`infer_entries`)."""
    inferred = infer_entries(responses, body, kind) if entry_schema is None else entry_schema
    text = inferred if isinstance(inferred, str) else _readable(inferred).simpleString()
    schema = f"struct<data: struct<`{kind}`: array<{text}>>>"
    parsed = responses.where(F.try_parse_json(F.col(body)).isNotNull()).select(*keep, F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}).alias("b"))
    one = parsed.select(*keep, F.posexplode(f"b.data.{kind}").alias("entry", "e")).where("e is not null")
    if isinstance(inferred, str):
        return one.select(*keep, "entry", "e.*")
    # lists without any element get their type back, so that the planner keeps them whole
    empty = {f.name for f in inferred if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NullType)}
    nothing = lambda c: F.when(c.isNotNull(), F.array()).cast("array<void>")
    return one.select(*keep, "entry", *[(nothing(F.col(f"e.`{f.name}`")) if f.name in empty else F.col(f"e.`{f.name}`")).alias(f.name) for f in inferred])
