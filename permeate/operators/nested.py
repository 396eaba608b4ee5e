"""Deeply nested records to flat tables with parent links (problem 1).

Method: structural-variant tables. A bottom-up tree automaton assigns a state to every node of a
record from its own symbol and the states of its children. The state of the node decides the variant
and with it the typed subtype table; the columns all variants share (row id, child, parent path, path)
stay in the supertype table.

The same automaton exists twice: compiled to Catalyst expressions for columns whose nesting is typed
(`child_records`), and as a Python fold for JSON bodies whose shape differs from row to row
(`json_nodes`), where no Spark schema fits all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- typed columns


@dataclass(frozen=True)
class Node:
    """A kind of child record: ``at`` is the dotted field path below the parent, ``indexed`` tells an array, ``fields`` are
    the columns of its subtype table (field name, column name); a dotted field name goes into a struct."""

    child: str
    at: str
    indexed: bool = True
    emit: bool = True
    children: tuple[Node, ...] = field(default=())
    fields: tuple[tuple[str, str], ...] = ()

    def kinds(self) -> list[Node]:
        """All kinds of the tree that give records."""
        return ([self] if self.emit else []) + [k for c in self.children for k in c.kinds()]


def type_at(kind: T.DataType, dotted: str) -> T.DataType:
    for name in dotted.split("."):
        kind = kind[name].dataType
    return kind


def state_of(value: Column, kind: T.DataType, depth: int = 1) -> Column:
    """Automaton state of a typed node as a string: 0 absent, b blank text, t text, v other value,
    ``(...)`` struct of the states of its fields, ``[...]`` array of the distinct states of its items."""
    if isinstance(kind, T.StringType):
        inner = F.when(F.trim(value) == "", F.lit("b")).otherwise(F.lit("t"))
    elif isinstance(kind, T.StructType) and depth > 0:
        inner = F.concat(F.lit("("), *[state_of(value.getField(f.name), f.dataType, depth - 1) for f in kind], F.lit(")"))
    elif isinstance(kind, T.ArrayType) and depth > 0:
        items = F.transform(value, lambda x: state_of(x, kind.elementType, depth - 1))
        inner = F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(items)), ""), F.lit("]"))
    else:
        inner = F.lit("v")
    return F.when(value.isNull(), F.lit("0")).otherwise(inner)


#: State of a node that is not there.
ABSENT = "0"


def _link_type(root: Node, kind: T.DataType, typed: bool) -> T.ArrayType:
    """Element type of the links: the supertype's keys and, if ``typed``, one nullable struct per kind of child."""
    base = [T.StructField(n, T.StringType()) for n in ("child", "parent_path", "path", "shape")]
    if not typed:
        return T.ArrayType(T.StructType(base))
    found: dict[str, T.StructType] = {}

    def visit(node: Node, holder: T.DataType) -> None:
        own = type_at(holder, node.at)
        item = own.elementType if node.indexed else own
        if node.emit:
            found[node.child] = T.StructType([T.StructField(name, type_at(item, at)) for at, name in node.fields])
        for c in node.children:
            visit(c, item)

    visit(root, kind)
    return T.ArrayType(T.StructType(base + [T.StructField(c, t) for c, t in found.items()]))


def _inside(value: Column, dotted: str) -> Column:
    for name in dotted.split("."):
        value = value.getField(name)
    return value


def _walk(node: Node, value: Column, kind: T.DataType, path: Column | None, link: T.ArrayType) -> Column:
    """Links of a node and of all below it: the state of each node decides whether it is a record, and its variant."""
    none = F.array().cast(link)

    def item(x: Column, here: Column, item_kind: T.DataType) -> Column:
        state = state_of(x, item_kind)
        parts = []
        if node.emit:
            keys = [F.lit(node.child), F.lit(None).cast("string") if path is None else path, here, state]
            columns = []
            for f in link.elementType.fields[4:]:
                own = F.struct(*[_inside(x, at).alias(name) for at, name in node.fields]) if f.name == node.child and node.fields else F.lit(None)
                columns.append(own.cast(f.dataType))
            record = F.struct(*[c.alias(f.name) for c, f in zip(keys + columns, link.elementType.fields)])
            parts.append(F.when(state != ABSENT, F.array(record).cast(link)).otherwise(none))
        for c in node.children:
            parts.append(_walk(c, _inside(x, c.at), type_at(item_kind, c.at), here, link))
        return F.concat(*parts)

    if not node.indexed:
        return F.coalesce(item(value, path, kind), none)
    each = F.transform(
        value,
        lambda x, i: item(x, i.cast("string") if path is None else F.concat(path, F.lit("."), i.cast("string")), kind.elementType),
    )
    return F.coalesce(F.flatten(each), none)


def child_records(df: DataFrame, row_id: str, root: Node, typed: bool = False) -> DataFrame:
    """Supertype table: one row per record, ``(row_id, child, parent_path, path, shape)``.

    A node is a record if the automaton does not find it absent; ``shape``, its state, is the variant. With ``typed`` a
    column per kind of child holds the fields of its subtype table (`subtype_table`).

    One scan and one generator: the whole tree of a row becomes one array of links that is exploded once.
    Null levels and empty arrays give no rows, null elements keep their position, a struct whose fields are
    all null counts. Repeated rows count each by themselves; extra columns are ignored; an empty table gives
    an empty result. Nothing is shuffled.
    """
    kind = type_at(df.schema, root.at)
    value = _inside(F.col(f"`{root.at.split('.')[0]}`"), ".".join(root.at.split(".")[1:])) if "." in root.at else F.col(f"`{root.at}`")
    links = df.select(F.col(f"`{row_id}`").alias("row_id"), F.explode(_walk(root, value, kind, None, _link_type(root, df.schema, typed))).alias("n"))
    return links.select("row_id", "n.*")


def subtype_table(records: DataFrame, node: Node, shape: str | None = None, states: str | None = None) -> DataFrame:
    """Typed table of one kind of child, or of one of its variants: ``row_id, parent_path, path, shape`` and its fields.

    ``records`` are typed (`child_records`). The table of a variant holds only the fields that it has: ``states`` is the
    order of the node's fields in the automaton's state, one letter each (see `variant_fields`).
    """
    own = records.where(F.col("child") == node.child)
    names = [name for _, name in node.fields]
    if shape is not None:
        own = own.where(F.col("shape") == shape)
        if states is not None:
            names = [n for n in names if n in variant_fields(shape, states.split(","), node)]
    return own.select("row_id", "parent_path", "path", "shape", *[F.col(f"`{node.child}`.`{n}`").alias(n) for n in names])


def variant_fields(shape: str, state_fields: list[str], node: Node) -> list[str]:
    """Columns of a subtype table that a variant has: those whose field the state does not call absent."""
    there = {f for f, state in zip(state_fields, shape[1:-1]) if state != ABSENT}
    return [name for at, name in node.fields if at.split(".")[0] in there]


def write_subtypes(records: DataFrame, root: Node, folder: str) -> list[str]:
    """Writes one typed parquet table per kind of child under ``folder``, its variants as partitions; gives the paths.

    Rows of a variant lie together, so a reader of one variant opens only its files; keys and parent links are in each.
    """
    paths = []
    for node in root.kinds():
        path = f"{folder}/{node.child}"
        subtype_table(records, node).write.mode("overwrite").partitionBy("shape").parquet(path)
        paths.append(path)
    return paths


# ---------------------------------------------------------------- JSON bodies


class TreeAutomaton:
    """Deterministic bottom-up tree automaton over JSON values for text-bearing fields.

    States: ``none`` (null, blank text, empty list, object without the text key), ``text``, ``texts`` (list of
    text), ``object`` (object whose text key reaches text), ``objects`` (list that holds such objects) and
    ``other`` (numbers and flags). Transitions read the symbol of a node and the set of states of its children.
    """

    EMPTY = frozenset()

    def __init__(self, text_key: str = "text"):
        self.text_key = text_key
        self.delta: dict[tuple[str, frozenset[str]], str] = {}

    def leaf(self, value: object) -> str:
        if value is None or (isinstance(value, str) and not value.strip()):
            return "none"
        return "text" if isinstance(value, str) else "other"

    def step(self, symbol: str, below: frozenset[str]) -> str:
        """The transition table, filled as symbols and state sets appear; it is finite (2 symbols, 2**6 sets)."""
        known = self.delta.get((symbol, below))
        if known is None:
            live = below - {"none", "other"}
            if not live:
                known = "none" if "other" not in below else "other"
            elif symbol == "object":
                known = "object"
            else:
                known = "texts" if live == {"text"} else "objects"
            self.delta[symbol, below] = known
        return known

    def run(self, value: object) -> tuple[str, list[str]]:
        """State of the root and, in document order, the strings that brought it there."""
        if isinstance(value, list):
            states, found = set(), []
            for x in value:
                state, strings = self.run(x)
                states.add(state)
                found += strings
            return self.step("array", frozenset(states)), found
        if isinstance(value, dict):
            state, found = self.run(value.get(self.text_key))
            return self.step("object", frozenset([state])), found
        state = self.leaf(value)
        return state, [value] if state == "text" else []


def _reject(name: str) -> None:
    raise ValueError(name)


def _entries(body: str | None) -> list[dict | None] | None:
    if body is None:
        return None
    try:
        tree = json.loads(body, parse_constant=_reject)
        entries = tree["data"]["entries"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None
    return entries if isinstance(entries, list) else None


_NODES = "row_id long, entry int, key string, shape string, strings array<string>"


def json_nodes(df: DataFrame, row_id: str, body: str, field_name: str, key_name: str = "rcsb_id", text_key: str = "text") -> DataFrame:
    """One row per non-null entry of a JSON body: position, key, automaton state of ``field_name``, its strings.

    A body that is null or no valid JSON, or has no list under data.entries (error replies), gives no rows.
    Null entries keep their position and give no row. Strings are those under the text key, bare, or in lists of
    either, in document order; blank ones are left out and none is split. A missing field has the shape ``absent``.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = TreeAutomaton(text_key)
        for batch in batches:
            rows = []
            for rid, text in zip(batch["row_id"], batch["body"]):
                for i, entry in enumerate(_entries(text) or ()):
                    if not isinstance(entry, dict):
                        continue
                    state, strings = automaton.run(entry[field_name]) if field_name in entry else ("absent", [])
                    key = entry.get(key_name)
                    rows.append((rid, i, key if isinstance(key, str) else None, state, strings))
            yield pd.DataFrame(rows, columns=["row_id", "entry", "key", "shape", "strings"])

    return df.select(F.col(f"`{row_id}`").cast("long").alias("row_id"), F.col(f"`{body}`").alias("body")).mapInPandas(work, _NODES)


def string_children(nodes: DataFrame, child: str) -> DataFrame:
    """Child table of the strings: ``(row_id, child, parent_path, path, shape, value)``, path ``entry.k``."""
    return nodes.select("row_id", "entry", "shape", F.posexplode("strings").alias("k", "value")).select(
        "row_id",
        F.lit(child).alias("child"),
        F.col("entry").cast("string").alias("parent_path"),
        F.concat_ws(".", F.col("entry").cast("string"), F.col("k").cast("string")).alias("path"),
        "shape",
        "value",
    )


def variants(records: DataFrame) -> DataFrame:
    """How many records of each child kind fell into each structural variant."""
    return records.groupBy("child", "shape").agg(F.count("*").alias("n_records"), F.countDistinct("row_id").alias("n_rows"))
