"""Deeply nested JSON to flat tables that keep parent-child links."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.common import map_batches

FIELDS = ("extra_json", "auto_enter")
NODE_SCHEMA = "entity_id long, src_field string, tag string, node_path string, parent_path string, payload string, n_members int"
PATH_SCHEMA = "entity_id long, src_field string, node_path string, parent_path string"

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


class _Members(list):
    """The members of an object in their order, equal names included."""


def _refuse(name: str):
    raise ValueError(name)


class _Number(str):
    """A number as its digits stand in the text."""


_DECODER = json.JSONDecoder(object_pairs_hook=_Members, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
_LITERALS = {"true": True, "false": False, "null": None}


def _scalar(text: str):
    return _LITERALS[text] if text in _LITERALS else _Number(text)


def _parse_deep(text: str):
    """Like the decoder, without a limit of depth: a stack of open containers over a token pattern."""
    at, end, stack, state, top, key = 0, len(text.rstrip(" \t\n\r")), [], "value", None, None
    while at < end:
        if not (m := _TOKEN.match(text, at)):
            raise ValueError(at)
        at, (mark, string, other) = m.end(), m.groups()
        if state in ("key", "first_key") and string:
            key, state = json.loads(string), "colon"
            continue
        if state == "colon" and mark == ":":
            state = "value"
            continue
        if state in ("next", "first_value", "first_key") and mark in ("}", "]") and stack and (mark == "}") == isinstance(stack[-1][0], _Members):
            stack.pop()
            state = "next"
            continue
        if state == "next" and mark == "," and stack:
            state = "key" if isinstance(stack[-1][0], _Members) else "value"
            continue
        if state not in ("value", "first_value") or mark not in (None, "{", "["):
            raise ValueError(at)
        value = _Members() if mark == "{" else [] if mark == "[" else json.loads(string) if string else _scalar(other)
        if stack:
            box = stack[-1][0]
            box.append((key, value) if isinstance(box, _Members) else value)
        elif top is None:
            top = (value,)
        else:
            raise ValueError(at)
        if mark:
            stack.append((value,))
        state = ("first_key" if mark == "{" else "first_value") if mark else "next"
    if stack or top is None or state != "next":
        raise ValueError(end)
    return top[0]


def _parse(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def top_value(text: str):
    """The object or array that a value holds, a JSON string of an object opened once; None for anything else."""
    try:
        value = _parse(text)
        if isinstance(value, str) and value.lstrip(" \t\n\r")[:1] == "{":
            value = _parse(value)
            return value if isinstance(value, _Members) else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, list) else None


def visit(top):
    """Depth-first over the objects of a value: (tag, node path, parent path, object); tag is the nearest member's name.

    The top comes first, as ``root`` at ``$`` without a parent; where it is an array, it counts as an object whose one member, of an empty name, is that array.
    """
    yield "root", "$", None, top if isinstance(top, _Members) else _Members([("", top)])
    stack = [(top, "$", "$", "root")]
    while stack:
        node, path, parent, tag = stack.pop()
        below = []
        if isinstance(node, _Members):
            if node is not top:
                yield tag, path, parent, node
            for k, v in node:
                if isinstance(v, list):
                    below.append((v, f"{path}.{k}", path, k))
        else:
            for i, v in enumerate(node):
                if isinstance(v, list):
                    below.append((v, f"{path}[{i}]", parent, tag))
        stack.extend(reversed(below))


def _text(value) -> str:
    """JSON text of a scalar or an array of any depth; an object in it stands as null, as it has a row of its own at its position."""
    out, open_, first = [], [iter((value,))], [True]
    while open_:
        for v in open_[-1]:
            if not first[-1]:
                out.append(", ")
            first[-1] = False
            if isinstance(v, list) and not isinstance(v, _Members):
                out.append("[")
                open_.append(iter(v))
                first.append(True)
                break
            out.append("null" if isinstance(v, _Members) else v if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False))
        else:
            open_.pop()
            first.pop()
            out.append("]" if open_ else "")
    return "".join(out)


def _payload(node: _Members) -> tuple[str, int]:
    """An object's own members as JSON, in their order, nulls and members of equal name included, and how many. Objects, and arrays of nothing but objects, have rows of their own."""
    own = [(k, v) for k, v in node if not isinstance(v, _Members) and not (isinstance(v, list) and v and all(isinstance(x, _Members) for x in v))]
    return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_text(v)}" for k, v in own) + "}", len(own)


def _emit(with_payload: bool, size: int = 20_000):
    def run(batches):
        out: list[tuple] = []
        names = NODE_SCHEMA if with_payload else PATH_SCHEMA
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}.get(c.split()[1], pa.string())) for c in names.split(", ")])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for eid, field, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (top := top_value(text)) is None:
                    continue
                for tag, path, parent, node in visit(top):
                    if with_payload:
                        out.append((eid, field, tag, path, parent, *_payload(node)))
                    elif parent is not None:
                        out.append((eid, field, path, parent))
                    if len(out) >= size:
                        yield flush()
        if out:
            yield flush()

    return run


def _values(entities: DataFrame) -> DataFrame:
    """``entity_id, src_field, value`` of the values that may hold an object or array."""
    pairs = F.array(*[F.struct(F.lit(f).alias("src_field"), F.col(f).alias("value")) for f in FIELDS])
    return entities.where("entity_id is not null").select("entity_id", F.explode(pairs).alias("v")).select("entity_id", "v.*").where(F.col("value").rlike(r'^[ \t\n\r]*[{\["]'))


def nested_paths(entities: DataFrame) -> DataFrame:
    """``entity_id, src_field, node_path, parent_path`` of each object below the top of extra_json and auto_enter.

    A single depth-first pass per value. Rows without an id, null, blank and malformed values give no rows; a JSON string of an object counts
    as that object; strings further inside stay strings; members of equal name are all visited; rows given twice count once.
    Depth is unlimited (an explicit stack, also in the parser where the built-in one gives up). Empty tables give no rows.
    """
    # a value with an object below its top has two opening braces, escaped ones included, or one in an array
    two = F.expr(r"locate('{', value, locate('{', value) + 1) > 0 or lower(value) like '%\\\\u007b%'")
    array = F.col("value").rlike(r"^[ \t\n\r]*\[") & F.col("value").contains("{")
    return map_batches(_values(entities).where(two | array), _emit(False), PATH_SCHEMA).distinct()


def nested_nodes(entities: DataFrame) -> DataFrame:
    """Every object, the top included: ``entity_id, src_field, tag, node_path, parent_path, payload, n_members``.

    ``tag`` is the member's name that leads to the object, ``root`` at the top; ``payload`` its own members as JSON (scalars, nulls, arrays, repeated names), ``n_members`` their number.
    The link of a row to its parent row is (entity_id, src_field, parent_path); the top has no parent. A top array is an object with one member of an empty name.
    Together the rows hold all that the values hold. Otherwise as nested_paths.
    """
    return map_batches(_values(entities), _emit(True), NODE_SCHEMA).distinct()


#: Columns of the child tables that have a fixed shape in parsed reports; other tags keep their payload as JSON.
CHILD_SCHEMAS = {
    "sides": "side string, to string, cascade_create boolean, cascade_delete boolean",
    "predicates": "op string, left string, right string",
    "serial": "increment string, nextValue string, generate string",
    "triggers": "event string",
    "bounds": "top string, left string, bottom string, right string",
}


def child_table(nodes: DataFrame, tag: str, schema: str | None = None) -> DataFrame:
    """The rows of one tag as a flat table: the keys, and the payload under ``schema`` (CHILD_SCHEMAS, else a map of strings)."""
    keys = ["entity_id", "src_field", "node_path", "parent_path"]
    rows = nodes.where(F.col("tag") == tag)
    schema = schema or CHILD_SCHEMAS.get(tag)
    parsed = F.from_json("payload", schema if schema else T.MapType(T.StringType(), T.StringType()))
    return rows.select(*keys, parsed.alias("p")).select(*keys, "p.*" if schema else F.col("p").alias("members"))


def child_values(nodes: DataFrame) -> DataFrame:
    """``entity_id, src_field, node_path, name, value``: each own member of each object as a row; texts without quotes, arrays as JSON, null as null."""
    members = F.explode(F.from_json("payload", T.MapType(T.StringType(), T.StringType())))
    return nodes.select("entity_id", "src_field", "node_path", members.alias("name", "value"))


def write_child_tables(nodes: DataFrame, path: str) -> None:
    """All child tables in one write, partitioned by tag: a tag with much data is spread over several files, one with little is one file."""
    nodes.hint("rebalance", "tag").write.partitionBy("tag").mode("overwrite").parquet(path)


def read_child_tables(spark: SparkSession, path: str) -> DataFrame:
    """What write_child_tables wrote; a condition on ``tag`` reads that table only."""
    columns = NODE_SCHEMA.split(", ")
    schema = ", ".join([c for c in columns if c != "tag string"] + ["tag string"])
    return spark.read.schema(schema).parquet(path).withColumn("tag", F.coalesce("tag", F.lit(""))).select(*[c.split()[0] for c in columns])
