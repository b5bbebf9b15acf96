"""Deeply nested semi-structured records as flat tables with parent-child links.

The text of a record is decoded (strings that are complete JSON texts count as what they
encode), parsed once to a VARIANT and unfolded level by level with generators on the JVM:
every step replaces an open container by itself (closed) and its elements. The rows are the
child tables of all levels: they carry a surrogate key, that of the nearest enclosing
object, the path and the array ordinal. ``merged_schema`` infers the schema of all records
from them, ``child_table`` gives the table of one of its patterns, ``element_paths`` the
paths of all of them.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.runtime import staged

STEPS_PER_STAGE = 3
DEEPEST = 64  # levels of one fragment of a record; what lies deeper becomes a fragment of its own
FRAGMENT = T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()), T.StructField("parent_path", T.StringType()), T.StructField("ordinal", T.IntegerType()),
    T.StructField("json", T.StringType()), T.StructField("depth", T.IntegerType()),
]))
TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')
WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(literal: str) -> int | float | str:
    """A JSON number; one that no long or double holds stays the text that it is."""
    if len(literal) < 19 and literal.lstrip("-").isdigit():
        return int(literal)
    x = float(literal)
    return literal if math.isinf(x) or literal.lstrip("-").isdigit() else x


def _parse_deep(text: str):
    """A JSON text of any depth, read token by token; invalid text raises ValueError."""
    stack: list = []  # open containers with their pending key
    state, at, end = "value", 0, len(text)
    root = None

    def close(value):
        nonlocal state, root
        if not stack:
            root, state = value, "end"
        else:
            box, key = stack[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            state = "after"

    while state != "end":
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON")
        at = m.end()
        mark, string, number, word = m.groups()
        box = stack[-1][0] if stack else None
        if state in ("key", "first key"):
            if string:
                stack[-1][1] = json.loads(string)
                m = TOKEN.match(text, at)
                if not m or m[1] != ":":
                    raise ValueError("no colon")
                at, state = m.end(), "value"
            elif mark == "}" and state == "first key":
                close(stack.pop()[0])
            else:
                raise ValueError("no key")
        elif state == "after":
            if mark == ",":
                state = "key" if isinstance(box, dict) else "value"
            elif mark == ("}" if isinstance(box, dict) else "]"):
                close(stack.pop()[0])
            else:
                raise ValueError("no comma")
        elif mark == "{":
            stack.append([{}, None])
            state = "first key"
        elif mark == "[":
            stack.append([[], None])
            state = "first"
        elif mark == "]" and state == "first":
            close(stack.pop()[0])
        elif mark:
            raise ValueError("no value")
        else:
            close(json.loads(string) if string else _number(number) if number else WORDS[word])
    if text[at:end].strip(" \t\r\n"):
        raise ValueError("text after the end")
    return root


def parse_json_text(text: str):
    """The value of a complete JSON text of any depth; anything else raises ValueError."""
    try:
        return json.loads(text, parse_constant=_no_constant, parse_float=_number, parse_int=_number)
    except RecursionError:
        return _parse_deep(text)


def _opened(value):
    """What a string that is the complete JSON text of an object, array or string encodes, repeatedly."""
    while isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        try:
            inner = parse_json_text(value)
        except ValueError:
            return value
        if not isinstance(inner, str | dict | list) or inner == value:
            return value
        value = inner
    return value


def fragments(text: str | None, root: str, deepest: int = DEEPEST) -> list[tuple[str, str | None, int | None, str, int]]:
    """(path, parent_path, ordinal, json, depth) of a (possibly repeatedly) encoded record, as plain JSON texts.

    The first fragment is the record; containers ``deepest`` levels down are fragments of
    their own, with null in their place, so no text is nested deeper. ``parent_path`` is the
    nearest enclosing object. Null, blank, cut off or otherwise invalid text and scalars have
    none. Of a repeated key the last value counts; numbers that no double holds become text.
    """
    if text is None or not text.strip():
        return []
    try:
        value = _opened(parse_json_text(text))
    except ValueError:
        return []
    if not isinstance(value, dict | list):
        return []
    out: list[list] = []
    starts = [(value, root, None, None)]
    while starts:
        source, path, parent, ordinal = starts.pop()
        copy: dict | list = {} if isinstance(source, dict) else []
        out.append([path, parent, ordinal, copy, 1])
        # (source, copy, level, steps from the start of the fragment, the object that encloses it)
        todo = [(source, copy, 1, None)]
        while todo:
            box, new, level, way = todo.pop()
            named = isinstance(box, dict)
            for step, item in box.items() if named else enumerate(box):
                item = _opened(item)
                if isinstance(item, dict | list):
                    if level >= deepest:
                        full, above = _full_path((way, box, step), path, parent)
                        starts.append((item, full, above, None if named else step))
                        item = None
                    else:
                        child: dict | list = {} if isinstance(item, dict) else []
                        todo.append((item, child, level + 1, (way, box, step)))
                        out[-1][4] = max(out[-1][4], level + 1)
                        item = child
                if named:
                    new[step] = item
                else:
                    new.append(item)
    return [(p, q, n, json.dumps(c), d) for p, q, n, c, d in out]


def _full_path(way, path: str, parent: str | None) -> tuple[str, str | None]:
    """The path of the container at the end of ``way`` and that of the nearest object above it."""
    steps = []
    while way is not None:
        way, box, step = way
        steps.append((isinstance(box, dict), step))
    above, at = parent, [path]
    for named, step in reversed(steps):
        if named:
            above = "".join(at)
        at.append(f".{step}" if named else f"[{step}]")
    return "".join(at), above


def decode_json(column: str, root: str) -> Column:
    """The fragments of the records of a column."""
    names = [f.name for f in FRAGMENT.elementType.fields]

    @F.pandas_udf(FRAGMENT)
    def decode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[dict(zip(names, f, strict=True)) for f in fragments(t, root)] for t in s])

    return decode(F.col(column))


def latest_rows(df: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The row of the greatest ``time`` of every key (null times come first, ties by content)."""
    s = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(c) for c in columns])
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(s).alias("_s")).select(
        key, *[F.col(f"_s.{c}").alias(c) for c in columns]
    )


def merged_metadata(rows: DataFrame, key: str | list[str], column: str) -> DataFrame:
    """(key, field, values): distinct sorted values of every top-level field of JSON metadata.

    A value that is a JSON array counts as its elements; null, blank and invalid metadata and null values have none.
    """
    key = [key] if isinstance(key, str) else key
    e = rows.select(*key, F.explode(F.from_json(column, "map<string,string>")).alias("field", "value")).where("value is not null")
    items = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", "array<string>"))
    e = e.select(*key, "field", F.explode(F.coalesce(items, F.array("value"))).alias("value")).where("value is not null").distinct()
    return e.groupBy(*key, "field").agg(F.array_sort(F.collect_list("value")).alias("values"))


def metadata_json(merged: DataFrame, key: list[str]) -> DataFrame:
    """(key, metadata): the fields of ``merged_metadata`` as one JSON object of arrays."""
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values"))))
    return merged.groupBy(*key).agg(F.to_json(fields).alias("metadata"))


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes of mentions: occurrences, distinct documents and contexts of every (text ignoring case, type).

    ``mentions``: document_id, text, type, start_pos, end_pos. The first mention in
    (document_id, start_pos, text) order gives the text and thereby the node_id.
    """
    order = F.struct("document_id", "start_pos", "text")
    rows = mentions.where(F.col("text").isNotNull() & F.col("type").isNotNull())
    context = F.struct(F.col("document_id").alias("document"), "start_pos", "end_pos")
    n = rows.groupBy(F.lower("text").alias("folded"), "type").agg(
        F.min_by("text", order).alias("text"), F.count(F.lit(1)).alias("occurrences"),
        F.array_sort(F.collect_set("document_id")).alias("documents"), F.array_sort(F.collect_list(context)).alias("contexts"),
    )
    return n.select(node_id(F.col("text"), F.col("type")).alias("node_id"), "text", "type", "occurrences", "documents", "contexts")


def array_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, parent_path, ordinal, value): one row for each non-null element of an array column."""
    return (
        df.select(key, F.posexplode(column).alias("ordinal", "value"))
        .where(F.col("value").isNotNull())
        .select(
            key,
            F.concat(F.lit(column + "["), F.col("ordinal").cast("string"), F.lit("]")).alias("path"),
            F.lit(None).cast("string").alias("parent_path"),
            "ordinal",
            "value",
        )
    )


def _unfold(df: DataFrame, key: str) -> DataFrame:
    """One level: open containers become themselves, closed, and their open elements."""
    df = df.withColumn("m", F.expr("if(open, try_cast(v as map<string, variant>), null)")).withColumn(
        "a", F.expr("if(open, try_cast(v as array<variant>), null)")
    )
    df = df.withColumn("object", F.coalesce("is_object", F.lit(False)) | F.col("m").isNotNull())
    df = df.withColumn("seen", F.col("object") | F.expr("ordinal is not null and a is null"))
    me = (
        "named_struct('path', path, 'parent_path', parent_path, 'ordinal', ordinal, 'v', v,"
        " 'open', false, 'is_object', object)"
    )
    kids = (
        "coalesce(transform(map_entries(m), e -> named_struct('path', path || '.' || e.key, 'parent_path', path,"
        " 'ordinal', cast(null as int), 'v', e.value, 'open', true, 'is_object', false)),"
        " transform(a, (x, i) -> named_struct('path', path || '[' || i || ']', 'parent_path', parent_path,"
        " 'ordinal', i, 'v', x, 'open', true, 'is_object', false)), array())"
    )
    return df.select(key, F.expr(f"explode(if(seen, array({me}), array()) || {kids}) as r")).select(key, "r.*")


def record_rows(decoded: DataFrame, key: str, depth: int) -> DataFrame:
    """(key, path, parent_path, ordinal, value, is_object): every object of the decoded records and every array element.

    The root counts as an object; null elements give no rows, and an array in an array gives
    its elements. ``depth`` is the greatest depth of a fragment. Every ``STEPS_PER_STAGE``
    levels the rows are staged: what is finished leaves the loop as the tables of these
    levels, only open containers go on.
    """
    rows = decoded.select(
        key, "path", "parent_path", "ordinal", F.expr("try_parse_json(json)").alias("v"), F.lit(True).alias("open"), F.lit(False).alias("is_object"),
    )
    done = None
    # what is still open after all levels is no container
    finished = F.col("is_object") | (F.col("ordinal").isNotNull() & ~F.expr("is_variant_null(v)"))
    container = F.expr("try_cast(v as map<string, variant>) is not null or try_cast(v as array<variant>) is not null")
    for level in range(1, depth + 1):
        rows = _unfold(rows, key)
        if level % STEPS_PER_STAGE == 0 and level < depth:
            rows = staged(rows.where(finished | (F.col("open") & container)), "nested")
            goes_on = F.col("open") & container
            part = rows.where(~goes_on)
            done = part if done is None else done.unionByName(part)
            rows = rows.where(goes_on)
    rows = rows if done is None else done.unionByName(rows)
    return rows.where(finished).select(key, "path", "parent_path", "ordinal", F.col("v").alias("value"), "is_object")


def child_records(decoded: DataFrame, key: str, column: str, depth: int) -> DataFrame:
    """``record_rows`` with surrogate keys: record_key and, for all but the root, the parent_key of the enclosing object."""
    rows = record_rows(decoded, key, depth)
    return rows.select(
        F.md5(F.concat_ws("|", F.col(key), F.col("path"))).alias("record_key"),
        F.when(F.col("path") != column, F.md5(F.concat_ws("|", F.col(key), F.coalesce("parent_path", F.lit(column))))).alias("parent_key"),
        key, "path", "parent_path", "ordinal", "value", "is_object",
    )


def decoded_records(df: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """The fragments of a column, staged, and their greatest depth (one number from a distributed maximum)."""
    rows = df.select(key, F.explode(decode_json(column, column)).alias("f")).select(key, "f.*")
    decoded = staged(rows, "decoded")
    return decoded, decoded.agg(F.max("depth")).first()[0] or 0


def element_paths(
    nodes: DataFrame,
    key: str = "node_id",
    time: str = "ingested_at",
    arrays: tuple[str, ...] = ("documents", "contexts"),
    column: str = "metadata",
) -> DataFrame:
    """(key, path) of every array element and every nested object of the latest row of every key.

    Null and empty arrays, null elements, and null, blank or invalid JSON give no rows; a
    null key is skipped. Other columns are ignored; an empty table gives no rows.
    """
    last = staged(latest_rows(nodes, key, time, [*arrays, column]), "latest")
    decoded, depth = decoded_records(last, key, column)
    records = child_records(decoded, key, column, depth)
    out = records.where(F.col("is_object") & F.col("parent_key").isNotNull()).select(key, "path")
    for a in arrays:
        out = out.unionByName(array_rows(last, key, a).select(key, "path"))
    return out


def path_pattern(path: Column, map_key: str = r"[^.\[\]]*\d{4,}[^.\[\]]*") -> Column:
    """A path without array positions; keys that look like identifiers (``map_key``) become ``*``."""
    p = F.regexp_replace(path, r"\[\d+\]", "[]")
    return F.regexp_replace(p, r"(?<=\.)" + map_key + r"(?=$|[.\[])", "*")


def merged_schema(rows: DataFrame) -> DataFrame:
    """(pattern, field, types, n_rows): fields of all objects of one pattern with every type seen.

    Array elements that are no objects have a null field and their own types.
    """
    rows = rows.select(path_pattern(F.col("path")).alias("pattern"), "value", F.expr("try_cast(value as map<string, variant>)").alias("m"))
    fields = rows.select("pattern", F.when(F.col("m").isNull(), F.col("value")).alias("scalar"), F.explode_outer(F.map_entries("m")).alias("e"))
    return fields.groupBy(
        "pattern",
        F.when(F.col("e.key").rlike(r"\d{4,}"), "*").otherwise(F.col("e.key")).alias("field"),
    ).agg(
        F.array_sort(F.collect_set(F.expr("split(schema_of_variant(coalesce(e.value, scalar)), '[<(]')[0]"))).alias("types"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def child_rows(records: DataFrame, key: str) -> DataFrame:
    """The flat tables of all patterns in long form: one row per field of an object and per other array element.

    ``field`` is null for elements that are no objects and for objects without fields;
    ``value`` is text (numbers without trailing zeros), null for a JSON null and for a container, whose content has rows of its own. Keys are those of ``child_records``.
    """
    m = F.expr("try_cast(value as map<string, variant>)")
    rows = records.select("record_key", "parent_key", key, "path", "ordinal", m.alias("m"), "value").select(
        "record_key", "parent_key", key, "path", path_pattern(F.col("path")).alias("pattern"), "ordinal",
        F.when(F.col("m").isNull(), F.col("value")).alias("scalar"), F.explode_outer(F.map_entries("m")).alias("e"),
    )
    return rows.withColumn("x", F.coalesce("e.value", "scalar")).select(
        "record_key", "parent_key", key, "path", "pattern", "ordinal", F.col("e.key").alias("field"),
        F.expr("if(schema_of_variant(x) rlike '^(OBJECT|ARRAY|VOID)', null, try_variant_get(x, '$', 'string'))").alias("value"),
    )


def child_table(records: DataFrame, key: str, pattern: str, fields: list[str]) -> DataFrame:
    """The flat table of one pattern: surrogate keys, ordinal and the named scalar fields as text; an absent field is null."""
    rows = records.where(F.col("is_object") & (path_pattern(F.col("path")) == pattern))
    return rows.select(
        "record_key", "parent_key", key, "path", "ordinal", *[F.expr(f"try_variant_get(value, '$.{f}', 'string')").alias(f) for f in fields],
    )
