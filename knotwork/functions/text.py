"""Scalar text functions as Column builders, and the boundary-aware chunker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.ArrayType(T.StructType([
    T.StructField("chunk_index", T.IntegerType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("content", T.StringType()),
]))


def node_id(text: Column, kind: Column) -> Column:
    return F.md5(F.concat(text, F.lit("_"), kind))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.md5(F.concat(source, F.lit("_"), target, F.lit("_"), kind))


def uuid5(seed: Column) -> Column:
    """UUID version 5 of a string in the all-zero namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("0" * 32)), F.encode(seed, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def segments(text: Column) -> Column:
    """Sentence segments: split after ., ! or ? and white space; a trailing empty segment stays."""
    return F.split(text, r"[.!?]\s+", -1)


def char_ngrams(s: Column, n: int = 3) -> Column:
    """Distinct character n-grams; of strings shorter than n the distinct characters."""
    width = F.when(F.length(s) >= n, F.lit(n)).otherwise(F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - width + 1), lambda i: F.substring(s, i, width))
    return F.when(F.length(s) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def pair_ngrams(a: Column, b: Column, n: int = 3) -> tuple[Column, Column]:
    """n-grams of both strings; the distinct characters of both if either is shorter than n."""
    short = F.least(F.length(a), F.length(b)) < n
    chars = [F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")) for x in (a, b)]
    return tuple(F.when(short, c).otherwise(char_ngrams(x, n)) for x, c in zip((a, b), chars, strict=True))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return jaccard(*pair_ngrams(a, b))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def first_json_array(reply: Column) -> Column:
    """The first JSON array of objects inside a free-text reply, as text; null if there is none."""
    found = F.regexp_extract(reply, r"(?s)\[\s*\{.*\}\s*\]", 0)
    return F.when(found != "", found)


def chunk_spans(n: int, text: str, size: int, overlap: int, tail: str = "stop") -> list[tuple[int, int]]:
    """Start and end of the windows over a text of n characters.

    A window that is not the last ends just past the first blank line near its end, else
    the first sentence end, else the first blank. ``tail='every_start'`` goes on until the
    start has passed the end of the text, which yields one suffix per remaining start.
    """
    spans, start = [], 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            for mark, before, after in (("\n\n", overlap, overlap), (". ", overlap, 50), (" ", 20, 20)):
                at = text.find(mark, max(0, end - before), end + after)
                if at > 0:
                    end = at + len(mark)
                    break
        spans.append((start, end))
        if end >= n and tail == "stop":
            break
        start = max(end - overlap, start + 1)
    return spans


def chunks(text: Column, size: int = 1000, overlap: int = 200, tail: str = "stop") -> Column:
    """array<struct<chunk_index, start, stop, content>>; null and empty texts give an empty array."""

    @F.pandas_udf(CHUNK)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                rows: list[dict] = []
                if t and len(t) <= size:
                    rows = [{"chunk_index": 0, "start": 0, "stop": len(t), "content": t}]
                elif t:
                    for a, b in chunk_spans(len(t), t, size, overlap, tail):
                        if t[a:b].strip():
                            rows.append({"chunk_index": len(rows), "start": a, "stop": b, "content": t[a:b].strip()})
                out.append(rows)
            yield pd.Series(out)

    return cut(text)


def where(filters: dict | None) -> Column:
    """The conjunction of equality filters and {field: {operator: value}} filters."""
    out = F.lit(True)
    for field, value in (filters or {}).items():
        conditions = value if isinstance(value, dict) else {"Equal": value}
        for operator, v in conditions.items():
            c = F.col(field)
            out = out & {
                "Equal": lambda c=c, v=v: c == F.lit(v), "NotEqual": lambda c=c, v=v: c != F.lit(v),
                "GreaterThan": lambda c=c, v=v: c > F.lit(v), "GreaterThanEqual": lambda c=c, v=v: c >= F.lit(v),
                "LessThan": lambda c=c, v=v: c < F.lit(v), "LessThanEqual": lambda c=c, v=v: c <= F.lit(v),
                "Like": lambda c=c, v=v: c.like(v.replace("*", "%").replace("?", "_")),
            }[operator]()
    return out
