"""Passages of evaluation items inside training documents.

Texts are reduced to their letters, digits and combining marks in one consistent form. The
hashes of all windows of ``window`` characters of the items form a set that is broadcast
(in blocks of items, so that each broadcast stays under a byte bound); every window of
every document is looked up and hits are verified on the characters themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.lookalike import confusable_letters, joined_sequences, single_classes, use

WINDOW = 60
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FILTER_BITS = 22
BYTES_PER_WINDOW = 24

SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
])


@lru_cache(1)
def kept() -> np.ndarray:
    """True for the code points of letters, digits and combining marks."""
    return np.array([unicodedata.category(chr(i))[0] in "LNM" for i in range(0x110000)])


def stream(text: str) -> np.ndarray:
    """Code points of the letters, digits and marks of a text in one consistent form."""
    s = joined_sequences(single_classes(text).casefold())
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return cp[kept()[cp]]


def traced(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``stream``, with the start and the end of the piece of ``text`` that every code point comes from.

    Pieces are letters with their marks. Where these, taken one by one, read otherwise than
    the whole text, the pieces are what stands between white space, so a place is exact to a
    word; where even these do, the whole text is one piece.
    """
    whole = stream(text)
    for pattern in (r"[^\W_][^\w\s]*|.", r"\S+", r".+"):
        chars, starts, ends = [], [], []
        for m in re.finditer(pattern, text, re.DOTALL):
            s = single_classes(m.group()).casefold()
            chars.append(s)
            starts += [m.start()] * len(s)
            ends += [m.end()] * len(s)
        s = "".join(chars)
        joined, first, last, at = joined_sequences(s), [], [], 0
        for c in joined:  # a joined sequence is shorter than what it stands for
            width = 1 if at < len(s) and s[at] == c else 2
            first.append(starts[min(at, len(s) - 1)])
            last.append(ends[min(at + width, len(s)) - 1])
            at += width
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        keep = kept()[cp]
        if np.array_equal(cp[keep], whole):
            break
    return whole, np.array(first, dtype=np.int64)[keep], np.array(last, dtype=np.int64)[keep]


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, dtype=np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE_INVERSE, dtype=np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


def window_hashes(cp: np.ndarray, window: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of every run of ``window`` code points."""
    if len(cp) < window:
        return np.empty(0, dtype=np.uint64)
    up, down = powers.of(len(cp))
    with np.errstate(over="ignore"):
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        prefix = np.r_[np.uint64(0), np.cumsum(mixed * up, dtype=np.uint64)]
        h = (prefix[window:] - prefix[:-window]) * down[: len(cp) - window + 1]
        return h ^ (h >> np.uint64(29))


class Passages:
    """The windows of a block of items: sorted hashes, owners, and a small first filter."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int) -> None:
        powers = Powers()
        self.window, self.ids, self.streams = window, [i for i, _ in items], [s for _, s in items]
        hashes = [window_hashes(s, window, powers) for s in self.streams]
        self.hash = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        self.place = np.concatenate([*map(np.arange, map(len, hashes)), np.empty(0, int)]).astype(np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.owner, self.place = self.hash[order], self.owner[order], self.place[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.hash & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, cp: np.ndarray, powers: Powers) -> list[tuple[int, int]]:
        """(item index, window start) of every verified common window of a stream."""
        h = window_hashes(cp, self.window, powers)
        maybe = np.flatnonzero(self.filter[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            return []
        lo = np.searchsorted(self.hash, h[maybe], "left")
        hi = np.searchsorted(self.hash, h[maybe], "right")
        out = []
        for at, a, b in zip(maybe[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
            for j in range(a, b):
                o, p = self.owner[j], self.place[j]
                if np.array_equal(self.streams[o][p : p + self.window], cp[at : at + self.window]):
                    out.append((int(o), int(at)))
        return out


def _runs(hits: list[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """(item index, first, last) of the maximal runs of overlapping windows."""
    out: list[list[int]] = []
    for o, at in sorted(set(hits)):
        if out and out[-1][0] == o and at <= out[-1][2]:
            out[-1][2] = at + window
        else:
            out.append([o, at, at + window])
    return [tuple(r) for r in out]


def leaked_spans(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, start, stop): passages of the items in the documents, as code point offsets.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. A
    passage has at least ``window`` consecutive letters, digits and marks in common. Null
    ids, null and short texts have none; repeated rows repeat their result; an empty table
    gives no rows. Items are a stated query set: where their windows exceed ``max_bytes``
    they are broadcast in blocks, each against all documents.
    """
    spark = docs.sparkSession
    more = confusable_letters(spark)
    use(more)
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    cost = items.agg(F.sum(F.length("text") * BYTES_PER_WINDOW)).first()[0] or 0
    n_blocks = int(cost // max_bytes) + 1

    def scan(block: DataFrame) -> DataFrame:
        known = Passages([(r["item_id"], stream(r["text"])) for r in block.collect()], window)
        shared = spark.sparkContext.broadcast(known)

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            passages, powers = shared.value, Powers()
            use(more)
            for pdf in batches:
                out = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    hits = passages.hits(stream(text), powers)
                    if hits:
                        _, starts, ends = traced(text)
                        out += [(doc_id, passages.ids[o], int(starts[a]), int(ends[b - 1])) for o, a, b in _runs(hits, window)]
                yield pd.DataFrame(out, columns=SPANS.fieldNames())

        return docs.mapInPandas(find, SPANS)

    found = scan(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == 0))
    for b in range(1, n_blocks):
        found = found.unionByName(scan(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)))
    return found


def without_leaks(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text): the documents with every leaked span removed; null texts stay null."""
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("cuts"))

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, c in zip(texts, cuts, strict=True):
            if t is not None and c is not None:
                at, parts = 0, []
                for s in c:
                    parts.append(t[at : max(at, s["start"])])
                    at = max(at, s["stop"])
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", "text").join(cuts, "doc_id", "left").select("doc_id", cut("text", "cuts").alias("text"))
