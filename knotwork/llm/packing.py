"""Fill windows of fixed token capacity with documents, neighbours first.

Every document is tokenised once; its token ids are hashed to signs and summed to a vector
of few dimensions, whose direction gives a key on a Hilbert curve. Documents are sorted by
that key across the cluster and packed, block of neighbours by block of neighbours, by best
fit decreasing. A document is split only if it alone exceeds the capacity.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.runtime import staged

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
DIMENSIONS, BITS = 3, 10

MEASURED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("curve", T.LongType()),
])
PACKED = T.StructType([
    T.StructField("window_name", T.StringType()), T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.LongType()), T.StructField("first_token", T.LongType()),
    T.StructField("tokens", T.LongType()), T.StructField("window_id", T.StringType()),
])
_ENCODERS: dict[str, object] = {}


def encoder(path: str | None):
    """The tokenizer of a vocabulary file of byte-pair ranks; loaded once per worker."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, dimensions) with ``bits`` bits each."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the turns, from the highest bit down
        for i in range(n):
            turn = (x[i] & q) > 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turn, x[0] ^ (q - 1), x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of the directions of vectors; the zero vector lies in the middle."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    return hilbert_key(np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def token_signs(ids: np.ndarray) -> np.ndarray:
    """A fixed vector of signs for every token id, from bits of a multiplicative hash."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.stack([((h >> np.uint64(7 * i + 5)) & np.uint64(1)).astype(np.int64) * 2 - 1 for i in range(DIMENSIONS)], axis=1)


def measured(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, tokens, curve): token count and curve key of every document; null and empty texts have 0 tokens."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for pdf in batches:
            sizes, vectors = [], []
            for t in pdf["text"]:
                ids = np.array(e.encode_ordinary(t) if t else [], dtype=np.int64)
                sizes.append(len(ids))
                vectors.append(token_signs(ids).sum(axis=0))
            if len(pdf):
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": sizes, "curve": curve_keys(np.array(vectors, dtype=float))})

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(measure, MEASURED)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of every item by best fit decreasing; ties keep the order of the items."""
    free: list[tuple[int, int]] = []  # (space left, bin), ascending
    out, n = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        j = bisect_left(free, (sizes[i], -1))
        if j < len(free):
            left, b = free.pop(j)
        else:
            left, b, n = capacity, n, n + 1
        out[i] = b
        insort(free, (left - sizes[i], b))
    return out


def packed(docs: DataFrame, windows: DataFrame, *, tokenizer: str | None = None, block_windows: int = 256, block_items: int = 2048) -> DataFrame:
    """(window_name, doc_id, piece, first_token, tokens, window_id): the window of every piece of every document.

    ``docs`` has doc_id and text, ``windows`` window_name and capacity_tokens (a table of a
    few rows, read to the driver up to 1000 rows); other columns are ignored. Documents up
    to the capacity are one piece; a longer one fills whole windows of its own, and its rest
    is packed with the others. Null and empty texts have 0 tokens and get a window too. A
    repeated doc_id counts once, with its most tokens; null ids and windows without a
    positive capacity are skipped; an empty table gives no rows. Blocks hold at least
    ``block_items`` documents and ``block_windows`` windows' worth of tokens, so that the
    last, partly filled window of a block weighs little. A window is named by its first piece.
    """
    sizes = staged(measured(docs, tokenizer).groupBy("doc_id").agg(F.max(F.struct("tokens", "curve")).alias("m")), "sizes")
    kinds = windows.select("window_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    kinds = kinds.where("capacity > 0 and window_name is not null").limit(1001).collect()
    if len(kinds) > 1000:
        raise ValueError("more than 1000 windows")
    capacity = {r["window_name"]: r["capacity"] for r in kinds}
    if not capacity:
        return docs.sparkSession.createDataFrame([], PACKED)
    names = F.explode(F.array(*[F.lit(n) for n in sorted(capacity)])).alias("window_name")
    sizes = sizes.select(names, "doc_id", "m.*")
    order = ["window_name", "curve", "doc_id"]
    # equal documents have equal keys; doc_id spreads them over the ranges
    sizes = sizes.repartitionByRange(*order).sortWithinPartitions(*order)

    def block(name: str, items: list[tuple[int, int]]) -> pd.DataFrame:
        room, rows, small = capacity[name], [], []
        for doc, n in items:
            whole = (n - 1) // room if n > room else 0
            rows += [(name, doc, p, p * room, room, f"{name}:{doc}:{p}") for p in range(whole)]
            small.append((doc, whole, whole * room, n - whole * room))
        bins = best_fit([s[3] for s in small], room)
        first: dict[int, str] = {}
        for (doc, piece, at, n), b in zip(small, bins, strict=True):
            rows.append((name, doc, piece, at, n, first.setdefault(b, f"{name}:{doc}:{piece}")))
        return pd.DataFrame(rows, columns=PACKED.fieldNames())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, items, total = None, [], 0
        for pdf in batches:
            for w, doc, n in zip(pdf["window_name"], pdf["doc_id"], pdf["tokens"], strict=True):
                full = name is not None and len(items) >= block_items and total >= block_windows * capacity[name]
                if items and (w != name or full):
                    yield block(name, items)
                    items, total = [], 0
                name = w
                items.append((doc, n))
                total += n
        if items:
            yield block(name, items)

    return sizes.mapInPandas(pack, PACKED)


def fill(pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, n_windows, n_tokens, used): share of the capacity in use per kind of window."""
    kinds = windows.select("window_name", F.col("capacity_tokens").alias("capacity")).distinct()
    w = pieces.groupBy("window_name", "window_id").agg(F.sum("tokens").alias("t"))
    w = w.groupBy("window_name").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("t").alias("n_tokens"))
    return w.join(F.broadcast(kinds), "window_name").select(
        "window_name", "n_windows", "n_tokens", (F.col("n_tokens") / F.col("n_windows") / F.col("capacity")).alias("used")
    )
