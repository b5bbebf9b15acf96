"""References to records that do not exist.

``orphan_references`` finds references whose parent was never registered, was deleted
before the reference was made, or was registered only later. A Bloom filter of the
parent keys is built in blocks on the executors, sized from the number of distinct keys. It
is broadcast when it stays under ``max_filter_bytes``; a larger one stays where it is, and
the distinct references are sent to its blocks. A reference the filter denies is a definite
orphan. Only filter-positive references take part in the exact as-of join.

The as-of join is salted by slots of time (hours), so a key that holds a third of all rows is
spread over all its slots: a first pass keeps the last version of a parent per slot and
carries it forward over the slots in which the key occurs, a second pass orders versions and
references inside one (key, slot).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS = 1 << 17  # one block of the filter: 16 KiB
HASHES = 7
GRAIN = "hour"  # the slots of time by which the as-of join is salted


def reference_key(c: Column) -> Column:
    """A reference without surrounding white space, in lower case; blank gives null."""
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def _bit_positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two step values of double hashing inside a block, from a 64-bit hash."""
    u = h.astype(np.uint64)
    a = (u >> np.uint64(20)) & np.uint64(BLOCK_BITS - 1)
    b = ((u >> np.uint64(41)) & np.uint64(BLOCK_BITS - 1)) | np.uint64(1)
    return a, b


def bloom_blocks(parents: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, bits) rows of a blocked Bloom filter; every block is built in its own group.

    Keys are reduced to distinct hashes first, so repeated keys combine before the shuffle.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK_BITS, dtype=bool)
        a, b = _bit_positions(pdf["h"].to_numpy())
        for i in range(HASHES):
            bits[((a + np.uint64(i) * b) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)] = True
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    return (
        parents.where(F.col(key).isNotNull())
        .select(F.xxhash64(F.col(key)).alias("h"))
        .distinct()
        .withColumn("block", F.pmod(F.col("h"), F.lit(n_blocks)).cast("int"))
        .groupBy("block")
        .applyInPandas(build, "block int, bits binary")
    )


def filter_blocks(n_keys: int, bits_per_key: int = 12) -> int:
    """Blocks needed for ``n_keys`` keys; below 1 % false positives with 7 hashes."""
    return max(1, math.ceil(n_keys * bits_per_key / BLOCK_BITS))


def _probe(h: np.ndarray, packed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether every bit of every hash is set in its block, a row of ``packed``."""
    a, b = _bit_positions(h)
    hit = np.ones(len(h), dtype=bool)
    for i in range(HASHES):
        p = (a + np.uint64(i) * b) & np.uint64(BLOCK_BITS - 1)
        byte = packed[row, (p >> np.uint64(3)).astype(np.int64)]
        hit &= (byte >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return hit


def might_exist(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Add ``maybe``: false where the filter proves that the key has no parent; the whole filter is broadcast.

    The collected filter has ``n_blocks`` times 16 KiB, which the caller has checked.
    """
    packed = np.zeros((n_blocks, BLOCK_BITS // 8), dtype=np.uint8)
    for r in blocks.collect():
        packed[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(T.BooleanType())
    def probe(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = shared.value
        for s in hashes:
            h = s.to_numpy()
            yield pd.Series(_probe(h, bits, np.mod(h, n_blocks)))

    return df.withColumn("maybe", probe(F.xxhash64(F.col(key))))


def might_exist_by_block(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """As ``might_exist`` for a filter of any size: the distinct keys go to the block of the filter that holds their bits.

    A key counts once however many rows have it, so a key that fills the table weighs nothing
    here; the answers are joined back to the rows (a skewed side is split by adaptive execution).
    """
    keys = df.select(key).distinct().select(key, F.xxhash64(F.col(key)).alias("h"))
    keys = keys.withColumn("block", F.pmod(F.col("h"), F.lit(n_blocks)).cast("int"))

    def probe(asked: pd.DataFrame, filled: pd.DataFrame) -> pd.DataFrame:
        if not len(filled):
            return pd.DataFrame({key: asked[key], "maybe": np.zeros(len(asked), dtype=bool)})
        bits = np.frombuffer(filled["bits"].iloc[0], dtype=np.uint8)[None, :]
        return pd.DataFrame({key: asked[key], "maybe": _probe(asked["h"].to_numpy(), bits, np.zeros(len(asked), dtype=np.int64))})

    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("maybe", T.BooleanType())])
    answers = keys.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(probe, schema)
    return df.join(answers, key)


def first_references(
    children: DataFrame, child_id: str, ref_fields: Sequence[str], time: str
) -> DataFrame:
    """(child_id, ref_field, ref, t): the references of the first row of every child.

    The first row has the smallest ``time`` (null times come last); among rows of one
    time the smallest references are taken, so the result does not depend on row order.
    """
    order = F.struct(
        F.col(time).isNull().alias("late"), F.col(time).alias("t"), *[F.col(f).alias(f) for f in ref_fields]
    )
    first = children.where(F.col(child_id).isNotNull()).groupBy(child_id).agg(F.min(order).alias("r"))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("ref_field"), reference_key(F.col(f"r.{f}")).alias("ref")) for f in ref_fields]
    )
    return (
        first.select(child_id, F.col("r.t").alias("t"), F.explode(pairs).alias("p"))
        .select(child_id, "p.ref_field", "p.ref", "t")
        .where(F.col("ref").isNotNull())
    )


def as_of_state(refs: DataFrame, parents: DataFrame, key: str, time: str, deleted: str) -> DataFrame:
    """Add ``state`` struct(ts, deleted_at) of the latest parent version with ts <= t, else null."""
    versions = parents.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("ref"), F.struct(F.col(time).alias("ts"), F.col(deleted).alias("deleted_at")).alias("version")
    )
    versions = versions.withColumn("slot", F.date_trunc(GRAIN, "version.ts"))
    daily = versions.groupBy("ref", "slot").agg(F.max("version").alias("version"))
    refs = refs.withColumn("slot", F.date_trunc(GRAIN, "t"))
    none = F.lit(None).cast(daily.schema["version"].dataType)
    days = (
        refs.select("ref", "slot").distinct().withColumn("version", none).unionByName(daily)
        .groupBy("ref", "slot").agg(F.max("version").alias("version"))
    )
    before = Window.partitionBy("ref").orderBy(F.col("slot").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        days.withColumn("version", F.last("version", ignorenulls=True).over(before))
        .where(F.col("version").isNotNull())
        .select("ref", "slot", "version")
    )
    own = [c for c in refs.columns if c not in ("ref", "slot")]
    empty = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in own]
    marks = versions.select("ref", "slot", "version").unionByName(carried).select("ref", "slot", "version", *empty)
    asked = refs.select("ref", "slot", none.alias("version"), *own)
    at = F.coalesce(F.col("version.ts"), F.col("t"))
    upto = (
        Window.partitionBy("ref", "slot")
        .orderBy(at.asc_nulls_last(), F.col("version").isNull(), F.col("version"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        asked.withColumn("asks", F.lit(True)).unionByName(marks.withColumn("asks", F.lit(False)))
        .withColumn("state", F.last("version", ignorenulls=True).over(upto))
        .where("asks")
        .select("ref", "state", *own)
    )


def judged_references(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str = "edge_id",
    ref_fields: Sequence[str] = ("source_id", "target_id"),
    parent_key: str = "node_id",
    time: str = "ingested_at",
    deleted: str = "deleted_at",
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """Every non-blank reference with its reason: ``missing``, ``late``, ``deleted`` or null.

    Columns: child_id, ref_field, ref, t, reason. ``missing``: the parent occurs nowhere;
    ``late``: only after t; ``deleted``: the latest version at t was deleted by then. Null
    and blank references and null child ids give no row. A null t is later than every time.
    Other columns of the tables are ignored. Empty tables give an empty result (no parents:
    every reference is ``missing``).
    """
    children = children.select(child_id, *ref_fields, time)
    parents = parents.select(parent_key, time, deleted)
    refs = first_references(children, child_id, ref_fields, time)
    n_keys = parents.agg(F.approx_count_distinct(parent_key, 0.02)).first()[0]
    n_blocks = filter_blocks(int(1.1 * n_keys))
    probe = might_exist if n_blocks * (BLOCK_BITS // 8) <= max_filter_bytes else might_exist_by_block
    refs = probe(refs, "ref", bloom_blocks(parents, parent_key, n_blocks), n_blocks)
    denied = refs.where(~F.col("maybe")).select(
        child_id, "ref_field", "ref", "t", F.lit("missing").alias("reason")
    )
    asked = refs.where("maybe").drop("maybe")
    known = parents.where(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("ref")).distinct()
    far = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00")).cast(children.schema[time].dataType)
    judged = as_of_state(asked.withColumn("at", F.col("t")).withColumn("t", F.coalesce("t", far)), parents, parent_key, time, deleted)
    gone = F.col("state.deleted_at") <= F.col("t")
    judged = judged.select(
        child_id, "ref_field", "ref", F.col("at").alias("t"),
        F.when(F.col("state").isNull(), "late").when(gone, "deleted").alias("reason"),
    )
    late = judged.where(F.col("reason") == "late")
    # the few filter errors among the unregistered ones are told apart from late parents
    late = late.join(known.withColumn("known", F.lit(True)), "ref", "left").select(
        child_id, "ref_field", "ref", "t", F.when(F.col("known"), "late").otherwise("missing").alias("reason")
    )
    rest = judged.where(F.col("reason").isNull() | (F.col("reason") != "late"))
    return denied.unionByName(late).unionByName(rest)


def orphan_references(children: DataFrame, parents: DataFrame, **options) -> DataFrame:
    """The references of ``judged_references`` that have no living parent at their time."""
    return judged_references(children, parents, **options).where(F.col("reason").isNotNull())


def orphan_report(orphans: DataFrame, table: str, time: str = "t") -> DataFrame:
    """(table_name, ref_field, period, reason, n_refs): orphans per field and month; a null time has a null period."""
    return orphans.groupBy(
        F.lit(table).alias("table_name"), "ref_field", F.date_format(time, "yyyy-MM").alias("period"), "reason"
    ).agg(F.count(F.lit(1)).alias("n_refs"))
