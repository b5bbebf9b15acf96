"""Edge construction and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.text import edge_id
from knotwork.operators.nested import latest_rows, merged_metadata, metadata_json

# Relations and their inverses.
INVERSE = {
    "WORKS_FOR": "EMPLOYS", "LOCATED_IN": "CONTAINS", "PART_OF": "HAS_PART",
    "CREATOR_OF": "CREATED_BY", "OWNER_OF": "OWNED_BY", "PARENT_OF": "CHILD_OF",
}
EDGE_COLUMNS = ["source_id", "target_id", "type", "confidence", "occurrences", "documents", "bidirectional"]
LINK = ["edge_id", "source_id", "target_id", "type"]


def live_edges(log: DataFrame, first: int | None = None) -> DataFrame:
    """The latest row of every edge_id with trimmed lower-case references; rows without one are dropped.

    With ``first`` only so many of the EDGE_COLUMNS are shuffled and given; as ties go by content
    in the order of the columns, the values are the same.
    """
    e = latest_rows(log, "edge_id", "ingested_at", EDGE_COLUMNS[:first])
    for c in ("source_id", "target_id"):
        e = e.withColumn(c, F.lower(F.trim(c)))
    return e.where("source_id <> '' and target_id <> ''")


def build_edges(relations: DataFrame, nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges of relations (source, source_type, target, target_type, relationship, confidence, bidirectional, document_id).

    Dropped: missing parts, confidence below ``threshold`` (null counts as 1), endpoints
    without a node of that text (ignoring case) and type, and self-loops.
    """
    n = nodes.groupBy(F.lower("text").alias("folded"), "type").agg(F.min("node_id").alias("id"))
    s = n.select(F.col("folded").alias("sf"), F.col("type").alias("source_type"), F.col("id").alias("source_id"))
    t = n.select(F.col("folded").alias("tf"), F.col("type").alias("target_type"), F.col("id").alias("target_id"))
    r = relations.where("source is not null and target is not null and relationship is not null")
    r = r.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).where(F.col("confidence") >= threshold)
    r = r.withColumn("sf", F.lower("source")).withColumn("tf", F.lower("target"))
    e = r.join(s, ["sf", "source_type"]).join(t, ["tf", "target_type"]).where("source_id <> target_id")
    return e.select(
        edge_id(F.col("source_id"), F.col("target_id"), F.col("relationship")).alias("edge_id"), "source_id", "target_id",
        F.col("relationship").alias("type"), "confidence", F.lit(1).cast("long").alias("occurrences"),
        F.array("document_id").alias("documents"), F.coalesce("bidirectional", F.lit(False)).alias("bidirectional"),
    )


def with_inverse(edges: DataFrame) -> DataFrame:
    """The edges and, for bidirectional ones whose type has an inverse, the inverse edges."""
    pairs = [x for a, b in [*INVERSE.items(), *((b, a) for a, b in INVERSE.items())] for x in (F.lit(a), F.lit(b))]
    inv = edges.where("bidirectional").withColumn("inv", F.create_map(*pairs)[F.col("type")]).where("inv is not null")
    inv = inv.select(
        edge_id(F.col("target_id"), F.col("source_id"), F.col("inv")).alias("edge_id"), F.col("target_id").alias("source_id"),
        F.col("source_id").alias("target_id"), F.col("inv").alias("type"), "confidence", "occurrences", "documents", "bidirectional",
    )
    return edges.select(*inv.columns).unionByName(inv)


def _united(edges: DataFrame, key: list[str], extra: dict[str, Column]) -> DataFrame:
    """Edges of equal ``key`` as one: documents united, occurrences summed, ``extra`` minima; metadata merged where there is any.

    Documents are exploded and combined per (key, document) first, so an edge that many
    documents name is spread before its rows come together.
    """
    h = F.xxhash64(*key)
    rows = edges.withColumns({n: c for n, c in extra.items()}).select("*", h.alias("_h"), F.posexplode_outer("documents").alias("_at", "_doc"))
    once = F.coalesce("_at", F.lit(0)) == 0
    per = rows.groupBy("_h", *key, "_doc").agg(
        F.sum(F.when(once, F.coalesce("occurrences", F.lit(1)))).alias("occurrences"), F.count(F.when(once, F.lit(1))).alias("merged"),
        F.max("confidence").alias("confidence"), F.max("bidirectional").alias("bidirectional"), *[F.min(n).alias(n) for n in extra],
    )
    out = per.groupBy("_h", *key).agg(
        F.max("confidence").alias("confidence"), F.sum("occurrences").alias("occurrences"), F.array_sort(F.collect_set("_doc")).alias("documents"),
        F.max("bidirectional").alias("bidirectional"), F.sum("merged").alias("merged"), *[F.min(n).alias(n) for n in extra],
    )
    if "metadata" in edges.columns:
        merged = metadata_json(merged_metadata(edges.withColumn("_h", h), "_h", "metadata"), ["_h"])
        out = out.join(merged, "_h", "left")
    return out.drop("_h")


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One edge per edge_id: sum of occurrences, greatest confidence, all documents, merged metadata (where the table has it)."""
    return _united(edges, LINK, {}).drop("merged")


def merge_parallel(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, type, ...): parallel edges as the one of greatest confidence, then smallest id."""
    best = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "edge_id")
    out = _united(edges, LINK[1:], {"_best": best})
    own = ["occurrences", "documents", "merged", *[c for c in out.columns if c == "metadata"]]
    return out.select(F.col("_best.edge_id").alias("edge_id"), "source_id", "target_id", "type", (-F.col("_best.c")).alias("confidence"), *own)


def remove_edges(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges without those of ``ids`` (edge_id), and (removed): how many went; unknown and null ids remove nothing."""
    ids = ids.select("edge_id").distinct()
    gone = edges.join(ids, "edge_id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return edges.join(ids, "edge_id", "left_anti"), gone


def confident(edges: DataFrame, least: float) -> DataFrame:
    """Edges of at least this confidence; null counts as 0."""
    return edges.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def confidence_cut(edges: DataFrame, least: float) -> DataFrame:
    """(kept, removed): how many edges ``confident`` keeps and removes."""
    keeps = F.coalesce("confidence", F.lit(0.0)) >= least
    return edges.agg(F.count(F.when(keeps, F.lit(1))).alias("kept"), F.count(F.when(~keeps, F.lit(1))).alias("removed"))


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between the nodes of ``pairs`` (a, b), in either direction."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return edges.join(both, (edges["source_id"] == both["a"]) & (edges["target_id"] == both["b"]), "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """(node_id, direction, edge_id, neighbour_id, type, confidence): edges at both ends; a self-loop counts as outgoing."""
    out = edges.select(F.col("source_id").alias("node_id"), F.lit("outgoing").alias("direction"), "edge_id", F.col("target_id").alias("neighbour_id"), "type", "confidence")
    into = edges.where("source_id <> target_id").select(F.col("target_id").alias("node_id"), F.lit("incoming").alias("direction"), "edge_id", F.col("source_id").alias("neighbour_id"), "type", "confidence")
    return out.unionByName(into)
