"""Entity resolution: exact and near duplicates, node upserts, merges and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.text import char_ngrams, node_id
from knotwork.operators.nested import latest_rows, merged_metadata, metadata_json
from knotwork.operators.retrieval import similarity_edges
from knotwork.runtime import staged

NODE_COLUMNS = ["text", "type", "occurrences", "documents", "contexts", "metadata", "deleted_at"]


def live_nodes(log: DataFrame) -> DataFrame:
    """The latest row of every node_id of the append log that is not deleted."""
    return latest_rows(log, "node_id", "ingested_at", NODE_COLUMNS).where("deleted_at is null").drop("deleted_at")


def resolve_exact(nodes: DataFrame) -> DataFrame:
    """(folded, type, canonical, n_nodes, occurrences): nodes of equal text, ignoring case, and type."""
    order = F.struct((-F.coalesce("occurrences", F.lit(0))).alias("o"), "node_id")
    return nodes.groupBy(F.lower("text").alias("folded"), "type").agg(
        F.min_by("node_id", order).alias("canonical"), F.count(F.lit(1)).alias("n_nodes"),
        F.sum(F.coalesce("occurrences", F.lit(0))).alias("occurrences"),
    )


def near_duplicates(texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(short, long, type, similarity): texts of one type of which one contains the other, by trigram Jaccard.

    ``texts``: text, type; compared in lower case. Every trigram of the contained text is
    one of the other, so the similarity is the ratio of their numbers of distinct trigrams:
    a short text meets only texts that hold its first trigram and one of the few numbers of
    trigrams that reach the threshold. Texts below three characters meet in the same way over
    characters.
    """
    t = texts.select(F.lower("text").alias("text"), "type").where(F.col("text") != "").distinct()
    tiny = F.length("text") < 3
    t = t.select("text", "type", char_ngrams(F.col("text")).alias("grams"), char_ngrams(F.col("text"), 1).alias("chars"))

    def side(grams: str, unit: int) -> Column:
        return F.struct(F.lit(unit).alias("unit"), F.col(grams).alias("grams"), F.size(grams).alias("n"))

    a = t.withColumn("s", F.when(tiny, side("chars", 1)).otherwise(side("grams", 3)))
    a = a.withColumn("m", F.explode(F.sequence(F.col("s.n"), F.floor(F.col("s.n") / threshold + 1e-9).cast("int"))))
    a = a.select(F.col("text").alias("short"), "type", F.col("s.unit").alias("unit"), F.col("s.grams")[0].alias("gram"), "m", F.col("s.n").alias("ns"))
    b = t.withColumn("s", F.explode(F.array(side("chars", 1), side("grams", 3))))
    b = b.where((F.col("s.unit") == 1) | (F.length("text") >= 3))
    b = b.select(F.col("text").alias("long"), "type", F.col("s.unit").alias("unit"), F.col("s.n").alias("m"), F.explode("s.grams").alias("gram"))
    pairs = a.join(b, ["type", "unit", "gram", "m"]).where("length(short) < length(long)").where(F.contains("long", "short"))
    return pairs.withColumn("similarity", F.col("ns") / F.col("m")).where(F.col("similarity") >= threshold).select("short", "long", "type", "similarity").distinct()


def canonical_near(texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(text, type, canonical): one-hop assignment of near duplicates to the most similar, then smallest, contained text."""
    found = near_duplicates(texts, threshold)
    w = Window.partitionBy("long", "type").orderBy(F.desc("similarity"), "short")
    best = found.withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select(F.col("long").alias("text"), "type", F.col("short").alias("canonical"))


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity): vectors of one type with a cosine of at least ``threshold``, a < b.

    ``vectors``: id, type, embedding. Blocks of vectors meet on a grid (see
    ``retrieval.similarity_edges``); vectors of different length, null and zero ones make no pair.
    """
    return similarity_edges(vectors, threshold, kind="type", strict=False)


def upsert_nodes(mentions: DataFrame) -> DataFrame:
    """Nodes of mentions: occurrences, distinct documents, contexts and metadata of every (text ignoring case, type).

    ``mentions``: document_id, text, type, start_pos, end_pos and, if there, metadata (JSON).
    The first mention in (document_id, start_pos, text) order gives the text and thereby the
    node_id. Mentions are combined per document first; ``mention_nodes`` gives the same links
    as a child table without any arrays.
    """
    rows = mentions.where(F.col("text").isNotNull() & F.col("type").isNotNull()).withColumn("folded", F.lower("text"))
    context = F.struct(F.col("document_id").alias("document"), "start_pos", "end_pos")
    per = rows.groupBy("folded", "type", "document_id").agg(
        F.min(F.struct("document_id", "start_pos", "text")).alias("first"), F.count(F.lit(1)).alias("occurrences"),
        F.array_sort(F.collect_list(context)).alias("contexts"),
    )
    n = per.groupBy("folded", "type").agg(
        F.min("first").alias("first"), F.sum("occurrences").alias("occurrences"),
        F.array_sort(F.collect_list("document_id")).alias("documents"),
        F.transform(F.array_sort(F.collect_list(F.struct("document_id", "contexts"))), lambda x: x["contexts"]).alias("contexts"),
    )
    n = n.select(
        "folded", node_id(F.col("first.text"), F.col("type")).alias("node_id"), F.col("first.text").alias("text"), "type", "occurrences",
        "documents", F.flatten("contexts").alias("contexts"),
    )
    if "metadata" not in mentions.columns:
        return n.drop("folded").withColumn("metadata", F.lit(None).cast("string"))
    m = metadata_json(merged_metadata(rows, ["folded", "type"], "metadata"), ["folded", "type"])
    return n.join(m, ["folded", "type"], "left").drop("folded")


def mention_nodes(mentions: DataFrame) -> DataFrame:
    """(node_id, document_id, start_pos, end_pos): the node of every mention; no row grows with a node's mentions."""
    rows = mentions.where(F.col("text").isNotNull() & F.col("type").isNotNull()).withColumn("folded", F.lower("text"))
    first = rows.groupBy("folded", "type").agg(F.min(F.struct("document_id", "start_pos", "text")).alias("f"))
    ids = first.select("folded", "type", node_id(F.col("f.text"), F.col("type")).alias("node_id"))
    return rows.join(ids, ["folded", "type"]).select("node_id", "document_id", "start_pos", "end_pos")


def distinct_elements(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): the distinct non-null elements of an array column over all rows of a key, sorted; exploded before they are grouped."""
    e = rows.select(key, F.explode(column).alias("e")).where("e is not null").distinct()
    return e.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias(column))


def merge_nodes(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the merge of ``aliases`` (alias, primary); a self-merge changes nothing.

    Merged nodes sum occurrences and unite documents and, where the table has them, contexts
    and metadata (see ``merged_metadata``); edges follow to the primary node, self-loops that
    arise are dropped, and edges that become equal are merged.
    """
    from knotwork.operators.edges import edge_id, upsert_edges

    al = aliases.where("alias <> primary").groupBy("alias").agg(F.min("primary").alias("primary"))
    n = nodes.join(al, nodes["node_id"] == al["alias"], "left").withColumn("to", F.coalesce("primary", "node_id"))
    own = F.col("node_id") == F.col("to")
    merged = n.groupBy("to").agg(
        F.coalesce(F.max(F.when(own, F.col("text"))), F.min("text")).alias("text"), F.coalesce(F.max(F.when(own, F.col("type"))), F.min("type")).alias("type"),
        F.sum(F.coalesce("occurrences", F.lit(0))).alias("occurrences"),
    )
    for column in ("documents", "contexts"):
        if column in nodes.columns:
            none = F.array().cast(nodes.schema[column].dataType)
            merged = merged.join(distinct_elements(n, "to", column), "to", "left").withColumn(column, F.coalesce(column, none))
    if "metadata" in nodes.columns:
        merged = merged.join(metadata_json(merged_metadata(n, "to", "metadata"), ["to"]), "to", "left")
    merged = merged.withColumnRenamed("to", "node_id")
    s = al.select(F.col("alias").alias("source_id"), F.col("primary").alias("s_to"))
    t = al.select(F.col("alias").alias("target_id"), F.col("primary").alias("t_to"))
    e = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    e = e.withColumn("source_id", F.coalesce("s_to", "source_id")).withColumn("target_id", F.coalesce("t_to", "target_id")).drop("s_to", "t_to")
    e = e.where("source_id <> target_id").withColumn("edge_id", edge_id(F.col("source_id"), F.col("target_id"), F.col("type")))
    return merged, upsert_edges(e)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of ``ids`` (node_id) and the edges that touch them."""
    ids = ids.select("node_id").distinct()
    e = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), e.join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")


def nodes_by_document(nodes: DataFrame) -> DataFrame:
    """(document, node_id, text, type): one row per node and distinct document."""
    d = F.array_distinct(F.filter("documents", lambda x: x.isNotNull()))
    return nodes.select(F.explode(d).alias("document"), "node_id", "text", "type")


def node_of_text(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, node_id): the node of every text, ignoring case; most occurrences, then the smallest id."""
    n = nodes.groupBy(F.lower("text").alias("folded")).agg(
        F.min(F.struct((-F.coalesce("occurrences", F.lit(0))).alias("o"), "node_id")).alias("b")
    )
    t = texts.select("text").distinct().withColumn("folded", F.lower("text"))
    return t.join(n, "folded").select("text", F.col("b.node_id").alias("node_id"))


def components(links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, root): connected components of links (a, b) by label propagation to the smallest id.

    Labels are staged after every round; only the number of changed labels reaches the driver.
    Runs until no label changes; more than ``most_rounds`` rounds are an error.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"), "labels")
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nxt = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved"))
        up = nxt.select(F.col("id").alias("root"), F.col("root").alias("above"))
        nxt = staged(nxt.join(up, "root", "left").select("id", F.least("root", F.coalesce("above", "root")).alias("root"), "moved"), "labels")
        label = nxt.select("id", "root")
        if nxt.where("moved").limit(1).count() == 0:
            return label
    raise RuntimeError("the components did not settle")
