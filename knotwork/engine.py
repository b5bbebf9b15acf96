"""One object over a store: ingestion, search, lookups, traversal, statistics and export."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.config import Config
from knotwork.functions.text import where
from knotwork.functions.vectors import embedded, hashing_embedder
from knotwork.operators import extract, graph, resolve, retrieval, stats
from knotwork.operators.edges import remove_edges
from knotwork.plans.pipeline import ingest
from knotwork.runtime import staged
from knotwork.sources.store import Store, export_json


class Engine:
    """The operators of the engine on the tables of a store."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embed: Callable[[str], list[float]] | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, path)
        self.embed = embed or hashing_embedder()

    def create(self, force: bool = False) -> None:
        """Empty tables where there are none; with ``force`` instead of those there are."""
        self.store.create(force)

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def add_documents(self, docs: DataFrame, terms: DataFrame | None = None) -> int:
        """Run the pipeline over documents (document_id, text), store them with their chunks' vectors, and give their batch."""
        return ingest(self.store, docs, self.config, terms, embed=self.embed)

    def delete_document(self, document_id: str) -> None:
        """Remove a document with its chunks, their vectors, its mentions, relations and links."""
        self.store.delete(self.spark.createDataFrame([(document_id,)], "document_id string"))

    def add_entity(self, text: str, kind: str, document: str | None = None, metadata: dict | None = None) -> None:
        """One more occurrence of an entity."""
        row = self.spark.createDataFrame(
            [(document, text, kind, json.dumps(metadata) if metadata else None, True)], "document_id string, text string, type string, metadata string, added boolean"
        )
        self.store.append("mentions", row, self.store.batch_of(None))

    def add_relationship(self, source: str, target: str, kind: str, confidence: float = 1.0, bidirectional: bool = False) -> None:
        """One more occurrence of a relation between the nodes of two texts; unknown texts and self-loops add nothing."""
        row = self.spark.createDataFrame([(source, target, kind, confidence, bidirectional, True)], "s string, t string, relationship string, confidence double, bidirectional boolean, added boolean")
        nodes = staged(self._table("nodes"), "nodes")
        ids = resolve.node_of_text(nodes, row.select(F.col("s").alias("text")).union(row.select("t")))
        ids = ids.join(nodes.select("node_id", F.col("text").alias("name"), "type"), "node_id")
        s = ids.select(F.col("text").alias("s"), F.col("name").alias("source"), F.col("type").alias("source_type"))
        t = ids.select(F.col("text").alias("t"), F.col("name").alias("target"), F.col("type").alias("target_type"))
        row = row.join(s, "s").join(t, "t").where("source <> target or source_type <> target_type").drop("s", "t")
        self.store.append("relations", row, self.store.batch_of(None))

    def remove_relationships(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The edges without those of ``ids`` (edge_id), and how many went; the store keeps what they were found in."""
        return remove_edges(self._table("edges"), ids)

    def search(self, queries: DataFrame, limit: int | None = None, alpha: float | None = None, filters: dict | None = None, use_graph: bool = True) -> DataFrame:
        """(query_id, document_id, result_type, rank) of queries (query_id, text).

        Chunks are ranked by keywords and vectors (alpha 0: keywords only, 1: vectors only),
        documents by their best chunk; documents found over the graph follow.
        """
        limit, alpha = limit or self.config.search_limit, self.config.alpha if alpha is None else alpha
        c = self._table("chunks").where(where(filters))
        text = c.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
        v = self._table("embeddings").join(c.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        q = queries.select("query_id", embedded(F.col("text"), self.embed).alias("embedding"))
        words = retrieval.keyword_top(queries, text, 5 * limit)
        best = retrieval.fused(retrieval.nearest(q, v, 5 * limit), words, alpha, 5 * limit).where("score > 0")
        docs = best.join(c.select(F.col("chunk_id").alias("id"), "document_id"), "id").groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
        hits = staged(retrieval.ranked(docs.withColumnRenamed("document_id", "id"), "score", limit).withColumnRenamed("id", "document_id"), "hits")
        if not use_graph:
            return hits.select("query_id", "document_id", F.lit("vector").alias("result_type"), "rank")
        m = extract.rule_mentions(queries.select(F.col("query_id").cast("string").alias("document_id"), "text"), ("PERSON", "ORGANIZATION", "EMAIL", "PHONE"))
        m = m.select(F.col("document_id").alias("query_id"), "text", "type")
        hits = hits.withColumn("query_id", F.col("query_id").cast("string"))
        nodes, edges = staged(self._table("nodes"), "nodes"), staged(self._table("edges"), "edges")
        return retrieval.graph_augmented(hits, m, nodes, edges, limit, self.config.confidence_threshold)

    def search_entities(self, text: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
        return graph.query_entities(self._table("nodes"), text, kind, None, limit, self.config.case_sensitive)

    def get_document(self, document_id: str) -> tuple[DataFrame, DataFrame]:
        """Chunks of a document in their order, and its entities."""
        c = self._table("chunks").where(F.col("document_id") == document_id).orderBy("chunk_index")
        return c, resolve.nodes_by_document(self._table("nodes")).where(F.col("document") == document_id)

    def get_entity(self, text: str) -> tuple[DataFrame, DataFrame]:
        """Documents and relationships of the entity of a text."""
        nodes = self._table("nodes")
        ids = resolve.node_of_text(nodes, self.spark.createDataFrame([(text,)], "text string"))
        docs = resolve.nodes_by_document(nodes).join(ids.select("node_id"), "node_id", "left_semi")
        return docs, graph.entity_relationships(self._table("edges"), nodes, ids)

    def paths(self, source: str, target: str, depth: int | None = None, every: bool = False) -> DataFrame:
        """A shortest path between two texts, or every simple path."""
        ids = resolve.node_of_text(self._table("nodes"), self.spark.createDataFrame([(source,), (target,)], "text string"))
        s = ids.where(F.col("text") == source).select(F.col("node_id").alias("source"))
        t = ids.where(F.col("text") == target).select(F.col("node_id").alias("target"))
        most = (depth or self.config.path_depth, self.config.confidence_threshold)
        if every:
            return graph.simple_paths(self._table("edges"), s.withColumnRenamed("source", "node_id"), t.withColumnRenamed("target", "node_id"), *most)
        return graph.shortest_paths(self._table("edges"), s.join(t, F.lit(True)), *most)  # one row each

    def network(self, text: str) -> tuple[DataFrame, DataFrame]:
        ids = resolve.node_of_text(self._table("nodes"), self.spark.createDataFrame([(text,)], "text string"))
        return graph.ego_network(
            self._table("edges"), self._table("nodes"), ids.select("node_id"), self.config.ego_depth,
            self.config.confidence_threshold, self.config.ego_nodes,
        )

    def statistics(self) -> DataFrame:
        """Graph and store statistics in one table (metric, value)."""
        nodes, edges = staged(self._table("nodes"), "nodes"), staged(self._table("edges"), "edges")
        chunks = self._table("chunks").withColumn("document_type", F.lit("text"))
        s = stats.store_statistics(chunks, nodes, edges).select("metric", F.col("value").cast("double").alias("value"))
        return graph.statistics(nodes, edges).unionByName(s.where("metric <> 'documents'"))

    def export(self, path: str) -> None:
        nodes = self._table("nodes")
        export_json(graph.export_nodes(nodes), f"{path}/nodes")
        export_json(graph.export_edges(self._table("edges"), nodes), f"{path}/edges")

    def clear(self) -> None:
        self.create(force=True)
