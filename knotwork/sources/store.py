"""Tables of the engine in a folder: plain Parquet, partitioned by batch, and JSON exchange.

Rows are only ever appended, batch by batch; a batch that is written again replaces its own
partitions. Of a document the rows of its latest complete batch count, which the documents
table, written last, names. Nodes and edges are not stored but derived from the mentions and
relations that count, so nothing is added twice and spellings that differ in case meet
whatever batch they came with.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import schemas
from knotwork.operators.edges import build_edges, upsert_edges, with_inverse
from knotwork.operators.graph import entity_chunk_links
from knotwork.operators.resolve import upsert_nodes


class Store:
    """A folder of tables with one writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, force: bool = False) -> None:
        """Empty tables where there are none; with ``force`` instead of those there are."""
        for name, schema in schemas.TABLES.items():
            empty = self.spark.createDataFrame([], f"{schema}, batch bigint")
            empty.write.mode("overwrite" if force else "ignore").partitionBy("batch").parquet(f"{self.path}/{name}")

    def log(self, name: str) -> DataFrame:
        """All rows of a table, of every batch."""
        self.create()
        return self.spark.read.schema(f"{schemas.TABLES[name]}, batch bigint").parquet(f"{self.path}/{name}")

    def batch_of(self, origin: str | None) -> int:
        """The number of the batch of an origin that was seen before, else a new number, which is noted first."""
        seen = self.log("batches")
        known = seen.where(F.col("origin") == origin).agg(F.max("batch")).first()[0] if origin is not None else None
        if known is not None:
            return known
        new = (seen.agg(F.max("batch")).first()[0] or 0) + 1
        self.append("batches", self.spark.createDataFrame([(origin,)], schemas.BATCHES), new)
        return new

    def append(self, name: str, rows: DataFrame, batch: int) -> None:
        """Write the rows of a batch, in place of those that an earlier attempt left. Missing columns are null."""
        empty = self.spark.createDataFrame([], schemas.TABLES[name])
        rows = empty.unionByName(rows.select(*[c for c in rows.columns if c in empty.columns]), allowMissingColumns=True)
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def current(self) -> DataFrame:
        """(document_id, batch): the latest batch of every document that is not deleted."""
        last = self.log("documents").groupBy("document_id").agg(F.max(F.struct("batch", "deleted")).alias("l"))
        return last.where(~F.coalesce("l.deleted", F.lit(False))).select("document_id", F.col("l.batch").alias("batch"))

    def read(self, name: str) -> DataFrame:
        """The rows of a table that count; ``nodes``, ``edges`` and ``links`` are derived."""
        if name == "nodes":
            return upsert_nodes(self.read("mentions"))
        if name == "edges":
            return upsert_edges(with_inverse(build_edges(self.read("relations"), self.read("nodes"), 0.0)))
        if name == "links":
            return entity_chunk_links(self.read("nodes"), self.read("chunks"))
        rows = self.log(name)
        live = rows.join(self.current(), ["document_id", "batch"], "left_semi")
        if "added" in rows.columns:  # rows that were added by hand belong to no document
            live = live.where(~F.coalesce("added", F.lit(False))).unionByName(rows.where("added").select(*live.columns))
        return live.drop("batch", "deleted")

    def delete(self, ids: DataFrame) -> None:
        """The documents of ``ids`` (document_id) count no longer, nor what was found in them."""
        self.append("documents", ids.select("document_id", F.lit(True).alias("deleted")).distinct(), self.batch_of(None))

    def clear(self) -> None:
        self.create(force=True)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, written by the executors."""
    df.write.mode("overwrite").json(path)


def read_graph_json(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    """Rows of a persisted ``{what: {id: record}}`` JSON file with the given record schema (DDL)."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"struct<{what}: map<string, struct<{schema}>>>")
    return text.select(F.explode(rows[what]).alias("key", "r")).select("r.*")


def network_document(nodes: DataFrame, edges: DataFrame, limit: int = 100_000) -> str:
    """A network of at most ``limit`` nodes and edges as one JSON text, for viewers; larger ones raise."""
    n, e = nodes.limit(limit + 1).toJSON().collect(), edges.limit(limit + 1).toJSON().collect()
    if max(len(n), len(e)) > limit:
        raise ValueError("too large for one file; use export_json")
    return json.dumps({"nodes": [json.loads(x) for x in n], "edges": [json.loads(x) for x in e]}, ensure_ascii=False)
