"""Streaming ingestion: micro-batches of documents upserted into a store, and windowed mention counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.config import Config
from knotwork.operators.extract import rule_mentions
from knotwork.plans.pipeline import ingest
from knotwork.sources.store import Store


def ingest_stream(documents: DataFrame, store: Store, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Write every micro-batch of a documents stream (document_id, text) into the store.

    A micro-batch is named by the checkpoint and its number, so one that is repeated after a
    failure is written again in its own place.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            ingest(store, batch, config, origin=f"{checkpoint}#{number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_mentions(documents: DataFrame, time: str, types: tuple[str, ...], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, type, n): mentions per window of event time, for batch or stream; later rows than ``late`` are dropped."""
    docs = documents.select(F.col("document_id"), "text", F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    tagged = docs.select(F.concat_ws("|", F.col("at").cast("string"), "document_id").alias("document_id"), "text")
    m = rule_mentions(tagged, types).select(F.split("document_id", r"\|")[0].cast("timestamp").alias("at"), "type")
    return m.groupBy(F.window("at", window).alias("window"), "type").agg(F.count(F.lit(1)).alias("n"))
