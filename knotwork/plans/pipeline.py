"""The document pipeline: chunks, mentions, nodes, relations, edges and links in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.config import Config
from knotwork.functions.text import chunks, uuid5
from knotwork.functions.vectors import embedded
from knotwork.operators import edges as E
from knotwork.operators import extract, graph, relate, resolve
from knotwork.runtime import staged
from knotwork.sources.store import Store


def process_documents(docs: DataFrame, config: Config | None = None, terms: DataFrame | None = None, types: tuple[str, ...] = ("PERSON", "ORGANIZATION", "EMAIL", "PHONE", "DATE", "URL")) -> dict[str, DataFrame]:
    """Tables chunks, mentions, relations, nodes, edges and links of documents (document_id, text).

    Mentions come from the rules and, if given, a gazetteer (text, type); relations from
    proximity, co-occurrence and rule phrases. Mentions are staged, since all later steps
    read them.
    """
    config = config or Config()
    docs = docs.where(F.col("document_id").isNotNull() & F.col("text").isNotNull())
    cut = docs.select("document_id", F.explode(chunks(F.col("text"), config.chunk_size, config.chunk_overlap)).alias("c")).select("document_id", "c.chunk_index", "c.content")
    chunk = cut.select(uuid5(F.concat_ws("_", "document_id", F.col("chunk_index").cast("string"))).alias("chunk_id"), "*")
    found = extract.rule_mentions(docs, types, chars=config.extraction_chars)
    if terms is not None:
        found = found.unionByName(extract.gazetteer_mentions(docs, terms))
    found = staged(found, "mentions")
    nodes = staged(resolve.upsert_nodes(found), "nodes")
    cols = ["document_id", "source", "source_type", "target", "target_type", "relationship", "confidence"]
    r = relate.proximity(found, config.proximity).select(*cols, F.lit(False).alias("bidirectional"))
    r = r.unionByName(relate.cooccurrence(docs, found, config.confidence_threshold).select(*cols, F.lit(True).alias("bidirectional")))
    r = staged(r.unionByName(relate.rule_relations(docs, found).select(*cols, F.lit(False).alias("bidirectional"))), "relations")
    r = r.where(F.col("confidence") >= config.confidence_threshold)
    edges = E.upsert_edges(E.with_inverse(E.build_edges(r, nodes, config.confidence_threshold)))
    links = graph.entity_chunk_links(nodes, chunk, config.chunk_size, config.chunk_overlap)
    return {"chunks": chunk, "mentions": found, "relations": r, "nodes": nodes, "edges": edges, "links": links}


def ingest(
    store: Store, docs: DataFrame, config: Config | None = None, terms: DataFrame | None = None, *,
    origin: str | None = None, embed: Callable[[str], list[float]] | None = None,
) -> int:
    """Add documents to a store as one batch and give its number; a document that is there already is replaced.

    The documents are written last, so a batch that broke off is not seen, and the batch of
    an ``origin`` that was seen before is written again in its place.
    """
    config = config or Config()
    docs = docs.where(F.col("document_id").isNotNull()).dropDuplicates(["document_id"])
    batch = store.batch_of(origin)
    new = process_documents(docs, config, terms)
    chunk = staged(new["chunks"], "chunks")
    vectors = chunk.select(F.col("chunk_id").alias("id"), "document_id", embedded(F.col("content"), embed, config.embedding_chars).alias("embedding"))
    for name, rows in (("chunks", chunk), ("mentions", new["mentions"]), ("relations", new["relations"]), ("embeddings", vectors), ("documents", docs)):
        store.append(name, rows, batch)
    return batch


def import_totals(store: Store, batch: int) -> DataFrame:
    """(documents, failed, chunks, mentions, relations) of a batch; a document without text has failed."""
    docs = store.log("documents").where(F.col("batch") == batch)
    out = docs.agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit(1))).alias("failed"))
    for name in ("chunks", "mentions", "relations"):
        n = store.log(name).where(F.col("batch") == batch).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, F.lit(True))  # one row each
    return out
