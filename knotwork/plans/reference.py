"""Registered queries of the graph and retrieval engine and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import text as X
from knotwork.functions import vectors as V
from knotwork.operators import edges as E
from knotwork.operators import extract, graph, relate, resolve, retrieval, stats
from knotwork.plans.reference_sql import ORACLE
from knotwork.plans.star import star_graph
from knotwork.runtime import staged, table, unstage
from knotwork.sources.files import csv_rows_as_text

__all__ = ["ORACLE", "QUERIES"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("document_id", "doc_id", "text")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return resolve.live_nodes(table(spark, d, "nodes"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return E.live_edges(table(spark, d, "edges"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    cols = ["document_id", "chunk_index", "content", "title", "document_type", "source"]
    return resolve.latest_rows(table(spark, d, "chunks"), "chunk_id", "ingested_at", cols)


RULE_TYPES = ("DATE", "TIME", "MONEY", "PERSON", "ORGANIZATION", "EMAIL", "PHONE", "URL")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return extract.rule_mentions(_docs(spark, d), RULE_TYPES)


def extract_rule_mentions(spark, d):
    return _mentions(spark, d).groupBy("document_id", "type", "text").agg(F.count(F.lit(1)).alias("n"))


def mention_spans(spark, d):
    m = _mentions(spark, d)
    return m.select("document_id", "type", "text", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


def truncate_inputs(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.truncated(F.col("text"), 8000)).alias("cut"), F.length(X.truncated(F.col("text"), 8000)).cast("long").alias("n"))


def sentence_segments(spark, d):
    s = _docs(spark, d).select("doc_id", F.posexplode(X.segments(F.col("text"))).alias("segment", "content"))
    return s.select("doc_id", F.col("segment").cast("long").alias("segment"), F.md5("content").alias("content_md5"))


def chunk_documents(spark, d):
    rows = _docs(spark, d).select("document_id", F.explode(X.chunks(F.col("text"))).alias("c")).select("document_id", "c.*")
    seed = F.concat_ws("_", "document_id", F.col("chunk_index").cast("string"))
    places = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "stop")]
    return rows.select(X.uuid5(seed).alias("chunk_id"), "document_id", *places)


def fixed_chunks(spark, d):
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(500))
    c = _docs(spark, d).where("text <> ''").select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "at"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.substring("text", F.col("at"), F.lit(600))).alias("content_md5"))


def chunk_ids(spark, d):
    c = _chunks(spark, d)
    return c.select("chunk_id", X.uuid5(F.concat_ws("_", "document_id", F.col("chunk_index").cast("string"))).alias("derived_id"))


def node_ids(spark, d):
    n = _nodes(spark, d)
    return n.select("node_id", X.node_id(F.col("text"), F.col("type")).alias("derived_id"))


def trigram_jaccard(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lower("s_name").alias("t"))
    p = n.join(n.select((F.col("k") - 1).alias("k"), F.col("t").alias("u")), "k")
    return p.select("k", F.round(X.trigram_jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


def resolve_exact(spark, d):
    return resolve.resolve_exact(_nodes(spark, d))


def resolve_near_dup(spark, d):
    return resolve.near_duplicates(_nodes(spark, d)).select("short", "long", "type", F.round("similarity", 6).alias("similarity"))


def resolve_canonical(spark, d):
    return resolve.canonical_near(_nodes(spark, d))


def embedding_duplicates(spark, d):
    v = _emb(spark, d).withColumn("type", F.col("label").cast("string"))
    return resolve.embedding_duplicates(v, 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


def node_upsert(spark, d):
    n = resolve.upsert_nodes(_mentions(spark, d))
    return n.select("node_id", "text", "type", "occurrences", F.array_join("documents", ",").alias("documents"), F.size("contexts").cast("long").alias("n_contexts"))


def mention_node_links(spark, d):
    m = resolve.mention_nodes(_mentions(spark, d))
    return m.groupBy("node_id", "document_id").agg(F.count(F.lit(1)).alias("n"), F.min("start_pos").cast("long").alias("first_pos"))


def _divisible(c: str) -> Column:
    """Ids divisible by 20; an id in hexadecimal digits counts as its first eight."""
    return F.conv(F.substring(c, 1, 8), 16, 10).cast("long") % 20 == 0


def node_remove(spark, d):
    n = _nodes(spark, d)
    return resolve.remove_nodes(n, _edges(spark, d), n.where(_divisible("node_id")))[0].select("node_id", "text", "type")


def node_remove_edges(spark, d):
    n = _nodes(spark, d)
    return resolve.remove_nodes(n, _edges(spark, d), n.where(_divisible("node_id")))[1].select("edge_id", "source_id", "target_id")


def edge_remove(spark, d):
    e = _edges(spark, d)
    return E.remove_edges(e, e.where(_divisible("edge_id")))[0].select("edge_id", "type")


def confidence_cut(spark, d):
    return E.confidence_cut(_edges(spark, d), 0.8)


def nodes_by_type(spark, d):
    return _nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("occurrences").alias("occurrences"))


def nodes_by_document(spark, d):
    return resolve.nodes_by_document(_nodes(spark, d)).select("document", "node_id")


def node_lookup(spark, d):
    n = _nodes(spark, d)
    return resolve.node_of_text(n, n.select("text"))


def _aliases(n: DataFrame) -> DataFrame:
    best = resolve.resolve_exact(n).select("folded", "type", "canonical")
    a = n.select("node_id", F.lower("text").alias("folded"), "type").join(best, ["folded", "type"])
    return a.select(F.col("node_id").alias("alias"), F.col("canonical").alias("primary"))


def node_merge(spark, d):
    n = staged(_nodes(spark, d), "nodes")
    return resolve.merge_nodes(n, _edges(spark, d), _aliases(n))[0].select("node_id", "text", "occurrences", F.size("documents").cast("long").alias("n_documents"))


def node_merge_edges(spark, d):
    n = staged(_nodes(spark, d), "nodes")
    e = resolve.merge_nodes(n, _edges(spark, d), _aliases(n))[1]
    return e.select("edge_id", "confidence", "occurrences")


def metadata_merge(spark, d):
    e = table(spark, d, "edges").where("source_id is not null and metadata is not null")
    m = resolve.merged_metadata(e, "edge_id", "metadata")
    return m.select("edge_id", "field", F.array_join("values", ",").alias("values"))


def _terms(n: DataFrame) -> DataFrame:
    return n.select("text", "type")


def _terms_found(spark, d) -> DataFrame:
    return extract.gazetteer_mentions(_docs(spark, d), _terms(_nodes(spark, d)))


def gazetteer_mentions(spark, d):
    return _terms_found(spark, d).groupBy("document_id", "text", "type").agg(F.min("start_pos").cast("long").alias("first_pos"))


def cooccurrence_relations(spark, d):
    r = relate.cooccurrence(_docs(spark, d), staged(_terms_found(spark, d), "mentions"), 0.5)
    return r.select("document_id", "source", "source_type", "target", "target_type", "relationship", F.round("confidence", 6).alias("confidence"), "common_segments")


def _contexts(n: DataFrame) -> DataFrame:
    c = n.select("node_id", "text", "type", F.explode(F.filter("contexts", lambda x: x.isNotNull())).alias("c"))
    return c.select(F.col("c.document").alias("document_id"), "text", "type", "c.start_pos", "c.end_pos")


def proximity_relations(spark, d):
    r = relate.proximity(_contexts(_nodes(spark, d)))
    return r.select("document_id", "source", "target", "relationship", F.col("distance").cast("long").alias("distance"), F.round("confidence", 6).alias("confidence"))


# A phrase of every relation that the rules know, by the type of an edge.
SPOKEN = {"WORKS_FOR": "works for", "LOCATED_IN": "is located in", "PART_OF": "is part of", "CREATOR_OF": "developed", "OCCURRED_AT": "took place in"}


def _sentences(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every named edge of a type that the rules know as a sentence (document_id is its edge_id), and the entities of each."""
    said = F.create_map(*[F.lit(x) for kv in SPOKEN.items() for x in kv])[F.col("type")]
    e = graph.named_edges(_edges(spark, d), _nodes(spark, d)).withColumn("said", said).where("said is not null")
    text = F.concat("source_text", F.lit(" "), "said", F.lit(" "), "target_text", F.lit("."))
    ends = [F.struct(F.col(f"{x}_text").alias("text"), F.col(f"{x}_type").alias("type")) for x in ("source", "target")]
    entities = e.select(F.col("edge_id").alias("document_id"), F.explode(F.array(*ends)).alias("x")).select("document_id", "x.text", "x.type")
    return e.select(F.col("edge_id").alias("document_id"), text.alias("text")), entities


def rule_relation_hits(spark, d):
    h = relate.rule_hits(_docs(spark, d).select("document_id", "text").unionByName(_sentences(spark, d)[0]))
    return h.groupBy("relationship", "source_token", "target_token").agg(F.count(F.lit(1)).alias("n"))


def rule_relations(spark, d):
    r = relate.rule_relations(*_sentences(spark, d))
    return r.select("document_id", "source", "source_type", "target", "target_type", "relationship")


def pair_batches(spark, d):
    p = relate.pair_batches(_terms_found(spark, d))
    return p.groupBy("document_id", "batch_id").agg(F.count(F.lit(1)).alias("n_pairs"))


def cross_document_relations(spark, d):
    r = relate.cross_document(_nodes(spark, d))
    return r.select("node_a", "node_b", "common", F.round("confidence", 6).alias("confidence"))


def cross_document_classes(spark, d):
    return relate.document_classes(_nodes(spark, d)).select("node_id", "class")


def _suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("balance"))


def tabular_row_similarity(spark, d):
    r = relate.row_similarity(_suppliers(spark, d), "s_suppkey", ["s_nationkey", "balance"])
    return r.select("a", "b", "shared_columns", F.round("weight", 6).alias("weight"))


def tabular_row_classes(spark, d):
    return relate.row_classes(_suppliers(spark, d), "s_suppkey", ["s_nationkey", "balance"])


def rows_to_text(spark, d):
    return csv_rows_as_text(table(spark, d, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


def json_reply_parse(spark, d):
    """Replies of changing shape round the nodes: plain, in prose, broken off, without a type, with positions as text, or no array at all."""
    e = F.to_json(F.struct("text", "type", F.length("text").cast("string").alias("end_pos")))
    kind = F.conv(F.substring("node_id", 1, 2), 16, 10).cast("int") % 5
    reply = (
        F.when(kind == 0, F.concat(F.lit("["), e, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Sure:\n[ "), e, F.lit(', {"text": "no type"}, '), e, F.lit("]\ndone")))
        .when(kind == 2, F.concat(F.lit("["), e))
        .when(kind == 3, F.concat(F.lit("["), F.to_json(F.struct("text", "type", F.lit("first").alias("start_pos"))), F.lit("]")))
        .otherwise(F.lit("There are none."))
    )
    n = _nodes(spark, d).where("text is not null").select("node_id", reply.alias("reply"))
    m = extract.reply_mentions(n, "node_id").groupBy("document_id", "text", "type", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n"))
    return m.select(F.col("document_id").alias("node_id"), "text", "type", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), "n")


def _relations(spark, d):
    named = graph.named_edges(_edges(spark, d), _nodes(spark, d))
    return named.select(
        F.col("source_text").alias("source"), "source_type", F.col("target_text").alias("target"), "target_type",
        F.col("type").alias("relationship"), "confidence", "bidirectional", F.get("documents", F.lit(0)).alias("document_id"),
    )


def edge_build(spark, d):
    return E.build_edges(_relations(spark, d), _nodes(spark, d), 0.5).select("edge_id", "source_id", "target_id", "type", "confidence")


def edge_inverse(spark, d):
    return E.with_inverse(_edges(spark, d)).select("edge_id", "source_id", "target_id", "type")


def edge_upsert(spark, d):
    e = E.upsert_edges(table(spark, d, "edges").where("source_id is not null and target_id is not null"))
    return e.select("edge_id", "source_id", "target_id", F.round("confidence", 6).alias("confidence"), "occurrences", F.array_join("documents", ",").alias("documents"))


def edges_by_node(spark, d):
    return E.incident(_edges(spark, d)).select("node_id", "direction", "edge_id", "neighbour_id")


def edges_between(spark, d):
    e = _edges(spark, d)
    return E.between(e, e.where(_divisible("edge_id")).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))).select("edge_id", "type")


def edges_filter_confidence(spark, d):
    return E.confident(_edges(spark, d), 0.8).select("edge_id", "confidence")


def merge_parallel_edges(spark, d):
    e = table(spark, d, "edges").where("source_id is not null and target_id is not null")
    return E.merge_parallel(e).select("edge_id", "source_id", "target_id", "type", "confidence", "occurrences", "merged")


def query_entities(spark, d):
    return graph.query_entities(_nodes(spark, d), text="berg", limit=0).unionByName(graph.query_entities(_nodes(spark, d), kind="PRODUCT", text="an", limit=0)).select("node_id", "text", "type")


def query_relationships(spark, d):
    return graph.query_relationships(_edges(spark, d), _nodes(spark, d), source="an", min_confidence=0.7, limit=0).select("edge_id", "source_text", "target_text", "type", "confidence")


def entity_relationships(spark, d):
    n = _nodes(spark, d)
    return graph.entity_relationships(_edges(spark, d), n, n, min_confidence=0.5).select("node_id", "direction", "edge_id", "neighbour_text")


def _path_pairs(n: DataFrame) -> DataFrame:
    """Every node whose id is divisible by 20, with the next such node of its bucket in the order of ids."""
    w = Window.partitionBy(F.substring("node_id", 1, 2)).orderBy("node_id")
    return n.where(_divisible("node_id")).select(F.col("node_id").alias("source"), F.lead("node_id").over(w).alias("target"))


def shortest_path(spark, d):
    p = graph.shortest_paths(_edges(spark, d), _path_pairs(_nodes(spark, d)), 3, 0.5)
    return p.select("source", "target", F.col("hops").cast("long").alias("hops"), F.size("edge_ids").cast("long").alias("n_edges"))


def paths_all_simple(spark, d):
    nodes, edges = star_graph(spark, d)
    p = graph.simple_paths(edges, nodes.where("type = 'REGION'"), nodes.where("type = 'SUPPLIER'"), 3)
    return p.select("source", "target", F.array_join("nodes", ">").alias("nodes"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Live edges up to their confidence."""
    return E.live_edges(table(spark, d, "edges"), E.EDGE_COLUMNS.index("confidence") + 1)


def _centres(n: DataFrame) -> DataFrame:
    return n.where(_divisible("node_id")).select("node_id")


def ego_network_nodes(spark, d):
    n = _nodes(spark, d)
    near, _ = graph.ego_nodes(_links(spark, d), _centres(n))
    return graph.named_network(near, n).select("start", "node_id", F.col("hop").cast("long").alias("hop"), "text")


def ego_network_edges(spark, d):
    near, e = graph.ego_nodes(_links(spark, d), _centres(_nodes(spark, d)))
    inside = graph.ego_edges(e, near).select("start", "edge_id")
    unstage(e)
    return inside


def graph_statistics(spark, d):
    s = graph.statistics(_nodes(spark, d), _edges(spark, d))
    return s.select("metric", F.round("value", 6).alias("value"))


def star_statistics(spark, d):
    nodes, edges = star_graph(spark, d)
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")))


def store_statistics(spark, d):
    return stats.store_statistics(_chunks(spark, d), _nodes(spark, d), _edges(spark, d))


def document_counters(spark, d):
    return stats.document_counters(_contexts(_nodes(spark, d)), _edges(spark, d))


def get_document(spark, d):
    c = _chunks(spark, d).where("content is not null")
    g = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return g.select("document_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c.content", "\n")).alias("text_md5"))


def document_entities(spark, d):
    c = _contexts(_nodes(spark, d))
    return c.groupBy("document_id", "text", "type").agg(F.min("start_pos").cast("long").alias("first_pos"))


def entity_documents(spark, d):
    n = resolve.nodes_by_document(_nodes(spark, d))
    docs = table(spark, d, "documents").select(F.col("document_id").alias("document"), "lang")
    return n.join(docs, "document").groupBy("node_id").agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("lang").alias("n_langs"))


def entity_chunk_links(spark, d):
    c = _docs(spark, d).select("document_id", F.explode(X.chunks(F.col("text"))["chunk_index"]).alias("chunk_index"))
    return graph.entity_chunk_links(_nodes(spark, d), c).select("node_id", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"))


def _emb(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def knn_cosine(spark, d):
    v = _emb(spark, d)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return retrieval.nearest(q, v, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def knn_filtered_offset(spark, d):
    v = _emb(spark, d)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    r = retrieval.nearest(q, v, 3, 2, X.where({"label": {"LessThan": 5}}))
    return r.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def vector_normalize(spark, d):
    v = table(spark, d, "chunk_vectors").where("size(embedding) = 64 and forall(embedding, x -> not isnan(x))")
    return v.select("vec_id", F.round(V.norm(V.normalised(F.col("embedding"))), 6).alias("norm"), F.round(V.normalised(F.col("embedding"))[0], 6).alias("first")).distinct()


def pairwise_similarity_edges(spark, d):
    return retrieval.similarity_edges(_emb(spark, d), 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _items(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def _keyword_docs(spark, d):
    return _docs(spark, d).select(F.col("document_id").alias("id"), "text")


def bm25_topk(spark, d):
    return retrieval.keyword_top(_items(spark, d), _keyword_docs(spark, d), 5).select("query_id", "id", F.round("score", 4).alias("score"))


def _vector_hits(spark, d, limit=10):
    """The documents nearest to every document whose doc_id is divisible by 20: all chunk vectors count, a document by its best."""
    v = table(spark, d, "chunk_vectors").where("size(embedding) = 64 and forall(embedding, x -> not isnan(x)) and exists(embedding, x -> x <> 0)")
    v = v.groupBy("document_id", "chunk_index").agg(F.min("embedding").alias("embedding"))
    docs = table(spark, d, "documents").select("document_id", "doc_id").distinct()
    q = v.join(docs, "document_id").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return retrieval.nearest(q, v.select(F.col("document_id").alias("id"), "embedding"), limit)


def hybrid_search(spark, d):
    near = _vector_hits(spark, d)
    q = table(spark, d, "documents").where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), "text")
    words = retrieval.keyword_top(q, _keyword_docs(spark, d), 10)
    f = retrieval.fused(near, words, 0.5, 10)
    return f.select("query_id", "id", F.round("score", 6).alias("score"))


def graph_augmented_search(spark, d):
    hits = _vector_hits(spark, d).select("query_id", F.col("id").alias("document_id"), "rank")
    n = _nodes(spark, d)
    docs = table(spark, d, "documents").where("doc_id % 20 = 0").select("document_id", F.col("doc_id").alias("query_id"))
    m = _contexts(n).select("document_id", "text", "type").distinct().join(docs, "document_id").select("query_id", "text", "type")
    r = retrieval.graph_augmented(hits, m, n, _edges(spark, d), 10)
    return r.select("query_id", "document_id", "result_type", F.col("rank").cast("long").alias("rank"))


def export_network_nodes(spark, d):
    return graph.export_nodes(_nodes(spark, d)).select("id", "label", "group", "occurrences", F.array_join("documents", ",").alias("documents"))


def export_network_edges(spark, d):
    return graph.export_edges(_edges(spark, d), _nodes(spark, d)).select("id", "source", "target", "label", "sourceNode", "targetNode")


QUERIES = {f.__name__: f for f in (
    extract_rule_mentions, mention_spans, truncate_inputs, sentence_segments, chunk_documents, fixed_chunks, chunk_ids, node_ids,
    trigram_jaccard, resolve_exact, resolve_near_dup, resolve_canonical, embedding_duplicates, node_upsert, mention_node_links,
    node_remove, node_remove_edges, edge_remove, confidence_cut, nodes_by_type, nodes_by_document, node_lookup, node_merge,
    node_merge_edges, metadata_merge, gazetteer_mentions, cooccurrence_relations, proximity_relations, rule_relation_hits, rule_relations,
    pair_batches, cross_document_relations, cross_document_classes, tabular_row_similarity, tabular_row_classes, rows_to_text, json_reply_parse, edge_build, edge_inverse,
    edge_upsert, edges_by_node, edges_between, edges_filter_confidence, merge_parallel_edges, query_entities, query_relationships,
    entity_relationships, shortest_path, paths_all_simple, ego_network_nodes, ego_network_edges, graph_statistics, star_statistics,
    store_statistics, document_counters, get_document, document_entities, entity_documents, entity_chunk_links, knn_cosine,
    knn_filtered_offset, vector_normalize, pairwise_similarity_edges, bm25_topk, hybrid_search, graph_augmented_search,
    export_network_nodes, export_network_edges,
)}

