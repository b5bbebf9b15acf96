"""Graph queries: filters, neighbourhoods, paths, ego networks, statistics, links and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.edges import LINK, confident, incident
from knotwork.runtime import staged, unstage


def query_entities(nodes: DataFrame, text: str | None = None, kind: str | None = None, document: str | None = None, limit: int = 100, case_sensitive: bool = False) -> DataFrame:
    """Nodes by type, document and substring of the text, in node_id order; limit <= 0 means all."""
    n = nodes
    if kind is not None:
        n = n.where(F.col("type") == kind)
    if document is not None:
        n = n.where(F.array_contains("documents", document))
    if text is not None:
        n = n.where(F.contains(F.col("text"), F.lit(text)) if case_sensitive else F.contains(F.lower("text"), F.lit(text.lower())))
    return n.orderBy("node_id").limit(limit) if limit > 0 else n


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with text and type of both ends; edges with a missing end are dropped."""
    s = nodes.select(F.col("node_id").alias("source_id"), F.col("text").alias("source_text"), F.col("type").alias("source_type"))
    t = nodes.select(F.col("node_id").alias("target_id"), F.col("text").alias("target_text"), F.col("type").alias("target_type"))
    return edges.join(s, "source_id").join(t, "target_id")


def query_relationships(edges: DataFrame, nodes: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None, document: str | None = None, min_confidence: float = 0.0, limit: int = 100) -> DataFrame:
    """Named edges by type, document, confidence and substrings of the ends, in edge_id order; limit <= 0 means all."""
    e = confident(edges, min_confidence)
    if kind is not None:
        e = e.where(F.col("type") == kind)
    if document is not None:
        e = e.where(F.array_contains("documents", document))
    e = named_edges(e, nodes)
    for column, part in (("source_text", source), ("target_text", target)):
        if part is not None:
            e = e.where(F.contains(F.lower(column), F.lit(part.lower())))
    return e.orderBy("edge_id").limit(limit) if limit > 0 else e


def entity_relationships(edges: DataFrame, nodes: DataFrame, ids: DataFrame, kinds: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Edges at the nodes of ``ids`` (node_id) with direction and the text and type of the other end."""
    e = incident(confident(edges, min_confidence)).join(ids.select("node_id").distinct(), "node_id", "left_semi")
    if kinds:
        e = e.where(F.col("type").isin(kinds))
    other = nodes.select(F.col("node_id").alias("neighbour_id"), F.col("text").alias("neighbour_text"), F.col("type").alias("neighbour_type"))
    return e.join(other, "neighbour_id")


def hops(edges: DataFrame, starts: DataFrame, depth: int, min_confidence: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
    """(start, node_id, hop, parent, edge_id): undirected breadth-first search from every start (node_id).

    The frontier of every hop is staged; a node is reached by the edge of greatest
    confidence, then smallest id. ``depth`` joins at most; ends when no frontier is left.
    """
    e = confident(edges, min_confidence)
    if kinds:
        e = e.where(F.col("type").isin(kinds))
    adjacent = staged(incident(e).select("node_id", "neighbour_id", "edge_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), "adjacent")
    seen = staged(starts.select(F.col("node_id").alias("start"), "node_id").distinct().withColumns({
        "hop": F.lit(0), "parent": F.lit(None).cast("string"), "edge_id": F.lit(None).cast("string"),
    }), "hops")
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.select("start", F.col("node_id").alias("parent")).join(adjacent.withColumnRenamed("node_id", "parent"), "parent")
        step = step.join(seen.select("start", F.col("node_id").alias("neighbour_id")), ["start", "neighbour_id"], "left_anti")
        best = F.min(F.struct((-F.col("confidence")).alias("c"), "edge_id", "parent"))
        frontier = step.groupBy("start", "neighbour_id").agg(best.alias("b")).select(
            "start", F.col("neighbour_id").alias("node_id"), F.lit(hop).alias("hop"), F.col("b.parent").alias("parent"), F.col("b.edge_id").alias("edge_id")
        )
        frontier = staged(frontier, "hops")
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def _traced(tree: DataFrame, name: str, depth: int) -> DataFrame:
    """(name, at, hop, nodes, edges) of a search tree: the way from the start to every node, start first."""
    t = tree.select(F.col("start").alias(name), F.col("node_id").alias("at"), "hop", "parent", "edge_id")
    way = t.where("hop = 0").select(name, "at", "hop", F.array("at").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    level, done = way, way
    for hop in range(1, depth + 1):
        up = level.select(name, F.col("at").alias("parent"), "nodes", "edges")
        level = t.where(F.col("hop") == hop).join(up, [name, "parent"]).select(
            name, "at", "hop", F.array_append("nodes", F.col("at")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges")
        )
        done = done.unionByName(level)
    return done


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
    """(source, target, hops, nodes, edge_ids): one shortest path of every pair (source, target), if any.

    The search goes from both ends: each side is searched to half of the depth, and the ways
    of a pair are joined by one edge between their ends, looked up by both of its nodes. A
    node with very many edges is thus met, but its edges are never fanned out in the middle.
    Of equally short paths the one of the smallest node list wins. A pair of equal ends has
    no path; null ends and unknown nodes have none.
    """
    p = staged(pairs.where("source <> target").select("source", "target").distinct(), "pairs")
    back = (depth - 1) // 2
    ahead = depth - 1 - back
    fore = staged(_traced(hops(edges, p.select(F.col("source").alias("node_id")), ahead, min_confidence), "source", ahead), "ahead")
    rear = staged(_traced(hops(edges, p.select(F.col("target").alias("node_id")), back, min_confidence), "target", back), "back")
    e = incident(confident(edges, min_confidence)).groupBy(F.col("node_id").alias("x"), F.col("neighbour_id").alias("y")).agg(F.min("edge_id").alias("mid"))
    left = p.join(fore.select("source", F.col("at").alias("x"), F.col("hop").alias("h1"), F.col("nodes").alias("n1"), F.col("edges").alias("e1")), "source")
    both = left.join(rear.select("target", F.col("at").alias("y"), F.col("hop").alias("h2"), F.col("nodes").alias("n2"), F.col("edges").alias("e2")), "target")
    met = both.join(e, ["x", "y"]).select(
        "source", "target", (F.col("h1") + F.col("h2") + 1).alias("hops"), F.concat("n1", F.reverse("n2")).alias("nodes"),
        F.concat("e1", F.array("mid"), F.reverse("e2")).alias("edge_ids"),
    )
    best = met.groupBy("source", "target").agg(F.min(F.struct("hops", "nodes", "edge_ids")).alias("b"))
    return best.select("source", "target", "b.*")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
    """(source, target, nodes): every path without repeated nodes of at most ``depth`` steps from a source to a target (node_id).

    Walks start once per source, not once per pair, and only go on to nodes from which some
    target can still be reached within the steps that are left. They stop at nothing: a
    target on the way ends one path and is passed by others.
    """
    e = staged(incident(confident(edges, min_confidence)).select("node_id", "neighbour_id").distinct(), "adjacent")
    near = [staged(targets.select("node_id").distinct(), "near")]
    for _ in range(depth - 1):
        step = e.join(near[-1].select(F.col("node_id").alias("neighbour_id")), "neighbour_id", "left_semi").select("node_id")
        near.append(staged(step.unionByName(near[-1]).distinct(), "near"))
    walk = sources.select(F.col("node_id").alias("source")).distinct().withColumn("nodes", F.array("source")).withColumn("at", F.col("source"))
    done = None
    for k in range(depth):
        onward = e.join(near[depth - 1 - k].select(F.col("node_id").alias("neighbour_id")), "neighbour_id", "left_semi")
        walk = walk.join(onward.select(F.col("node_id").alias("at"), "neighbour_id"), "at")
        walk = walk.where(~F.array_contains("nodes", F.col("neighbour_id")))
        walk = staged(walk.select("source", F.array_append("nodes", F.col("neighbour_id")).alias("nodes"), F.col("neighbour_id").alias("at")), "walks")
        end = walk.join(near[0].select(F.col("node_id").alias("at")), "at", "left_semi").select("source", F.col("at").alias("target"), "nodes")
        done = end if done is None else done.unionByName(end)
    return done


def ego_nodes(edges: DataFrame, centre: DataFrame, depth: int = 2, min_confidence: float = 0.5, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(start, node_id, hop) around every centre, nearest first up to ``most``, and the staged edges that count.

    The cap works inside of every hop: a centre that has its ``most`` nodes goes no further, and
    of a node's neighbours only the ``most`` smallest ids can be among the next ones: as many of
    them as are already taken leave no more places than that.
    """
    most = max(1, most)
    e = staged(confident(edges, min_confidence).select(*LINK, "confidence"), "edges", lean=True)
    w = Window.partitionBy("node_id").orderBy("neighbour_id")
    around = incident(e).select("node_id", "neighbour_id").withColumn("n", F.dense_rank().over(w))
    around = around.where(F.col("n") <= most).groupBy("node_id").agg(F.collect_set("neighbour_id").alias("neighbours"))
    around = staged(around, "adjacent", lean=True)
    near = staged(centre.select(F.col("node_id").alias("start"), "node_id").distinct().withColumns({"hop": F.lit(0), "taken": F.lit(1).cast("long")}), "ego", lean=True)
    own = Window.partitionBy("start")
    for hop in range(1, depth + 1):
        open_ = near.where((F.col("hop") == hop - 1) & (F.col("taken") < most)).select("start", "node_id")
        step = open_.join(around, "node_id").select("start", F.explode("neighbours").alias("node_id"), F.lit(hop).alias("hop"))
        met = near.select("start", "node_id", "hop").unionByName(step).repartition("start").groupBy("start", "node_id").agg(F.min("hop").alias("hop"))
        met = met.withColumn("n", F.row_number().over(own.orderBy("hop", "node_id"))).where(F.col("n") <= most).drop("n")
        last, near = near, staged(met.withColumn("taken", F.count(F.lit(1)).over(own)), "ego", lean=True)
        unstage(last)
    unstage(around)
    return near.drop("taken"), e


def keyed_edges(e: DataFrame, near: DataFrame, *more: str) -> DataFrame:
    """Edges with both ends in some network of ``near``, keyed by the end that is in fewer networks (key, other, ahead).

    So an edge at a node that very many networks share is only looked up in the networks of its other end.
    """
    n = near.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    both = e.join(n.select(F.col("node_id").alias("source_id"), F.col("n").alias("n_source")), "source_id")
    both = both.join(n.select(F.col("node_id").alias("target_id"), F.col("n").alias("n_target")), "target_id")
    ahead = F.col("n_source") <= F.col("n_target")
    return both.select(
        "edge_id", F.when(ahead, F.col("source_id")).otherwise(F.col("target_id")).alias("key"),
        F.when(ahead, F.col("target_id")).otherwise(F.col("source_id")).alias("other"), ahead.alias("ahead"), *more,
    )


def ego_edges(e: DataFrame, near: DataFrame, *more: str) -> DataFrame:
    """(start, edge_id, source_id, target_id) and ``more`` columns of ``e``: the edges among the nodes of every network."""
    keyed = staged(keyed_edges(e, near, *more), "keyed", lean=True)
    inside = keyed.join(near.select("start", F.col("node_id").alias("key")), "key").join(near.select("start", F.col("node_id").alias("other")), ["start", "other"])
    source, target = (F.when(a, F.col("key")).otherwise(F.col("other")) for a in (F.col("ahead"), ~F.col("ahead")))
    return inside.select("start", "edge_id", source.alias("source_id"), target.alias("target_id"), *more)


def named_network(near: DataFrame, nodes: DataFrame) -> DataFrame:
    return near.join(nodes.select("node_id", "text", "type", "occurrences"), "node_id", "left")


def ego_network(edges: DataFrame, nodes: DataFrame, centre: DataFrame, depth: int = 2, min_confidence: float = 0.5, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (start, node_id, hop, text, type) around every centre, nearest first up to ``most``, and the edges among them."""
    near, e = ego_nodes(edges, centre, depth, min_confidence, most)
    inside = ego_edges(e, near, "type", "confidence")
    unstage(e)
    return named_network(near, nodes), inside


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): counts of nodes and edges, by type, distinct documents and the average degree."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("metric"), F.col("n").cast("double").alias("value"))
    m = edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("metric"), F.col("n").cast("double").alias("value"))
    nt = nodes.groupBy("type").count().select(F.concat(F.lit("nodes:"), "type").alias("metric"), F.col("count").cast("double").alias("value"))
    et = edges.groupBy("type").count().select(F.concat(F.lit("edges:"), "type").alias("metric"), F.col("count").cast("double").alias("value"))
    d = nodes.select(F.explode("documents").alias("d")).agg(F.countDistinct("d").alias("n")).select(F.lit("documents").alias("metric"), F.col("n").cast("double").alias("value"))
    ends = incident(edges).join(nodes.select("node_id"), "node_id", "left_semi").agg(F.count(F.lit(1)).alias("e"))
    degree = ends.join(nodes.agg(F.count(F.lit(1)).alias("n")), F.lit(True)).select(
        F.lit("average_degree").alias("metric"), F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(F.lit(0.0)).alias("value")
    )
    return n.unionByName(m).unionByName(nt).unionByName(et).unionByName(d).unionByName(degree)


def entity_chunk_links(nodes: DataFrame, chunks: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(node_id, document_id, chunk_index): the chunk of every context of a node, from its start position."""
    c = nodes.select("node_id", F.explode(F.filter("contexts", lambda x: x.isNotNull())).alias("c"))
    at = F.floor((F.col("c.start_pos") + overlap) / size).cast("int")
    links = c.where("c.start_pos >= 0").select("node_id", F.col("c.document").alias("document_id"), at.alias("chunk_index")).distinct()
    return links.join(chunks.select("document_id", "chunk_index").distinct(), ["document_id", "chunk_index"], "left_semi").select("node_id", "document_id", "chunk_index")


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("node_id").alias("id"), F.col("text").alias("label"), "type", F.col("type").alias("group"), "occurrences",
        F.array_sort(F.array_distinct(F.coalesce("documents", F.array().cast("array<string>")))).alias("documents"),
    )


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends registered, in network form."""
    e = named_edges(edges, nodes)
    return e.select(
        F.col("edge_id").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("type").alias("label"),
        "type", "confidence", F.col("source_text").alias("sourceNode"), F.col("target_text").alias("targetNode"), "bidirectional",
    )
