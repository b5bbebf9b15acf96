"""A graph over the star schema: customers, suppliers, nations, regions and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.text import edge_id, node_id
from knotwork.runtime import table


def _nodes(df: DataFrame, key: str, name, kind: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), name.alias("text"), F.lit(kind).alias("type")).withColumn("node_id", node_id(F.col("text"), F.col("type")))


def star_nodes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "nation", "region", "part")}
    return {
        "customer": _nodes(t["customer"], "c_custkey", F.col("c_name"), "CUSTOMER"),
        "supplier": _nodes(t["supplier"], "s_suppkey", F.col("s_name"), "SUPPLIER"),
        "nation": _nodes(t["nation"], "n_nationkey", F.col("n_name"), "NATION"),
        "region": _nodes(t["region"], "r_regionkey", F.col("r_name"), "REGION"),
        "part": _nodes(t["part"], "p_partkey", F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")), "PRODUCT"),
    }


def star_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, text, type) and edges: location, part-of, and created-by weighted by quantity."""
    n = star_nodes(spark, sf_dir)

    def edges(pairs: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        s = n[a].select(F.col("key").alias("ka"), F.col("node_id").alias("source_id"))
        t = n[b].select(F.col("key").alias("kb"), F.col("node_id").alias("target_id"))
        e = pairs.join(s, "ka").join(t, "kb").withColumn("type", F.lit(kind))
        return e.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("type")).alias("edge_id"), "source_id", "target_id", "type", "confidence")

    one = F.lit(1.0).alias("confidence")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ka"), F.col("c_nationkey").alias("kb"), one)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ka"), F.col("s_nationkey").alias("kb"), one)
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ka"), F.col("n_regionkey").alias("kb"), one)
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    total = q.groupBy("l_partkey").agg(F.sum("q").alias("total"))
    p = q.join(total, "l_partkey").select(F.col("l_partkey").alias("ka"), F.col("l_suppkey").alias("kb"), (F.col("q") / F.col("total")).alias("confidence"))
    all_edges = edges(c, "customer", "nation", "LOCATED_IN").unionByName(edges(s, "supplier", "nation", "LOCATED_IN"))
    all_edges = all_edges.unionByName(edges(r, "nation", "region", "PART_OF")).unionByName(edges(p, "part", "supplier", "CREATED_BY"))
    nodes = None
    for df in n.values():
        part = df.select("node_id", "text", "type")
        nodes = part if nodes is None else nodes.unionByName(part)
    return nodes.distinct(), all_edges
