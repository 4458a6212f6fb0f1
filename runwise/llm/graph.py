"""Connected components of edges that no driver or task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runwise.session import scratch_path


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it is connected to.

    Rounds of large-star and small-star: each node hands its larger, then its smaller neighbours to
    the smallest one. Nodes of many edges are joined, never gathered. Every round is written to the
    shared folder. No edge: no row. An edge of a node with itself gives that node.
    """
    spark = edges.sparkSession
    now = _written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = now.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now, before = now.filter("a <> b"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join shuffles both sides plainly and a hub's edges can be split among tasks
        low = _written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _written(spark, large)
        low = _written(spark, large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        moved = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        now = _written(spark, moved.unionByName(own).filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))


def _written(spark, df: DataFrame) -> DataFrame:
    path = scratch_path(spark, "edges")
    df.write.parquet(path)
    return spark.read.parquet(path)
