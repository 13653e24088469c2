"""Connected components of a large edge table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden.session import discard, shared_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its smallest node.

    Large-star and small-star rounds: each node's neighbours move to its smallest neighbour until nothing
    changes, after a number of rounds that is logarithmic in practice. The smallest neighbour is a combined
    minimum and joins back, so no task gathers the neighbours of a hot node. Every round is written to the
    shared folder, which cuts the lineage; the round before it is deleted then.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = shared_dir(spark, "edges")
        df.write.parquet(path)
        return path, spark.read.parquet(path)

    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    path, now = written(edges.filter(F.col(a) != F.col(b)).select(u, v).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, (path, now) = path, written(small.unionByName(down.withColumnRenamed("m", "v")).distinct())
        discard(spark, old)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
