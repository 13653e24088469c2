"""Ranks and top-n per group that stay spread out when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def hashed_order(seed: int | str, id_col: Column | str) -> Column:
    """Repeatable shuffle key: 32 hex digits spread evenly over the rows."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string")))


def rank_by_hash(df: DataFrame, groups: Sequence[str], order: str, rank: str = "rank", size: str = "group_size") -> DataFrame:
    """Exact ``row_number`` per group over a hex hash column, plus the size of the group.

    A plain window would pull a whole group into one task. The first four digits of the hash cut
    every group into 65536 even slices: slice counts are aggregated on the map side, their running
    sum gives each slice its offset, and only a slice is ranked in one place.
    """
    # Group and slice are one struct: its null fields compare as equal, and one shuffle by it serves the join
    # and the window alike.
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)])
    sliced = df.withColumn("_key", F.struct(group.alias("group"), F.substring(order, 1, 4).alias("slice")))
    counts = sliced.groupBy("_key").agg(F.count("*").alias("_n"))
    total = Window.partitionBy("_key.group")
    offsets = counts.select(
        "_key",
        (F.sum("_n").over(total.orderBy("_key.slice")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(total).alias(size),
    )
    local = Window.partitionBy("_key").orderBy(order)
    return sliced.join(offsets, "_key").withColumn(rank, F.row_number().over(local) + F.col("_offset")).drop("_key", "_offset")


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, tie: str) -> DataFrame:
    """First ``n`` rows per group in two steps, so a hot group never meets in one task whole.

    Rows are first cut to ``n`` inside a salt of the group, then ``n`` of at most ``n * SALTS``.
    ``tie`` is a unique column that settles the salt.
    """
    cols = list(groups)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)))
    first = Window.partitionBy(*cols, "_salt").orderBy(*order)
    last = Window.partitionBy(*cols).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= n)
        .withColumnRenamed("_rn", "rank")
        .drop("_salt")
    )
