"""Chat formatting with collapse of cumulative snapshots, in DataFrame functions alone.

A logged conversation that is a prefix of a longer one is a snapshot of it. Every turn carries a rolling hash of
the turns so far: the exclusive or of position-salted turn hashes, twice 64 bits, so that it adds up across
blocks of turns and no window ever holds more than one block of one conversation. Conversations whose last hash
is a proper prefix hash of some conversation are removed by an anti-join; of equal ones the smallest id stays.
The rest is rendered, one row per segment of turns.

Defined results: turns are ordered by turn number, then role and text, nulls first; a null role or text differs
from an empty one when hashed and renders as the role ``unknown`` or as nothing; rows without a conversation id
are left out; equal rows count as turns of their own; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modwarden.session import materialize

BLOCK = 256
OPEN, CLOSE = "<|", "|>"
END = "<|end|>"


def ranked_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """``(cid, pos, role, text)`` with positions from 0, without a window over a whole conversation.

    Turns fall into ranges of ``block`` turn numbers, which are counted first; a position is the turns of earlier
    ranges and the rank inside one. Many turns with one number in one conversation share a range.
    """
    t = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("cid"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    sizes = t.groupBy("cid", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("cid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("cid", "part").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    return t.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["cid", "part"]).select("cid", (F.col("offset") + F.col("rank")).alias("pos"), "role", "text")


def _turn_hash(salt: int) -> Column:
    # The null flags keep a missing value apart from an empty one.
    return F.xxhash64(F.lit(salt), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(cid, k, h1, h2)``: the rolling hash of the first ``k`` turns, for every turn of ``(cid, pos, role, text)``."""
    hashed = turns.select("cid", "pos", F.floor(F.col("pos") / block).alias("part"), _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    sums = hashed.groupBy("cid", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("cid", "part", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("bigint")).alias(f"base_{c}") for c in "ab"))
    inside = Window.partitionBy("cid", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.select("cid", "part", (F.col("pos") + 1).alias("k"), *(F.bit_xor(c).over(inside).alias(c) for c in "ab"))
    joined = rolling.join(base, ["cid", "part"])
    return joined.select("cid", "k", F.col("a").bitwiseXOR(F.col("base_a")).alias("h1"), F.col("b").bitwiseXOR(F.col("base_b")).alias("h2"))


def maximal(rolling: DataFrame, turns: DataFrame) -> DataFrame:
    """``(cid, n_turns, copies)`` of the conversations that are no prefix of a longer one, one per class of equal ones."""
    ends = turns.groupBy("cid").agg((F.max("pos") + 1).alias("n"))
    marked = rolling.join(ends, "cid")
    whole = marked.filter("k = n").groupBy("k", "h1", "h2").agg(F.min("cid").alias("cid"), F.count("*").alias("copies"))
    proper = marked.filter("k < n").select("k", "h1", "h2").distinct()
    return whole.join(proper, ["k", "h1", "h2"], "left_anti").select("cid", F.col("k").alias("n_turns"), "copies")


def turn_text() -> Column:
    """One rendered turn."""
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit(CLOSE + "\n"), F.coalesce("text", F.lit("")), F.lit("\n" + END + "\n"))


def render(turns: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(cid, segment, n_turns, copies, rendered)`` of the kept conversations; a segment has at most ``block`` turns."""
    own = turns.join(kept, "cid").withColumn("segment", F.floor(F.col("pos") / block))
    pieces = own.groupBy("cid", "segment").agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("pos", turn_text().alias("piece")))).alias("pieces")
    )
    return pieces.select("cid", "segment", "n_turns", "copies", F.array_join("pieces.piece", "").alias("rendered"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Rendered segments of the maximal conversations."""
    ranked = materialize(ranked_turns(turns, id_col, turn_col, role_col, text_col, block), "turns")
    return render(ranked, maximal(prefixes(ranked, block), ranked), block).withColumnRenamed("cid", id_col)
