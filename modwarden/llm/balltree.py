"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Vectors are quantised to integers and dealt over even shards of a bounded number of rows. A task
builds the ball tree of its shard and streams the queries past it in blocks. A node holds the centre and radius of its
vectors, so no inner product with a query ``q`` below it exceeds ``q . centre + |q| * radius``. Nodes wait in a queue by
that bound; a node is opened only for the queries of the block whose k-th score so far the bound can still reach, and
leaves are scored as integer matrix products, which are exact. The k-th score of a query is shared by all nodes, and by
all shards: a query first searches one shard, and takes the k-th score found there along to the others.

Defined results: vectors that are null or hold a null, NaN or infinite component take no part; only vectors of equal
length are compared; rows with the query's id are its own, and equal rows of one id query once; candidates that
repeat are listed as often as they occur; equal scores go by the smaller id, a null id last; a null id is never a query.
A query with no candidate has no rows. Components beyond 2**31 after quantising raise an error, as a score might not
fit a long. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modwarden.session import materialize

SCALE, TOP, LEAF = 256, 5, 48
SHARD_ROWS = 16_384
BLOCK = 128
_LAST = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min
VECTORS = "vec_id bigint, v binary"
FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def _quantised(scale: int) -> Callable:
    """Rows of whole vectors as ``floor(scale * x)`` in 64-bit integers; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, bounds = pc.list_flatten(lists), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            whole = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[bounds[1:]] == bad[bounds[:-1]])
            x = np.floor(scale * np.where(np.isfinite(x), x, 0))
            if np.abs(x).max(initial=0) > 2**31:
                raise ValueError("a component lies beyond 2**31 after quantising")
            x, cut = x.astype(np.int64), bounds.tolist()
            rows = np.flatnonzero(whole).tolist()
            packed = [x[cut[i] : cut[i + 1]].tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary())], ["vec_id", "v"])

    return run


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: the integer components of each whole vector as bytes."""
    picked = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(_quantised(scale), VECTORS)


def matrix(v: pa.Array) -> np.ndarray:
    """Vectors of one length as integer rows."""
    return np.frombuffer(b"".join(v.to_pylist()), np.int64).reshape(len(v), -1)


class BallTree:
    """Balls around halves of halves of the vectors, down to leaves of at most ``leaf`` of them.

    Nodes are numbered so that the children of an inner node ``i`` are ``child[i]`` and ``child[i] + 1``.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order, nodes, child = np.arange(len(ids)), [(0, len(ids))], []
        at = 0
        points = x.astype(np.float64)
        centre, radius = [], []
        while at < len(nodes):
            a, b = nodes[at]
            some = points[order[a:b]]
            mid = some.mean(axis=0)
            away = np.sqrt(((some - mid) ** 2).sum(axis=1))
            centre.append(mid)
            radius.append(away.max())
            if b - a <= leaf or not away.max():
                child.append(-1)
            else:
                # Split between the vector that is farthest from the centre and the one farthest from that.
                far = some[away.argmax()]
                other = some[((some - far) ** 2).sum(axis=1).argmax()]
                side = some @ (other - far)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(side, half)]
                child.append(len(nodes))
                nodes += [(a, a + half), (a + half, b)]
            at += 1
        self.ids, self.x, self.points = ids[order], x[order], points[order]
        self.longest = float(np.sqrt((points**2).sum(axis=1)).max())
        self.span, self.child = nodes, child
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.least_id = [int(self.ids[a:b].min()) for a, b in nodes]

    def products(self, q: np.ndarray, a: int, b: int, long: float) -> np.ndarray:
        """Exact inner products; below 2**53 no sum of doubles is rounded."""
        if long * self.longest < 2.0**53:
            return (q.astype(np.float64) @ self.points[a:b].T).astype(np.int64)
        return q @ self.x[a:b].T

    def search(self, own: np.ndarray, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of this shard and of the scores and ids given, for each query of a block.

        ``score`` and ``ids`` have a row per query, best first; free places have the least score and the last id.
        """
        k = score.shape[1]
        q_float = q.astype(np.float64)
        length = np.sqrt((q_float**2).sum(axis=1))
        longest = float(length.max(initial=0))

        def bounds(node: int, who: np.ndarray) -> np.ndarray:
            reach = q_float[who] @ self.centre[node] + length[who] * self.radius[node]
            # Room for what the rounding of the bound itself may lose.
            return reach + 1e-9 * length[who] * (self.longest + self.radius[node]) + 1e-3

        def open_for(node: int, who: np.ndarray, bound: np.ndarray) -> np.ndarray:
            kth, last = score[who, -1], ids[who, -1]
            return (bound > kth) | ((np.floor(bound) == kth) & (self.least_id[node] < last))

        everyone = np.arange(len(q))
        first = bounds(0, everyone)
        queue = [(-first.max(initial=0), 0, everyone, first)]
        while queue:
            _, node, who, bound = heapq.heappop(queue)
            still = open_for(node, who, bound)
            who = who[still]
            if not len(who):
                continue
            if self.child[node] >= 0:
                for below in (self.child[node], self.child[node] + 1):
                    reach = bounds(below, who)
                    worth = open_for(below, who, reach)
                    if worth.any():
                        heapq.heappush(queue, (-reach[worth].max(), below, who[worth], reach[worth]))
                continue
            a, b = self.span[node]
            found = self.products(q[who], a, b, longest)
            here = self.ids[a:b]
            better = (found > score[who, -1][:, None]) | ((found == score[who, -1][:, None]) & (here < ids[who, -1][:, None]))
            better &= here != own[who][:, None]
            row, col = np.nonzero(better)
            if not len(row):
                continue
            touched = np.unique(row)
            best = who[touched]
            # Old and new entries of the touched queries, best first, cut to k.
            of = np.concatenate([np.repeat(np.arange(len(best)), k), np.searchsorted(touched, row)])
            s = np.concatenate([score[best].ravel(), found[row, col]])
            i = np.concatenate([ids[best].ravel(), here[col]])
            order = np.lexsort((i, ~s, of))
            of, s, i = of[order], s[order], i[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            kept = place < k
            score[best], ids[best] = s[kept].reshape(-1, k), i[kept].reshape(-1, k)
        return score, ids


def _shards(k: int, leaf: int) -> Callable:
    """Candidates of a shard come before its queries: the trees are built, then queries pass in blocks."""

    def answered(trees: dict[int, BallTree], block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        widths = pc.binary_length(block.column("v")).to_numpy()
        for width in np.unique(widths).tolist():
            if width not in trees:
                continue
            some = block.take(pa.array(np.flatnonzero(widths == width)))
            own, floor, floor_id = (some.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "floor", "floor_id"))
            # The k-th entry of an earlier shard holds the last place; what this shard finds must beat it.
            score, ids = np.full((len(own), k), _LEAST), np.full((len(own), k), _LAST)
            known = floor > _LEAST
            score[known], ids[known] = floor[known, None], floor_id[known, None]
            score, ids = trees[width].search(own, matrix(some.column("v")), score, ids)
            real = (score > _LEAST) & ~(known[:, None] & (score == floor[:, None]) & (ids == floor_id[:, None]))
            row, col = np.nonzero(real)
            key = some.column("query_key").to_numpy()
            found = ids[row, col]
            cols = [pa.array(own[row]), pa.array(key[row]), pa.array(found, mask=found == _LAST), pa.array(score[row, col])]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "query_key", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees, shard = [], None, None
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting and trees:
                whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()
                for piece in whole:
                    for at in range(0, piece.num_rows, BLOCK):
                        yield from answered(trees, piece.slice(at, BLOCK))
            waiting = []

        def built() -> dict[int, BallTree]:
            if not held:
                return {}
            all_ = pa.Table.from_batches(held).combine_chunks()
            ids = pc.fill_null(all_.column("vec_id"), _LAST).to_numpy()
            v = all_.column("v").combine_chunks()
            widths = pc.binary_length(v).to_numpy()
            return {w: BallTree(ids[widths == w], matrix(v.filter(pa.array(widths == w))), leaf) for w in np.unique(widths).tolist()}

        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]))) if len(shards) else []
            for a, b in zip(runs, [*runs[1:], len(shards)], strict=True):
                if shards[a] != shard:
                    yield from flush()
                    held, trees, shard = [], None, shards[a]
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if trees is None:
                    trees, held = built(), []
                waiting.append(batch.slice(a, b - a))
                if sum(w.num_rows for w in waiting) >= BLOCK:
                    yield from flush()
        yield from flush()

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = SCALE, shard_rows: int = SHARD_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of every query with all other rows.

    ``is_query`` is an expression over ``vec_id``. A query meets every shard once; its rows of the other shards are at
    most ``k`` each, and only those that beat what it found in its first shard.
    """
    known = materialize(quantise(vectors, id_col, vector_col, scale).withColumn("at", F.monotonically_increasing_id()), "vectors")
    shards = max(1, -(-known.count() // shard_rows))
    # Places are written with the rows, so shards are even whatever ids and vectors repeat, and stay when a task is run again.
    shard = F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int")
    none, nobody = F.lit(_LEAST), F.lit(_LAST)
    table = known.select(shard.alias("shard"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("bigint").alias("query_key"), "v", none.alias("floor"), nobody.alias("floor_id"))
    queries = known.filter(F.col("vec_id").isNotNull() & is_query).select("vec_id", "v").distinct().withColumn("query_key", F.xxhash64("v"))
    first = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")

    def met(asking: DataFrame) -> DataFrame:
        rows = table.unionByName(asking.select(*table.columns))
        dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks")
        return dealt.mapInArrow(_shards(k, leaf), FOUND)

    asked = queries.withColumns({"shard": first, "asks": F.lit(True), "floor": none, "floor_id": nobody})
    found = met(asked)
    if shards > 1:
        near = materialize(found, "first-shard")
        order = [F.desc("score"), F.asc_nulls_last("vec_id")]
        of = Window.partitionBy("query_id", "query_key")
        kth = near.withColumn("_r", F.row_number().over(of.orderBy(*order))).filter(F.col("_r") == k)
        kth = kth.select(F.col("query_id").alias("vec_id"), "query_key", F.col("score").alias("floor"), F.coalesce(F.col("vec_id"), nobody).alias("floor_id"))
        others = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array(first))
        rest = queries.join(kth, ["vec_id", "query_key"], "left").withColumns({
            "floor": F.coalesce("floor", none), "floor_id": F.coalesce("floor_id", nobody), "asks": F.lit(True), "shard": F.explode(others),
        })
        found = near.unionByName(met(rest))
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
