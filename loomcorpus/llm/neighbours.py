"""Nearest neighbours by forests of random-projection trees.

A trunk tree, fitted to a bounded sample, divides all vectors into cells; every vector is indexed in
its cell by a forest of trees, each node of which splits at the median along a random direction of
its own. A query enters all trees of a cell through one shared priority queue: the branch with the
least margin is followed next, whichever tree it is of. The leaves taken are reranked by exact
distance, which tightens the reach; the queue ends at the first branch beyond it. With the distance
found in its own cell a query goes on to the other cells within reach."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shared, list_array, pick

NAME = "op5_nearest_neighbours"
SQL = None
NEIGHBOURS = 10
#: Queries are the rows whose id is divisible by this; all rows are indexed.
EVERY = 100
#: Vectors that a cell and a leaf hold about, and trees in a forest.
CELL = 8192
LEAF = 64
TREES = 8
#: Vectors that the trunk is fitted to at most (on the driver), and how many of them a cell has at least.
SAMPLE = 1 << 18
SAMPLE_CELL = 8
#: Margins up to this share of the typical projection of the k-th distance are within reach in a
#: forest. In the trunk, of which there is one only, the reach is such that a neighbour at that
#: distance lies beyond any of its planes with at most this chance in all.
REACH = 0.9
TRUNK_MISS = 0.1
SEED = 20_240_607
#: Leaves that are reranked at once, and queries that meet a cell in one task at most.
LEAVES = 16
BLOCK = 1024
QUERY_BLOCK = 1 << 16


class Tree:
    """A complete binary tree in heap order: node i has the children 2i + 1 and 2i + 2, a direction
    and the median of what it was fitted to along it."""

    def __init__(self, x: np.ndarray, depth: int, seed: int):
        n, dim = x.shape
        self.depth, inner = depth, (1 << depth) - 1
        self.planes = np.random.default_rng(seed).standard_normal((inner, dim)).astype(np.float32)
        self.planes /= np.maximum(np.linalg.norm(self.planes, axis=1, keepdims=True), 1e-12)
        self.cuts = np.zeros(inner, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            begin, width = (1 << level) - 1, 1 << level
            at = np.einsum("ij,ij->i", x, self.planes[begin + node])
            order = np.lexsort((at, node))
            size = np.bincount(node, minlength=width)
            first = np.cumsum(size) - size
            half = first + size // 2
            last = max(n - 1, 0)
            self.cuts[begin : begin + width] = (at[order[np.clip(half - 1, 0, last)]] + at[order[np.clip(half, 0, last)]]) / 2 if n else 0
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            node = 2 * node + (place >= half[node])
        self.leaf = node

    def sides(self, q: np.ndarray) -> np.ndarray:
        """Signed distance of each query from each node's cut."""
        return q @ self.planes.T - self.cuts

    def reached(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, leaf, own) of all leaves none of whose planes is crossed beyond the limit."""
        who, node, own = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for level in range(self.depth):
            at = (1 << level) - 1 + node
            side = np.einsum("ij,ij->i", x[who], self.planes[at]) - self.cuts[at]
            bit, cross = (side >= 0).astype(np.int64), np.abs(side) <= limit[who]
            node = np.concatenate([2 * node + bit, 2 * node[cross] + 1 - bit[cross]])
            own = np.concatenate([own, np.zeros(int(cross.sum()), bool)])
            who = np.concatenate([who, who[cross]])
        return who, node, own


class Forest:
    """Trees over one cell's vectors."""

    def __init__(self, x: np.ndarray, trees: int, leaf: int, seed: int):
        self.x = np.ascontiguousarray(x, np.float32)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x) / leaf)))))
        self.trees = [Tree(self.x, self.depth, seed + t) for t in range(trees if self.depth else 1)]
        self.members = []
        for tree in self.trees:
            order = np.argsort(tree.leaf, kind="stable")
            bounds = np.searchsorted(tree.leaf[order], np.arange((1 << self.depth) + 1))
            self.members.append([order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    def search(self, q: np.ndarray, bound: np.ndarray, k: int, reach: float) -> list[np.ndarray]:
        """For each query the members that may be among its k nearest within its bound (squared)."""
        found = []
        for a in range(0, len(q), BLOCK):
            block = np.ascontiguousarray(q[a : a + BLOCK], np.float32)
            sides = [t.sides(block) for t in self.trees]
            for i in range(len(block)):
                found.append(self._one(block[i], [s[i].tolist() for s in sides], float(bound[a + i]), k, reach))
        return found

    def _one(self, q: np.ndarray, sides: list[list[float]], bound: float, k: int, reach: float) -> np.ndarray:
        inner = (1 << self.depth) - 1
        own = float(q @ q)
        blur = 1e-5 * (own + 1)  # float32 rounding; what it lets through is told apart exactly later
        limit = reach * np.sqrt(max(bound, 0.0) / len(q))
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        seen = np.zeros(len(self.x), bool)
        near, dist = np.zeros(0, np.int64), np.zeros(0, np.float32)
        taken: list[np.ndarray] = []
        while True:
            done = not queue or queue[0][0] > limit
            if taken and (done or len(taken) >= LEAVES):
                new = np.concatenate(taken)
                new = np.unique(new[~seen[new]])
                taken = []
                seen[new] = True
                d = own + self.square[new] - 2 * (self.x[new] @ q)
                slack = blur + 1e-5 * self.square[new]
                some = d <= bound + slack
                near, dist = np.concatenate([near, new[some]]), np.concatenate([dist, d[some]])
                if len(near) > k:
                    bound = min(bound, max(float(np.partition(dist, k)[k]), 0.0))
                    limit = reach * np.sqrt(bound / len(q))
                    some = dist <= bound + blur + 1e-5 * self.square[near]
                    near, dist = near[some], dist[some]
                continue
            if done:
                return near
            margin, t, node = heapq.heappop(queue)
            side = sides[t]
            while node < inner:
                s = side[node]
                far = max(margin, abs(s))
                if far <= limit:
                    heapq.heappush(queue, (far, t, 2 * node + 1 if s >= 0 else 2 * node + 2))
                node = 2 * node + 2 if s >= 0 else 2 * node + 1
            taken.append(self.members[t][node - inner])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


_LIST, _IDS = pa.list_(pa.float32()), pa.list_(pa.int64())
_PLACED = "cell bigint, part bigint, v array<float>, ids array<bigint>"
_ASKED = "vec_id bigint, v array<float>, bound double, cell bigint"
_FOUND = pa.schema([("vec_id", pa.int64()), ("v", _LIST), ("bound", pa.float64()), ("ids", _IDS), ("d", pa.list_(pa.float64()))])


def _answer(members: pa.Table, queries: pa.Table, dim: int, k: int, trees: int, leaf: int, reach: float) -> pa.Table:
    """The k nearest ids of each query in one cell, by exact distance, then id."""
    if not members.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    x, q = _matrix(members["v"], dim), _matrix(queries["v"], dim)
    copies, asked, bound = members["ids"].combine_chunks(), queries["vec_id"].to_numpy(), queries["bound"].to_numpy()
    start, ids = copies.offsets.to_numpy() - copies.offsets[0].as_py(), copies.flatten().to_numpy()
    sizes, dists, neighbours, bounds = [], [], [], []
    for i, near in enumerate(Forest(x, trees, leaf, SEED + 1).search(q, bound, k, reach)):
        exact = ((x[near].astype(np.float64) - q[i].astype(np.float64)) ** 2).sum(axis=1)
        many = start[near + 1] - start[near]
        at = np.repeat(start[near] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        who, d = ids[at], np.repeat(exact, many)
        other = who != asked[i]
        who, d = who[other], d[other]
        by = np.lexsort((who, d))[:k]
        sizes.append(len(by))
        neighbours.append(who[by])
        dists.append(d[by])
        bounds.append(float(d[by[-1]]) if len(by) == k else float(bound[i]))
    cols = [queries["vec_id"].combine_chunks(), queries["v"].combine_chunks(), pa.array(bounds, pa.float64()), list_array(np.concatenate(neighbours), sizes, pa.int64()), list_array(np.concatenate(dists), sizes, pa.float64())]
    return pa.Table.from_arrays(cols, schema=_FOUND)


def nearest(df: DataFrame, k: int = NEIGHBOURS, cell: int = CELL, leaf: int = LEAF, trees: int = TREES, reach: float = REACH, trunk_miss: float = TRUNK_MISS, every: int = EVERY, sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vec_id, rank, neighbour_id, distance: the k nearest others, by Euclidean distance, of every
    vector whose id is divisible by ``every``, searched in all vectors; rank 1 is nearest, equal
    distances go by id.

    Approximate: a neighbour is missed where it lies beyond the reach in every tree. Rows with a null
    id, a null or empty vector, or a null or infinite component have no neighbours and are none; nor
    do vectors whose length isn't the table's most frequent one. Rows with the same id are one vector
    (the smallest). Equal vectors are neighbours at distance 0; they are one entry of the index with
    their k + 1 smallest ids, as no others can be among the k nearest of anything. A table of one
    vector, or none, gives an empty result, one of fewer than k + 1 all others. Extra columns are
    ignored.

    The trunk is fitted to at most about ``sample`` vectors, drawn by a hash of their ids. Cells that
    come out over twice ``cell`` are divided by hash, and the queries go to each part; queries of one
    cell beyond ``query_block`` are divided likewise.
    """
    spark = df.sparkSession
    shared = Shared(spark, "neighbours")
    raw = pick(df, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    fit = raw.filter("vec_id is not null and size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e18))))
    vectors = shared.table(fit.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    vectors = vectors.filter(F.size("v") == dim)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    one = vectors.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = shared.table(one.select("v", "ids", F.xxhash64(F.col("ids")[0], F.lit(SEED)).alias("h")), "distinct")
    n = one.count()
    drawn = one.filter(F.pmod("h", F.lit(1 << 32)) < int(min(1.0, sample / max(n, 1)) * (1 << 32))).select("v", "h").toArrow()
    x = _matrix(drawn["v"], dim)[np.argsort(drawn["h"].to_numpy(), kind="stable")]
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / cell))), int(np.log2(max(len(x) / SAMPLE_CELL, 1)))))
    trunk = spark.sparkContext.broadcast(Tree(x, depth, SEED))  # at most a plane for SAMPLE_CELL vectors of the sample
    trunk_reach = NormalDist().inv_cdf(1 - min(trunk_miss / max(depth, 1), 0.5))
    own = np.float32(-1)

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["v"], dim)
            node = trunk.value.reached(x, np.full(len(x), own))[1]
            yield pa.RecordBatch.from_arrays([pa.array(node), b["h"], b["v"], b["ids"]], names=["cell", "part", "v", "ids"])

    placed = shared.table(one.mapInArrow(placing, _PLACED), "placed")
    parts = {r.cell: -(-r["count"] // (2 * cell)) for r in placed.groupBy("cell").count().collect()}  # one row a cell

    def several(of: dict[int, int], c: str = "cell"):  # noqa: ANN202
        """How many parts a cell has: 1 but for those that are divided."""
        more = [F.lit(v) for k, n in of.items() if n > 1 for v in (k, n)]
        return F.coalesce(F.element_at(F.create_map(*more), F.col(c)), F.lit(1)) if more else F.lit(1)

    placed = placed.withColumn("part", F.pmod("part", several(parts)))

    def going(whole: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, bound = _matrix(b["v"], dim), b["bound"].to_numpy()
                limit = np.full(len(x), own) if whole else (trunk_reach * np.sqrt(bound / dim)).astype(np.float32)
                who, node, mine = trunk.value.reached(x, limit)
                if not whole:
                    who, node = who[~mine], node[~mine]
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(at), b["v"].take(at), b["bound"].take(at), pa.array(node)], names=["vec_id", "v", "bound", "cell"])

        return run

    def searched(asked: DataFrame, name: str) -> DataFrame:
        asked = shared.table(asked, f"{name}-asked")
        blocks = {r.cell: -(-r["count"] // query_block) for r in asked.groupBy("cell").count().collect()}  # one row a cell
        many = several(blocks)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), many)).withColumn("part", F.explode(F.sequence(F.lit(0), several(parts) - 1)))
        members = placed.withColumn("block", F.explode(F.sequence(F.lit(0), many - 1)))
        by = [F.col("cell"), F.col("part").cast("long").alias("part"), F.col("block").cast("long").alias("block")]
        met = members.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(lambda m, q: _answer(m, q, dim, k, trees, leaf, reach), "vec_id bigint, v array<float>, bound double, ids array<bigint>, d array<double>")
        return shared.table(met, name)

    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", F.lit(float("inf")).alias("bound"))
    first = searched(queries.mapInArrow(going(True), _ASKED), "first")
    found = first.select("vec_id", "ids", "d")
    if depth:
        best = first.groupBy("vec_id").agg(F.min("bound").alias("bound"), F.first("v").alias("v")).select("vec_id", "v", "bound")
        found = found.unionByName(searched(best.mapInArrow(going(False), _ASKED), "more").select("vec_id", "ids", "d"))
    shared.only("first", "more")
    pairs = found.select("vec_id", F.explode(F.arrays_zip("ids", "d")).alias("p")).select("vec_id", F.col("p.ids").alias("neighbour_id"), F.col("p.d").alias("d2"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "neighbour_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", F.sqrt("d2").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
