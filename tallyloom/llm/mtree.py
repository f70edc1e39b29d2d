"""Exact top-k search by inner product with M-trees.

Largest inner products become nearest neighbours in a metric space: with M the largest norm, a vector x
gets one more component sqrt(M^2 - |x|^2) and a query gets 0, so that distance^2 = |q|^2 + M^2 - 2 q.x.
Each shard of the rows has its own M-tree; a query visits all shards, and their best are merged.
"""

from __future__ import annotations

import heapq
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, lean, read

#: Rows of a leaf page and children of an inner page; rows of a shard; queries that one task asks a shard.
PAGE, FANOUT, SHARD_ROWS, QUERIES = 512, 16, 10_000, 10_000


class _Node:
    """A page: routing objects (inner) or rows (leaf), each with its distance to the page's own routing object."""

    __slots__ = ("at", "children", "points", "radii", "to_parent")

    def __init__(self, points, to_parent, at=None, children=None, radii=None) -> None:
        self.points, self.to_parent, self.at, self.children, self.radii = points, to_parent, at, children, radii


class MTree:
    """Bulk-loaded from integer vectors; ids decide ties."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> None:
        self.vectors, self.ids, self.page, self.fanout = vectors.astype(np.int64), ids, page, fanout
        norms = (self.vectors**2).sum(axis=1)
        self.most = int(norms.max()) if len(norms) else 0
        self.space = np.column_stack([self.vectors, np.sqrt(self.most - norms)]) if len(norms) else np.zeros((0, 1))
        # whole numbers below 2^53 are exact as floats
        self.exact = self.vectors.astype(float) if self.most < 1 << 50 else self.vectors
        self.distances = 0  # computed by searches so far
        self.rng = np.random.default_rng(11)
        self.root = self._load(np.arange(len(ids)), self.space[0], 0)[0] if len(ids) else None

    def _load(self, rows: np.ndarray, parent: np.ndarray, depth: int) -> tuple[_Node, float]:
        """The page for rows under a routing object, and its covering radius."""
        own = self.space[rows]
        to_parent = np.sqrt(((own - parent) ** 2).sum(axis=1))
        if len(rows) <= self.page:
            return _Node(own, to_parent, at=rows), float(to_parent.max())
        pivots = own[self.rng.choice(len(rows), self.fanout, replace=False)]
        near = ((own**2).sum(axis=1)[:, None] - 2 * own @ pivots.T + (pivots**2).sum(axis=1)).argmin(axis=1)
        groups = [rows[near == k] for k in range(self.fanout)]
        if max(map(len, groups)) == len(rows) or depth > 40:  # all alike: cut evenly
            groups = np.array_split(rows, self.fanout)
        kept = [k for k in range(self.fanout) if len(groups[k])]
        loaded = [self._load(groups[k], pivots[k], depth + 1) for k in kept]
        points = pivots[kept]
        return _Node(points, np.sqrt(((points - parent) ** 2).sum(axis=1)), children=[n for n, _ in loaded], radii=np.array([r for _, r in loaded])), float(to_parent.max())

    def search(self, query: np.ndarray, k: int, without: int | None = None, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (inner product, id), ties to smaller ids, without one id. least: a score that k others
        are known to reach, so lower ones may be left out.

        Best first by the least possible distance. An entry whose stored distance to its routing object
        already rules it out, by the triangle inequality, is passed over without computing its own."""
        if self.root is None:
            return []
        q = np.append(query.astype(float), 0.0)
        square = float(q @ q) + self.most
        slack = 1e-9 * (square + 1.0)
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        limit = np.inf if least is None else np.sqrt(max(square - 2 * least + slack, 0.0)) + 1e-9

        def measure(points: np.ndarray) -> np.ndarray:
            self.distances += len(points)
            return np.sqrt(np.maximum(square_q := ((points - q) ** 2).sum(axis=1), 0.0, out=square_q))

        heap = [(0.0, 0, self.root, float(measure(self.space[:1])[0]))]
        serial = 0
        while heap:
            bound, _, node, to_routing = heapq.heappop(heap)
            if bound > limit:
                break
            reach = np.abs(to_routing - node.to_parent)
            if node.children is None:
                at = node.at[reach <= limit]
                self.distances += len(at)
                rows = self.exact if square < 1 << 50 else self.vectors
                scores = (rows[at] @ query.astype(rows.dtype)).astype(np.int64)
                if len(best) == k:
                    at, scores = at[near := scores >= best[0][0]], scores[near]
                elif len(at) > 4 * k:
                    near = scores >= np.partition(scores, len(at) - k - 1)[len(at) - k - 1]
                    at, scores = at[near], scores[near]
                for score, i in zip(scores.tolist(), self.ids[at].tolist(), strict=True):
                    if i == without:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    limit = min(limit, np.sqrt(max(square - 2 * best[0][0] + slack, 0.0)) + 1e-9)
                continue
            open_ = np.flatnonzero(reach - node.radii <= limit)
            distance = measure(node.points[open_])
            for j, d in zip(open_.tolist(), distance.tolist(), strict=True):
                if (low := max(d - node.radii[j] - 1e-9, bound, 0.0)) <= limit:
                    serial += 1
                    heapq.heappush(heap, (low, serial, node.children[j], d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def top_k(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products over all other rows.

    rows and queries: vec_id long, vector array<bigint>. Ties go to smaller ids. A row is never its own
    query's answer (equal vec_id). Rows that repeat count each; queries that repeat are asked once; a query id
    with several vectors gets the best over all of them. Null vectors, null ids and vectors with null
    components take no part; a query meets the rows of its own dimension only. Empty tables give an empty
    result. Sums have to fit 64 bits.

    Rows are dealt to shards by a hash of the id, evenly whatever the data are. First one shard answers all
    queries; the k-th best score of its answers is where the search of all other shards begins. A task loads
    one shard's M-tree and asks it some QUERIES queries, so tasks are shards x blocks of queries and answers
    leave as they come: that is the stated query set against all rows.
    """
    sound = lambda df: df.where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)").select("vec_id", "vector", F.size("vector").alias("dim"))
    rows, queries = sound(rows), sound(queries).distinct()
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-queries.count() // QUERIES))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    dealt = rows.select(shard.alias("shard"), every, F.lit(False).alias("asks"), "dim", "vec_id", "vector", F.lit(None).cast("bigint").alias("least"))

    def search(batches):
        def entries():
            names = ("shard", "block", "dim", "asks", "vec_id", "least")
            for batch in batches:
                for shard, block, dim, asks, i, least, v in zip(*(batch.column(c).to_pylist() for c in names), batch.column("vector"), strict=True):
                    yield (shard, block, dim), asks, i, least, v.values.to_numpy(zero_copy_only=False) if v.values is not None else np.zeros(0, np.int64)

        def answers():
            for (_, _, dim), own in groupby(entries(), key=lambda x: x[0]):
                tree = None
                for asks, part in groupby(own, key=lambda x: x[1]):
                    if not asks:
                        part = list(part)
                        tree = MTree(np.array([x[4] for x in part]).reshape(len(part), dim), np.array([x[2] for x in part]))
                    elif tree is not None:
                        for _, _, i, least, q in part:
                            for score, v in tree.search(q, k, without=i, least=least):
                                yield i, v, score

        told = answers()
        while some := list(islice(told, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in some], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    def found(rows: DataFrame, asked: DataFrame) -> DataFrame:
        both = rows.unionByName(asked.select("shard", "block", F.lit(True).alias("asks"), "dim", "vec_id", "vector", "least"))
        return both.repartition("shard", "block").sortWithinPartitions("shard", "block", "dim", "asks").mapInArrow(lean(search), "query_id bigint, vec_id bigint, score bigint")

    first = cut(found(dealt.where("shard = 0"), asked.select("*", F.lit(0).alias("shard"), F.lit(None).cast("bigint").alias("least"))))
    if shards == 1:
        answers = first
    else:
        # a query's k-th best there; of an id with several vectors each has k answers, and the k-th of all counts
        least = best_of(first, "query_id", k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        others = F.explode(F.sequence(F.lit(1), F.lit(shards - 1))).alias("shard")
        answers = first.unionByName(found(dealt.where("shard > 0"), asked.join(least, "vec_id", "left").select("*", others)))
    return best_of(answers, "query_id", k).select("query_id", "rank", "vec_id", "score")


def best_of(found: DataFrame, query: str, k: int) -> DataFrame:
    """found with rank, up to k. The limit reaches below the shuffle: a task sends k rows of a query at most."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector: floor(256 * component); without rows that hold null or non-finite components."""
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity'))"
    return embeddings.where(finite).select("vec_id", F.expr("transform(embedding, x -> cast(floor(256D * cast(x as double)) as bigint))").alias("vector"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every embedding whose id is divisible by 50."""
    rows = quantised(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


ORACLE_OP4 = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)])::BIGINT AS score
       FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
