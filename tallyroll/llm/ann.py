"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

1. A tree is fitted on a bounded sample (``sample_rows``, by hash of the id): k-means splits each
   node into ``branch`` children until a node has few sample vectors.  The tree is as large as
   the sample allows, never as large as the table, so it may be sent to every task.
2. Every vector goes down the tree to its leaf.
3. A query keeps a priority queue of nodes by the distance to their centre, always opens the
   nearest, and so visits the leaves best bin first.
4. How many leaves to visit is calibrated: for a bounded set of calibration queries the true
   neighbours are found by brute force over all rows, and the visits are widened until
   ``recall`` of them lie in the visited leaves.  A query whose leaves hold fewer than ``k``
   others goes on to further leaves.
5. Vectors are dealt to buckets by leaf; a leaf with many vectors is cut in parts that go to
   several buckets, so one very common vector does not end in one task.  A query goes once to each
   bucket that holds vectors of its leaves, gets that bucket's ``k`` best, and keeps the best of all.

Nulls: vectors that are null, zero, of another dimension than most, or hold null or non-finite
components take no part.  Ties go to the smaller id.  An id that occurs with several vectors is
a candidate, and a query, with each of them; its own vectors are never its neighbours.  With no vectors the result is empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 10
BRANCH = 8
LEAF_ROWS = 24
SAMPLE_ROWS = 20_000
CALIBRATION = 100
RECALL = 0.95
PART_ROWS = 2_000


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part; the same id and vector twice count once."""
    e = F.col(embedding).cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), e.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (dims["d"] if dims else 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(label, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres, ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Tree:
    """``children[i]``: the nodes below node i, empty for a leaf; ``centre[i]``: its centre."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre, self.children = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            centres, label = _kmeans(sample[rows], branch, rng)
            groups = [(c, rows[label == j]) for j, c in enumerate(centres)]
            groups = [(c, g) for c, g in groups if len(g)]
            if len(groups) < 2:
                continue
            for c, g in groups:
                self.children[node].append(len(self.centre))
                self.centre.append(c)
                self.children.append([])
                todo.append((self.children[node][-1], g))
        self.centre = np.array(self.centre)
        self.leaves = sum(not c for c in self.children)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``: always on to the nearest child."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = node
                continue
            kids = np.array(self.children[node])
            near = ((self.centre[kids] ** 2).sum(1) - 2 * x[rows] @ self.centre[kids].T).argmin(1)
            todo += [(int(kid), rows[near == j]) for j, kid in enumerate(kids) if (near == j).any()]
        return out

    def visit(self, q: np.ndarray, most: int, counts: dict[int, int] | None = None, k: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first; then more until they hold ``k`` others.

        ``counts``: how many ids each leaf has, of which one may be the query's own.
        """
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < k):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(node)
                held += max(0, (counts or {}).get(node, 0) - 1)
                continue
            kids = self.children[node]
            for d, kid in zip(((self.centre[kids] - q) ** 2).sum(1).tolist(), kids):
                heapq.heappush(queue, (d, kid))
        return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    """(query, vec_id, distance) of the k nearest rows of x for each q, in blocks."""
    out = []
    if len(np.unique(ids)) < len(ids):  # rows that are there twice count once
        _, first = np.unique(np.column_stack((ids, x)), axis=0, return_index=True)
        ids, x = ids[first], x[first]
    norm = (x**2).sum(1)
    for i in range(0, len(q), 64):
        rough = norm - 2 * q[i : i + 64] @ x.T
        for j, row in enumerate(rough):
            own = ids != q_ids[i + j]
            row = np.where(own, row, np.inf)
            n = min(k, int(own.sum()))
            if not n:
                continue
            # The rough order may be off by rounding: take all within a margin, then measure exactly.
            edge = np.partition(row, n - 1)[n - 1]
            near = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge) + norm.max()))
            d = np.sqrt(((x[near] - q[i + j]) ** 2).sum(1))
            for o in np.lexsort((ids[near], d))[:n]:
                out.append((int(q_ids[i + j]), int(ids[near[o]]), float(d[o])))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


FOUND = "query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(rows: DataFrame, queries: list, k: int = K) -> DataFrame:
    """Exact nearest rows of a bounded list of (id, vector): each task meets all of them, block by block."""
    q_ids = np.array([i for i, _ in queries], np.int64)
    q = np.array([v for _, v in queries], np.float64)

    def scan(batches):
        for b in batches:
            if b.num_rows:
                rows_ = _best(q_ids, q, b.column("vec_id").to_numpy(), _matrix(b.column("v"), q.shape[1]), k)
                yield pa.RecordBatch.from_pandas(_frame(rows_), preserve_index=False)

    return _top(rows.select("vec_id", "v").mapInArrow(scan, FOUND), k)


def calibrate(tree: Tree, truth: dict[int, list[int]], vectors: dict[int, np.ndarray], leaf_of: dict[int, int], recall: float) -> int:
    """The fewest leaf visits with which the share of true neighbours in visited leaves reaches ``recall``."""
    places = []
    for q, near in truth.items():
        place = {leaf: i + 1 for i, leaf in enumerate(tree.visit(vectors[q], tree.leaves))}
        places += [place[leaf_of[n]] for n in near]
    return int(np.quantile(places, recall, method="higher")) if places else 1


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, leaves_visited for every usable row with ``is_query`` (over vec_id)."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    seeds = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(sample_rows).collect()
    if not seeds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves_visited int")
    sample = np.array([r["v"] for r in seeds], np.float64)
    dims = sample.shape[1]
    tree = Tree(sample)
    shared = spark.sparkContext.broadcast(tree)  # bounded by sample_rows

    def place(batches):
        for b in batches:
            leaf = shared.value.leaf(_matrix(b.column("v"), dims)) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(leaf)], names=["vec_id", "v", "leaf"])

    placed = written(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long"), "ann-leaves")

    probes = {r["vec_id"]: np.array(r["v"]) for r in placed.where(is_query).orderBy(F.xxhash64(F.lit(2), "vec_id"), "vec_id").limit(CALIBRATION).collect()}
    truth: dict[int, list[int]] = {}
    for r in brute_force(placed, list(probes.items()), k).collect() if probes else []:
        truth.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = sorted({n for near in truth.values() for n in near})
    leaf_of = {r["vec_id"]: r["leaf"] for r in placed.where(F.col("vec_id").isin(wanted)).select("vec_id", "leaf").collect()} if wanted else {}
    visits = calibrate(tree, truth, probes, leaf_of, recall)

    # Rows per leaf: as many numbers as the tree has leaves, which the sample bounds.
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf", "vec_id").count().groupBy("leaf").count().collect()}
    buckets = max(1, -(-sum(counts.values()) // PART_ROWS))
    parts = {leaf: min(buckets, -(-n // PART_ROWS)) for leaf, n in counts.items()}
    base = {leaf: i % buckets for i, leaf in enumerate(sorted(counts))}
    dealt = spark.sparkContext.broadcast((parts, base, counts))

    def deal(batches):
        parts_, base_, _ = dealt.value
        for b in batches:
            leaf, ids = b.column("leaf").to_pylist(), b.column("vec_id").to_numpy().astype(np.uint64)
            spread = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).tolist()
            at = [(base_[f] + s % parts_[f]) % buckets for f, s in zip(leaf, spread)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("leaf"), pa.array(at, pa.int32())], names=["vec_id", "v", "leaf", "bucket"])

    def route(batches):
        parts_, base_, counts_ = dealt.value
        for b in batches:
            ids, vs, at, leaves = [], [], [], []
            for i, (q, v) in enumerate(zip(b.column("vec_id").to_pylist(), _matrix(b.column("v"), dims) if b.num_rows else [])):
                by: dict[int, list[int]] = {}
                for leaf in shared.value.visit(v, visits, counts_, k):
                    for p in range(parts_.get(leaf, 0)):
                        by.setdefault((base_[leaf] + p) % buckets, []).append(leaf)
                for bucket, own in by.items():
                    ids.append(q)
                    vs.append(i)
                    at.append(bucket)
                    leaves.append(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), b.column("v").take(pa.array(vs, pa.int64())), pa.array(leaves, pa.list_(pa.int64())), pa.array(at, pa.int32())], names=["vec_id", "v", "leaves", "bucket"]
            )

    asked = placed.where(is_query).select("vec_id", "v").mapInArrow(route, "vec_id long, v array<double>, leaves array<long>, bucket int")
    held = placed.select("vec_id", "v", "leaf").mapInArrow(deal, "vec_id long, v array<double>, leaf long, bucket int")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame([])
        right = right.sort_values("leaf", kind="stable")
        leaf, ids, x = right["leaf"].to_numpy(), right["vec_id"].to_numpy(), np.stack(right["v"])
        out = []
        for q, v, own in zip(left["vec_id"], left["v"], left["leaves"]):
            lo, hi = np.searchsorted(leaf, np.sort(own)), np.searchsorted(leaf, np.sort(own), side="right")
            rows_ = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
            out += _best(np.array([q]), np.asarray(v)[None], ids[rows_], x[rows_], k)
        return _frame(out)

    found = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(meet, FOUND)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(visits).alias("leaves_visited"))
