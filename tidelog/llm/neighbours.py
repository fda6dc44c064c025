"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a sample (``SAMPLE`` vectors, from ten million rows on one in ``SHARE``, at most ``MOST``); every row is then assigned to a leaf. A query walks the tree
best-bin-first: a priority queue holds nodes by their centroid's distance, and the nearest is opened until enough
leaves are out. How many is calibrated: for ``CALIBRATION`` queries the true neighbours are found by brute force over
all rows, and leaf visits widen until ``TARGET`` of those neighbours lie in visited leaves.

Equal vectors are one point that keeps its smallest ids (one more than ``k`` of them: the rest can never be among
the nearest, since ties go to smaller ids), so a vector that a third of all rows share is one point. Leaves are cut
into blocks of bounded size and queries into groups of bounded size; each pair of a block and a group that visits it is
one task's unit of work, done as one matrix product and exact distances for its best.

Edge cases: rows with a null id or a vector that is null, empty, zero, of another dimension than the largest group
of the sample, or holds null or non-finite components take no part. Repeated ids are the query's own rows. Fewer candidates than
k: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, table

K = 10
#: At most one vector in SHARE, and SAMPLE at least, make the tree, so that its leaves grow in number with the rows, up to MOST vectors.
SAMPLE, SHARE, MOST, BRANCH, LEAF = 20_000, 500, 200_000, 8, 48
CALIBRATION, TARGET = 96, 0.97
BLOCK_POINTS, GROUP_QUERIES = 4096, 2048


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, _nearest(x, c)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    c, x = c - c.mean(0), x - c.mean(0)  # near the origin, where the expanded square loses nothing
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


class Tree:
    """children[i]: centroids and nodes below node i; leaves are numbered."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 6):
        self.children: list[tuple[np.ndarray, list[int]] | None] = [None]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        rng, todo = np.random.default_rng(seed), [(0, x)]
        while todo:
            i, rows = todo.pop()
            k = min(branch, max(2, len(rows) // leaf))
            if len(rows) > leaf:
                c, own = _kmeans(rows, k, rng)
                used = [j for j in range(k) if (own == j).any()]
                if len(used) > 1:
                    below = []
                    for j in used:
                        self.children.append(None)
                        self.leaf.append(-1)
                        below.append(len(self.leaf) - 1)
                        todo.append((below[-1], rows[own == j]))
                    self.children[i] = (c[used], below)
                    continue
            self.leaf[i] = self.leaves
            self.leaves += 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            i, rows = todo.pop()
            if self.children[i] is None:
                out[rows] = self.leaf[i]
                continue
            c, below = self.children[i]
            own = _nearest(x[rows], c)
            todo += [(b, rows[own == j]) for j, b in enumerate(below) if (own == j).any()]
        return out

    def visits(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves, best bin first."""
        out, heap = [], [(0.0, 0)]
        while heap and len(out) < n:
            _, i = heapq.heappop(heap)
            if self.children[i] is None:
                out.append(self.leaf[i])
                continue
            c, below = self.children[i]
            d = ((c - q) ** 2).sum(1)
            for x in zip(d.tolist(), below, strict=True):
                heapq.heappush(heap, x)
        return out


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), dtype=np.float64)


def distances(q: np.ndarray, p: np.ndarray, k: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact distances of the k nearest points for each query, ties to the smaller id (position, if none are given).

    One matrix product of the centred vectors proposes the points, all that its rounding error leaves possible; exact distances decide.
    """
    k, ids = min(k, len(p)), np.arange(len(p)) if ids is None else ids
    centre = p.mean(0)
    a, b = q - centre, p - centre
    norms = (b * b).sum(1)
    near = norms - 2 * (a @ b.T)
    # |error| of a sum of n products is at most about n * eps * the product of the norms
    margin = 8 * np.finfo(float).eps * p.shape[1] * ((a * a).sum(1) + norms.max(initial=0) + np.square(np.abs(centre).max(initial=0)) * np.finfo(float).eps)
    kth = np.partition(near, k - 1, axis=1)[:, k - 1]
    possible = near <= (kth + 2 * margin)[:, None]
    # Positions of the possible points, row by row, in a table as wide as the longest row.
    row, at = np.nonzero(possible)
    d = np.sqrt(((p[at] - q[row]) ** 2).sum(1))
    order = np.lexsort((ids[at], d, row))
    n = possible.sum(1)
    first = np.cumsum(n) - n
    take = order[first[:, None] + np.arange(k)]
    return at[take], d[take]


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, target: float = TARGET) -> DataFrame:
    """vectors, queries: (id, v), as ``valid_vectors`` makes them. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    by_vector = Window.partitionBy("v").orderBy("id")
    kept = vectors.distinct().withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1)
    points = materialize(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "points")
    n = points.count()
    wanted = min(MOST, max(SAMPLE, n // SHARE))
    share = min(1.0, 1.3 * wanted / max(n, 1))
    rows = points.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).select("v", F.col("ids")[0].alias("id")).limit(wanted).toPandas().sort_values("id")
    if rows.empty:
        return spark.createDataFrame([], out_schema)
    dim = rows["v"].map(len).mode().max()
    tree = Tree(np.stack([np.asarray(x) for x in rows["v"] if len(x) == dim]))
    shared = spark.sparkContext.broadcast(tree)
    points = points.where(F.size("v") == int(dim))
    queries = queries.where(F.size("v") == int(dim)).distinct()
    asked = materialize(queries.groupBy("v").agg(F.min("id").alias("q")), "asked")
    n_asked = asked.count()

    def to_leaf(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.assign(_matrix(b.column(0))))], ["v", "ids", "h", "leaf"])

    placed = materialize(points.mapInArrow(to_leaf, "v array<double>, ids array<bigint>, h bigint, leaf int"), "placed")

    # Calibration: true neighbours of a few queries over all points, and the visit at which each one's leaf comes up.
    few = asked.orderBy(F.xxhash64("q"), "q").limit(CALIBRATION).toPandas()
    qs = np.stack([np.asarray(x) for x in few["v"]]) if len(few) else np.zeros((0, dim))
    tested = spark.sparkContext.broadcast(qs)

    def brute(batches):
        q = tested.value
        for b in batches:
            if b.num_rows and len(q):
                pos, d = distances(q, _matrix(b.column(0)), k + 1)  # which of tied points does not matter here
                leaf = b.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), pos.shape[1])), pa.array(leaf[pos].ravel()), pa.array(d.ravel())], ["q", "leaf", "d"])

    best = Window.partitionBy("q").orderBy("d", "leaf")
    true = placed.select("v", "leaf").mapInArrow(brute, "q bigint, leaf int, d double").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).toPandas()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves))} for q in qs]
    at = np.sort([order[q][leaf] for q, leaf, r in zip(true["q"], true["leaf"], true["r"], strict=True) if r > 1])
    visits = tree.leaves if not len(at) else min(tree.leaves, int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) + 1)

    sizes = {r[0]: r[1] for r in placed.groupBy("leaf").count().collect()}
    blocks = {leaf: -(-c // BLOCK_POINTS) for leaf, c in sizes.items()}
    groups = max(1, -(-n_asked * visits // max(1, len(sizes)) // GROUP_QUERIES))
    parts = spark.sparkContext.broadcast(blocks)

    def to_visits(batches):
        t, parts_of = shared.value, parts.value
        for b in batches:
            ids, leaves, pieces, at = [], [], [], []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else []):
                for leaf in t.visits(q, visits):
                    for p in range(parts_of.get(leaf, 0)):
                        at.append(i)
                        leaves.append(leaf)
                        pieces.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64())), pa.array(leaves, pa.int32()), pa.array(pieces, pa.int32())], ["q", "v", "leaf", "part"])

    going = asked.select("q", "v").mapInArrow(to_visits, "q bigint, v array<double>, leaf int, part int").withColumn("grp", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int"))
    n_parts = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("leaf"))
    split = placed.withColumn("part", F.pmod("h", n_parts).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("h")

    def meet(points_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if points_.empty or asked_.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64"), "ids": pd.Series(dtype=object)})
        out = []
        p = np.stack(list(points_["v"]))
        least = np.array([x[0] for x in points_["ids"]])
        for lo in range(0, len(asked_), 256):
            part = asked_.iloc[lo : lo + 256]
            pos, d = distances(np.stack(list(part["v"])), p, k + 1, least)
            out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), pos.shape[1]), "d": d.ravel(), "ids": [list(x) for x in points_["ids"].to_numpy()[pos.ravel()]]}))
        return pd.concat(out, ignore_index=True)

    key = ["leaf", "part", "grp"]
    met = split.groupBy(*key).cogroup(going.groupBy(*key)).applyInPandas(meet, "q bigint, d double, ids array<bigint>")
    first = Window.partitionBy("q").orderBy("d", "id")
    top = met.select("q", "d", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    named = queries.join(asked, "v").select("q", F.col("id").alias("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return named.join(top, "q").where("id <> query_id").withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = valid_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("id") % 100 == 0))
