"""Approximate nearest neighbours by cosine: balanced posting lists around centroids.

Centroids are fitted on a bounded sample and kept in memory in groups of near ones, the nodes of a graph whose edges join groups
with near hubs. A batch of vectors walks the graph in lockstep, each vector to its best group not yet visited, and
the vectors at a group are held against its centroids at once; a walk ends after `patience` groups without a nearer centroid.
A vector joins the lists whose centroids are nearly as near as its nearest one (boundary
vectors are replicated, `replicas` at most). A query visits every list within a wider distance ratio of its nearest centroid: groups
that cannot hold one, by their hub and radius, are left out, and the number of lists it visits has no cap. The ratio is widened until,
within the sample, the lists visited hold `recall` of the true neighbours (the sample is no denser
than the table, so its neighbours lie no nearer). Lists are
balanced: clusters of the sample above twice the mean are split, and in the deal a list is cut
into parts of at most `part` vectors, its queries into parts of at most `part`, so a list of any
size (copies of one vector, say) is many tasks of bounded size. Queries that find fewer than k this way (the lists near an
outlier may be small) are held against all vectors, so results are complete.

Every vector is indexed. Scores are exact cosines of the original vectors, in double precision.

Defined results: null, empty, zero and non-finite vectors, null ids and vectors of another than the
most frequent length take no part; rows of the query's own id are no candidates; rows that
repeat an id count once; ties go to the smaller id; fewer candidates give fewer rows; an empty table gives an empty result; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch
from .vectors import best, dimension, dots, matrix, usable


#: What rounding of a cosine near 1 does to a distance.
NOISE = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Centroids:
    """Unit centroids, in groups of about `size`, and the graph over the groups."""

    def __init__(self, c: np.ndarray, size: int = 64, degree: int = 12, entries: int = 8):
        hubs = fit_centroids(c, max(1, round(len(c) / size)), rounds=6)
        group = np.concatenate([(c[i : i + 4096] @ hubs.T).argmax(1) for i in range(0, len(c), 4096)])
        self.ids = np.argsort(group, kind="stable")
        self.c = np.ascontiguousarray(c[self.ids])
        cut = np.append(np.flatnonzero(np.diff(group[self.ids], prepend=-1)), len(c))
        self.start, self.stop = cut[:-1], cut[1:]
        total = np.add.reduceat(self.c, self.start)
        self.hubs = np.where((np.abs(total).max(1) > 1e-9)[:, None], _unit(total), self.c[self.start])
        g = len(self.hubs)
        self.radius = np.array([np.sqrt(np.maximum(2 - 2 * (self.c[a:b] @ h).min(), 0)) for a, b, h in zip(self.start, self.stop, self.hubs)])
        near = self.hubs @ self.hubs.T
        np.fill_diagonal(near, -2)
        self.edges = np.argsort(-near, axis=1, kind="stable")[:, : min(degree, g - 1)]
        if g > 1:  # a ring, so that every group can be reached
            self.edges = np.hstack([self.edges, (np.arange(g)[:, None] + 1) % g])
        self.entries = np.arange(0, g, max(1, -(-g // entries)))

    def search(self, x: np.ndarray, k: int, patience: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(lists, cosines) of the k centroids found nearest to each unit row of x, nearest first; -1 and -2 where fewer."""
        m, new, gone = len(x), -3.0, -5.0
        best, who, idle = np.full((m, k), -2.0), np.full((m, k), -1), np.zeros(m, int)
        hub = np.full((m, len(self.hubs)), new)  # groups met and not visited
        hub[:, self.entries] = x @ self.hubs[self.entries].T
        live = np.arange(m)
        while len(live):
            pick = hub[live].argmax(1)
            ok = hub[live, pick] > new
            live, pick = live[ok], pick[ok]
            hub[live, pick] = gone
            by = np.argsort(pick, kind="stable")
            cut = np.flatnonzero(np.diff(pick[by], prepend=-1))
            for rows, g in zip(np.split(live[by], cut[1:]), pick[by][cut]):
                a, b = self.start[g], self.stop[g]
                s = np.concatenate([best[rows], x[rows] @ self.c[a:b].T], axis=1)
                i = np.concatenate([who[rows], np.broadcast_to(np.arange(a, b), (len(rows), b - a))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(s, top, 1)
                idle[rows] = np.where(s.max(1) > best[rows].max(1), 0, idle[rows] + 1)
                best[rows], who[rows] = s, np.take_along_axis(i, top, 1)
            if self.edges.shape[1] and len(live):
                near = self.edges[pick]
                r, j = np.nonzero(hub[live[:, None], near] == new)
                hub[live[r], near[r, j]] = np.einsum("id,id->i", x[live[r]], self.hubs[near[r, j]])
            live = live[idle[live] < patience]
        order = np.argsort(-best, axis=1, kind="stable")
        who = np.take_along_axis(who, order, 1)
        return np.where(who >= 0, self.ids[who], -1), np.take_along_axis(best, order, 1)

    def reach(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every centroid at most (1 + ratio) times as far from a unit row of x as the nearest one found, by row."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        limit = (1 + ratio) * np.sqrt(np.maximum(2 - 2 * self.search(x, 1)[1][:, 0], 0)) + NOISE
        far = np.sqrt(np.maximum(2 - 2 * (x @ self.hubs.T), 0))
        rows, lists = [], []
        for g in range(len(self.hubs)):
            asked = np.flatnonzero(far[:, g] - self.radius[g] <= limit + NOISE)
            if len(asked):
                a, b = self.start[g], self.stop[g]
                r, i = np.nonzero(np.sqrt(np.maximum(2 - 2 * (x[asked] @ self.c[a:b].T), 0)) <= limit[asked, None])
                rows.append(asked[r])
                lists.append(self.ids[a + i])
        rows, lists = np.concatenate(rows), np.concatenate(lists)
        by = np.argsort(rows, kind="stable")
        return rows[by], lists[by]


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows; clusters above twice the mean size are split, the smallest given up."""
    rng = np.random.Generator(np.random.PCG64(7))
    distinct = np.unique(x, axis=0)
    lists = max(1, min(lists, len(distinct)))
    c = distinct[rng.choice(len(distinct), lists, replace=False)]
    step = max(64, (1 << 22) // lists)
    for r in range(rounds):
        near = np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        ok = (size > 0) & (np.abs(total).max(1) > 1e-9)
        c[ok] = _unit(total[ok])
        if r < rounds - 2:
            big = [k for k in np.argsort(-size) if size[k] > 2 * len(x) / lists]
            for k, gone in zip(big, np.argsort(size, kind="stable")):
                if size[gone] < len(x) / lists / 2:
                    c[gone] = x[rng.choice(np.flatnonzero(near == k))]
    return c


def within(order: np.ndarray, cos: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) where the distance is at most (1 + ratio) times that of the row's nearest centroid."""
    far = np.sqrt(np.maximum(2 - 2 * cos, 0))
    r, k = np.nonzero((far <= (1 + ratio) * far[:, :1] + 1e-12) & (cos > -2))
    return r, order[r, k]


def fit_ratio(x: np.ndarray, graph: Centroids, k: int, recall: float, replicas: int, replica_ratio: float, queries: int = 500) -> float:
    """The least probe ratio at which queries spread over the unit rows of x find `recall` of their k nearest rows."""
    need = [np.zeros(0)]
    for asked in np.array_split(np.arange(0, len(x), -(-len(x) // queries)), 10):
        k_ = min(k, len(x) - 1)
        if not len(asked) or k_ < 1:
            continue
        s = x[asked] @ x.T
        s[np.arange(len(asked)), asked] = -9
        near = np.argpartition(-s, k_ - 1, axis=1)[:, :k_]
        order, cos = graph.search(x[near.ravel()], replicas)
        r, lists = within(order, cos, replica_ratio)
        far = np.empty((len(asked), len(graph.ids)))
        far[:, graph.ids] = np.sqrt(np.maximum(2 - 2 * (x[asked] @ graph.c.T), 0))
        way = np.full(near.size, np.inf)
        np.minimum.at(way, r, np.maximum(far[r // k_, lists] - NOISE, 0))
        need.append(way / np.maximum(np.sqrt(np.maximum(2 - 2 * graph.search(x[asked], 1)[1][:, 0], 0)), 1e-12).repeat(k_) - 1)
    need = np.sort(np.concatenate(need))
    return float(need[max(0, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 0.0


def search(
    spark: SparkSession,
    df: DataFrame,
    *,
    k: int = 5,
    query_mod: int = 50,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    list_size: int = 512,
    max_lists: int = 16384,
    max_sample: int = 65536,
    replicas: int = 4,
    replica_ratio: float = 0.05,
    probe_ratio: float = 0.25,
    recall: float = 0.95,
    part: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `query_mod` divides."""
    rows = usable(df, id_col, vec_col, nonzero=True)
    dim, n = dimension(rows)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dim)
    scratch = Scratch(spark, "annsearch")
    share = min(1.0, max_sample / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    x = matrix(sample["v"], dim)
    x = _unit(x) if len(x) else np.eye(1, dim)
    fitted = fit_centroids(x, min(max_lists, -(-n // list_size)))
    ratio = max(probe_ratio, fit_ratio(x, Centroids(fitted), k, recall, replicas, replica_ratio))
    shared = spark.sparkContext.broadcast(fitted)  # max_lists x dim doubles at most

    def place(batches):
        graph = Centroids(shared.value)
        for batch in batches:
            ids, v = np.asarray(batch.column(0), np.int64), matrix(batch.column(1), dim)
            for a in range(0, len(ids), 1024):
                u = _unit(v[a : a + 1024])
                asked = np.flatnonzero(ids[a : a + 1024] % query_mod == 0)
                order, cos = graph.search(u, replicas)
                r, lists = within(order, cos, replica_ratio)
                qr, qlists = graph.reach(u[asked], ratio)
                at = np.concatenate([np.arange(len(u)), asked])
                held = np.concatenate([np.bincount(r, minlength=len(u)), np.bincount(qr, minlength=len(asked))])
                posts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(np.concatenate([lists, qlists]).astype(np.int32)))
                flag = np.arange(len(at)) >= len(u)
                yield pa.RecordBatch.from_arrays([posts, pa.array(flag), batch.column(0).slice(a, 1024).take(pa.array(at)), batch.column(1).slice(a, 1024).take(pa.array(at))], names=["lists", "asks", "vec_id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    posted = scratch.put(rows.mapInArrow(place, f"lists array<int>, asks boolean, vec_id long, v {kind}"), "postings")
    posted = posted.select(F.explode("lists").alias("list"), "asks", "vec_id", "v")  # a vector is written once, however many lists it is in
    slot = lambda n: F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def scored(posted: DataFrame) -> DataFrame:
        """The best of each list and query, from (list, asks, vec_id, v)."""
        sizes = posted.groupBy("list").agg(F.ceil(F.count_if(~F.col("asks")) / part).cast("int").alias("np"), F.ceil(F.count_if("asks") / part).cast("int").alias("nq")).where("np > 0 and nq > 0")
        dealt = posted.join(F.broadcast(sizes), "list")  # a row per list, max_lists at most
        vectors = dealt.where("not asks").withColumn("p", slot("np")).withColumn("q", F.explode(every("nq")))
        queries = dealt.where("asks").withColumn("q", slot("nq")).withColumn("p", F.explode(every("np")))
        cells = vectors.select("list", "p", "q", "asks", "vec_id", "v").union(queries.select("list", "p", "q", "asks", "vec_id", "v"))
        return cells.groupBy("list", "p", "q").applyInPandas(score, "query_id long, vec_id long, score double")

    def score(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates(["asks", "vec_id"])
        ask = cell["asks"].to_numpy()
        ids = cell["vec_id"].to_numpy()
        v = np.stack(cell["v"].to_numpy()).astype(np.float64)
        u = _unit(v)
        q, c = np.flatnonzero(ask), np.flatnonzero(~ask)
        out = []
        for i in range(0, len(q), 256):
            s = u[q[i : i + 256]] @ u[c].T
            s[ids[q[i : i + 256]][:, None] == ids[c][None, :]] = -9
            for row, j in zip(s, q[i : i + 256]):
                kth = np.partition(row, max(0, len(row) - k))[max(0, len(row) - k)]
                near = c[np.flatnonzero((row >= kth - 1e-9) & (row > -8))]
                exact = dots(v[near], np.broadcast_to(v[j], (len(near), dim))) / (np.sqrt(dots(v[near], v[near])) * np.sqrt(dots(v[j : j + 1], v[j : j + 1])))
                top = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(top), ids[j]), ids[near][top], exact[top]))
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    found = scratch.put(best(scored(posted), k), "found")
    ids = rows.select("vec_id").distinct()
    asked = ids.where(F.col("vec_id") % query_mod == 0)
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, ids.count() - 1)).select(F.col("query_id").alias("vec_id"))
    short = scratch.put(asked.join(enough, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    every_row = rows.select(F.lit(0).alias("list"), F.lit(False).alias("asks"), "vec_id", "v").union(rows.join(short, "vec_id", "left_semi").select(F.lit(0), F.lit(True), "vec_id", "v"))
    return found.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").union(best(scored(every_row), k))
