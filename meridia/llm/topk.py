"""Exact top-k by integer inner product, with block-at-a-time pruning.

Components become integers. Vectors are dealt into lists of similar ones (by the nearest of `max_lists` centroids at most,
fitted on a bounded sample; any dealing gives right results) and lists into parts of bounded size, which are
cut, by splits along the widest term, into ranges of at most `block` documents; for each list, part and range the largest and
smallest value of every term are kept. A query's bound for any of them is the sum over its terms of the larger product.

First each query is scored within its own part, which gives a k-th score to start from. It is then sent to the lists whose bound
reaches that score, and there scores the ranges through their forward index in order of their bounds until the bound falls
below the query's k-th best score. Where lists and ranges are no narrower than the table (vectors
without any structure), bounds prune little, and what is left is a blocked scan of all parts by all groups of queries.

Defined results: null, empty and non-finite vectors, null ids and vectors of another than the most
frequent length take no part (zero vectors do); rows of the query's own id are no candidates;
rows that repeat an id count once; ties go to the smaller id; fewer candidates give fewer rows;
scores beyond a long are held at its bounds; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .annsearch import fit_centroids
from .store import Scratch
from .vectors import best, dimension, matrix, usable


def ranges(x: np.ndarray, block: int) -> list[np.ndarray]:
    """Row numbers in ranges of at most `block` similar rows: halves along the widest term, until small enough."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        part = x[rows]
        by = np.argpartition(part[:, int(part.var(0).argmax())], len(rows) // 2)
        todo += [rows[by[len(rows) // 2 :]], rows[by[: len(rows) // 2]]]
    return out


def _whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): float64 where sums of products stay exact, Python integers elsewhere."""
    x = np.floor(v * scale)
    top = float(np.abs(x).max()) if x.size else 0.0
    if top * top * x.shape[1] < 2.0**53:
        return x
    return np.array([[int(y) for y in row] for row in x], dtype=object)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score within each pair of term maxima and minima."""
    zero = q * 0
    return np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T


def block_search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int, block: int, least: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int, int]:
    """(query ids, ids, scores) of the k best of each query, by rounds: each open query scores its next range; and how many
    ranges were scored, of how many. Ranges that can't reach `least` are left out."""
    parts = ranges(x.astype(np.float64), block)
    high, low = (np.stack([f(x[p]) for p in parts]) for f in (lambda y: y.max(0), lambda y: y.min(0)))
    bound = bounds(q, high, low)
    turn = np.argsort(-bound, axis=1, kind="stable")
    kept_s: list = [np.zeros(0, x.dtype)] * len(q)
    kept_i: list = [np.zeros(0, np.int64)] * len(q)
    need = np.full(len(q), -np.inf).astype(x.dtype) if least is None else least.astype(x.dtype)  # the k-th score so far, or the given one
    open_ = np.arange(len(q))
    scored = 0
    for r in range(len(parts)):
        nxt = turn[open_, r]
        ok = (bound[open_, nxt] >= need[open_]).astype(bool)
        open_, nxt = open_[ok], nxt[ok]
        if not len(open_):
            break
        by = np.argsort(nxt, kind="stable")
        cut = np.flatnonzero(np.diff(nxt[by], prepend=-1))
        for mine, b in zip(np.split(open_[by], cut[1:]), nxt[by][cut]):
            part = parts[b]
            scored += len(mine)
            s = q[mine] @ x[part].T
            for row, j in zip(*((y[hit] for y in (s, mine)) if (hit := (s.max(1) >= need[mine]).astype(bool)).any() else ((), ()))):
                other = (ids[part] != qids[j]) & (row >= need[j]).astype(bool)
                ss, ii = np.concatenate([kept_s[j], row[other]]), np.concatenate([kept_i[j], ids[part][other]])
                top = np.lexsort((ii, -ss))[:k] if ss.dtype != object else np.array(sorted(range(len(ss)), key=lambda t: (-ss[t], ii[t]))[:k], int)
                kept_s[j], kept_i[j] = ss[top], ii[top]
                if len(top) == k and kept_s[j][-1] > need[j]:
                    need[j] = kept_s[j][-1]
    return [(np.full(len(s), qids[j]), kept_i[j], s) for j, s in enumerate(kept_s)], scored, len(parts) * len(q)


def search(
    spark: SparkSession,
    df: DataFrame,
    *,
    k: int = 5,
    query_mod: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    list_size: int = 2048,
    max_lists: int = 1024,
    max_sample: int = 20000,
    segment: int = 4096,
    group: int = 8192,
    block: int = 64,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each row whose id `query_mod` divides."""
    rows = usable(df, id_col, vec_col, nonzero=False)
    dim, n = dimension(rows)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == dim)
    scratch = Scratch(spark, "topk")
    share = min(1.0, max_sample / n)
    sample = matrix(rows.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()["v"], dim)
    size = float(np.abs(sample).max()) if sample.size else 0.0
    sample = sample[np.abs(sample).max(1) > 0] / size if size else sample[:0]
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    centres = fit_centroids(unit(sample), min(max_lists, -(-n // list_size)), rounds=5) if len(sample) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centres)  # max_lists x dim doubles at most
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            near = np.concatenate([np.zeros(0, np.int64), *((x[a : a + 1024] @ shared.value.T).argmax(1) for a in range(0, len(x), 1024))])
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], names=["list", "vec_id", "v"])

    placed = scratch.put(rows.mapInArrow(place, f"list int, vec_id long, v {kind}"), "placed")
    slot = lambda m: F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / segment).cast("int").alias("np"))
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("p", slot("np"))  # a row per list, max_lists at most
    asks = F.col("vec_id") % query_mod == 0

    def own(cell: pd.DataFrame) -> pd.DataFrame:
        """The k-th score of each query of a part within it, and the part's term maxima and minima."""
        x = _whole(np.stack(cell["v"].to_numpy()).astype(np.float64), scale)
        ids = cell["vec_id"].to_numpy()
        _, one = np.unique(ids, return_index=True)
        x, ids = x[one], ids[one]
        ask = np.flatnonzero(ids % query_mod == 0)
        got = block_search(x, ids, x[ask], ids[ask], k, block)[0] if len(ask) else []
        least = [float(s[-1]) * (1 - 1e-12 * np.sign(float(s[-1]))) if len(s) == k else -np.inf for *_, s in got]
        edge = [[float(y) for y in f(x)] for f in (lambda y: y.max(0), lambda y: y.min(0))]
        out = pd.DataFrame({"list": int(cell["list"].iloc[0]), "vec_id": ids[ask], "least": np.array(least, float)})
        out["high"], out["low"] = None, None
        return pd.concat([out, pd.DataFrame({"list": [int(cell["list"].iloc[0])], "vec_id": [None], "least": [None], "high": [edge[0]], "low": [edge[1]]})], ignore_index=True)

    first = scratch.put(dealt.select("list", "p", "vec_id", "v").groupBy("list", "p").applyInPandas(own, "list int, vec_id long, least double, high array<double>, low array<double>"), "first")
    edges = first.where("vec_id is null").groupBy("list").agg(*[F.array(*[f(F.col(c)[i]) for i in range(dim)]).alias(c) for c, f in (("high", F.max), ("low", F.min))]).collect()
    shared_edges = spark.sparkContext.broadcast((np.array([r["list"] for r in edges], np.int32), np.array([r["high"] for r in edges]), np.array([r["low"] for r in edges])))  # max_lists rows at most

    def send(batches):
        """The lists that a query must visit. Bounds are floats here: a margin beyond their rounding is kept."""
        which, high, low = shared_edges.value
        for batch in batches:
            v, least = matrix(batch.column(1), dim), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), float)
            out = []
            for a in range(0, len(v), 1024):
                q = np.floor(v[a : a + 1024] * scale)
                b = bounds(q, high, low)
                slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)
                out += [which[row] for row in b + slack >= least[a : a + 1024, None]]
            o = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(o), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))], names=["vec_id", "v", "least", "lists"])

    known = first.where("vec_id is not null").groupBy("vec_id").agg(F.max("least").alias("least"))
    queries = placed.where(asks).select("vec_id", "v").join(known, "vec_id").mapInArrow(send, f"vec_id long, v {kind}, least double, lists array<int>")
    queries = scratch.put(queries, "queries").select(F.explode("lists").alias("list"), "vec_id", "v", "least")
    load = queries.groupBy("list").agg(F.ceil(F.count("*") / group).cast("int").alias("nq"))
    vectors = dealt.join(F.broadcast(load), "list").withColumn("g", every("nq")).select("list", "p", "g", "vec_id", "v", F.lit(None).cast("double").alias("least"), F.lit(False).alias("asks"))
    asked = queries.join(F.broadcast(load), "list").join(F.broadcast(sizes), "list").withColumn("g", slot("nq")).withColumn("p", every("np")).select("list", "p", "g", "vec_id", "v", "least", F.lit(True).alias("asks"))

    def score(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates(["asks", "vec_id"])
        ask, ids = cell["asks"].to_numpy(), cell["vec_id"].to_numpy()
        x = _whole(np.stack(cell["v"].to_numpy()).astype(np.float64), scale)
        got = block_search(x[~ask], ids[~ask], x[ask], ids[ask], k, block, cell["least"].to_numpy()[ask])[0] if ask.any() and not ask.all() else []
        a, b, s = (np.concatenate(y) for y in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        if s.dtype == object:
            s = np.array([min(max(int(y), -(2**63)), 2**63 - 1) for y in s], np.int64)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s.astype(np.int64)})

    return best(vectors.union(asked).groupBy("list", "p", "g").applyInPandas(score, "query_id long, vec_id long, score long"), k)
