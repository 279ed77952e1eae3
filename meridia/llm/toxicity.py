"""Toxic passages: maximum-scoring segments over token log-odds.

Learning: for each token feature (the word, and apart from words its shorter prefixes of 3 to 6 characters,
hashed) the log-odds between toxic and clean documents with an informative Dirichlet prior;
features below `min_z` score nothing. A token scores its strongest feature less a drift, so
clean text has a negative expectation. Scoring: all maximal-scoring segments of a
document are found in one linear scan (only tokens with a positive score start anything),
their scores become bits by the extreme-value law of local maxima under the clean-text
score distribution (lambda, K), and the bits beyond the document's expected maximum feed a
logistic calibration: those of the best passage, those of all, also per word, and the share of toxic words. A second one sees
the best passage alone, so that a passage counts in a document of any length; the higher score stands. They are cross-fitted: each half of the sample is scored by features learned on the other (in a sample
so small that a half has no significant feature, on all of it).

Defined results: a null, empty or wordless text has no segment and gets the score of a
document without one, as do all rows of a table without toxic words; rows with a null label teach nothing, an id
labelled twice counts as toxic if any label says so; with no label of either class, or none at all, all scores are 0; equal texts have equal
scores, so repeated rows score alike; an empty table gives an empty result; texts of any length are scored whole; extra columns are
ignored unless `keep` names them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Scratch, ship
from .textnum import char_starts, column_bytes, lower_ascii, mix, runs, span_hashes, spans

PREFIXES = (3, 4, 5, 6)
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes and the spans of letters and digits (every non-ASCII byte is a letter)."""
    low = lower_ascii(raw)
    return (low, *spans(_GAP[raw], offsets))


def features(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of each token's features: the word, then its shorter prefixes (the word again where there is none).
    A prefix is another feature than the word of its letters."""
    word = span_hashes(low, start, end)
    out = [word]
    lead = char_starts(low)
    at = np.concatenate(([0], np.cumsum(lead)))
    where = np.concatenate((np.flatnonzero(lead), [len(low)]))
    for k in PREFIXES:
        first = at[start]  # index of the token's first character
        stop = np.minimum(where[np.minimum(first + k, len(where) - 1)], end)
        out.append(np.where(stop < end, mix(span_hashes(low, start, stop) + np.uint64(1)), word))
    return out


@dataclass
class ToxicityModel:
    keys: np.ndarray = field(repr=False)  # hashes of the significant features, ascending
    gain: np.ndarray = field(repr=False)  # their log-odds
    drift: float = 0.5
    lam: float = 1.0
    k: float = 0.1
    weights: np.ndarray = field(default_factory=lambda: np.zeros((2, 5)))
    fitted: bool = False

    def token_gain(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The log-odds of each token's strongest feature, 0 if none is significant."""
        out = np.zeros(len(start))
        if not len(self.keys):
            return out
        maybe = np.zeros(1 << 16, bool)
        maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for f in features(low, start, end):
            i = np.flatnonzero(maybe[(f & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, f[i]), len(self.keys) - 1)
            out[i] = np.maximum(out[i], np.where(self.keys[at] == f[i], self.gain[at], 0.0))
        return out


def maximal_segments(pos: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence whose items at `pos` add
    `gain` and whose other items subtract `drift`. Linear-time stack scan."""
    stack: list[list[float]] = []  # [left total before, right total after, first, last]
    total, before = 0.0, -1
    for p, g in zip(pos.tolist(), gain.tolist()):
        total -= drift * (p - before - 1)
        left, total, before = total, total + g, p
        cur = [left, total, p, p]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= cur[0]:
                j -= 1
            if j < 0 or stack[j][1] >= cur[1]:
                stack.append(cur)
                break
            cur = [stack[j][0], cur[1], stack[j][2], cur[3]]
            del stack[j:]
    return [(int(a), int(b), r - l) for l, r, a, b in stack]


def segments_of(raw, offsets, m: ToxicityModel):
    """Of a run of documents: token spans, each one's maximal segments with their bits, and what the calibration sees."""
    low, start, end, at = tokens(raw, offsets)
    gain = m.token_gain(low, start, end)
    hot = np.flatnonzero(gain > m.drift)
    out: list = [()] * (len(offsets) - 1)
    x = np.zeros((len(out), 5))
    x[:, 0] = 1
    owner = np.searchsorted(at, hot, side="right") - 1
    for d in np.unique(owner):
        mine = hot[np.searchsorted(owner, d) : np.searchsorted(owner, d, side="right")]
        n = int(at[d + 1] - at[d])
        found = maximal_segments(mine - at[d], gain[mine] - m.drift, m.drift)
        bits = [(a, b, (m.lam * s - np.log(max(m.k * n, 1e-9))) / np.log(2)) for a, b, s in found]
        out[d] = tuple(v for v in bits if v[2] > 0)
        each = [v[2] for v in out[d]] or [0.0]
        x[d, 1:] = np.log1p([max(each), sum(each), 1000 * len(mine) / n, 100 * sum(each) / n])
    return start, end, at, out, x


def karlin_altschul(values: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """lambda > 0 with E[exp(lambda s)] = 1, and a conservative K (share of items that start a segment)."""
    up = values > 0
    if not up.any() or (values * share).sum() >= 0:
        return 1.0, 1.0
    lo, hi = 1e-9, 1.0
    f = lambda lam: (share * np.exp(np.minimum(lam * values, 700))).sum() - 1
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi, float(share[up].sum())


def fit(spark: SparkSession, docs: DataFrame, marks: DataFrame, *, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_docs: int = 8000, prior: float = 50.0, min_z: float = 3.5, min_odds: float = 1.5, drift: float = 0.5) -> ToxicityModel:
    """Learn from at most about `max_docs` labelled rows of each class (by hash of the id).

    `marks` has one row per labelled id. The sampled marks are the broadcast side (bounded by
    2 * max_docs rows). What reaches the driver is bounded by the sample: the significant features
    among those that two toxic documents of it share, and 2 * max_docs calibration rows."""
    labels = marks.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    n = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    model = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), drift)
    if len(n) < 2:
        return model
    share = F.when(F.col("y") == 1, F.lit(min(1.0, max_docs / n[1]))).otherwise(F.lit(min(1.0, max_docs / n[0])))
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(29), F.col("i")), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    scratch = Scratch(spark, "toxicity")
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    half = F.pmod(F.xxhash64(F.lit(31), F.col("i")), F.lit(2)).cast("int")
    sample = scratch.put(texts.join(F.broadcast(chosen), "i").select("t", "y", half.alias("half")), "sample")

    def count(batches):
        """Documents of each class that hold a feature, by half of the sample."""
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            group = np.asarray(batch.column(2), np.int64) * 2 + np.asarray(batch.column(1), np.int64)
            held: list = [[] for _ in range(4)]
            for a, b in runs(off):
                low, start, end, at = tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                key = np.stack(features(low, start, end))
                for d in range(b - a):
                    held[group[a + d]].append(np.unique(key[:, at[d] : at[d + 1]]))
            for g in range(4):
                f, c = np.unique(np.concatenate(held[g] or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), *(pa.array(c * (g == k)) for k in range(4))], names=["f", "a0", "a1", "b0", "b1"])

    size = {(h, y): 0 for h in (0, 1) for y in (0, 1)} | {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}

    if not (size[0, 0] + size[1, 0] and size[0, 1] + size[1, 1]):  # labels of documents that aren't here
        scratch.close()
        return model

    def odds(c0, c1, n0: int, n1: int):
        """The log-odds of a feature, null if it isn't significant."""
        rate = (c0 + c1 + 0.5) / (n0 + n1 + 1)
        log_odds = lambda c, n: F.log((c + prior * rate) / F.greatest(n + prior - c - prior * rate, F.lit(0.5)))
        delta = log_odds(c1, n1) - log_odds(c0, n0)
        z = delta / F.sqrt(1 / (c1 + prior * rate) + 1 / (c0 + prior * rate))
        return F.when((c1 >= 2) & (z >= min_z) & (delta >= min_odds), delta)

    a0, a1, b0, b1 = (F.col(x) for x in ("a0", "a1", "b0", "b1"))
    of_half = [odds(b0, b1, size[1, 0], size[1, 1]).alias("d0"), odds(a0, a1, size[0, 0], size[0, 1]).alias("d1")]  # from the other half
    whole = odds(a0 + b0, a1 + b1, size[0, 0] + size[1, 0], size[0, 1] + size[1, 1]).alias("d")
    counts = sample.mapInArrow(count, "f long, a0 long, a1 long, b0 long, b1 long").groupBy("f").agg(*[F.sum(x).alias(x) for x in ("a0", "a1", "b0", "b1")])
    got = counts.select("f", *of_half, whole).where("d0 is not null or d1 is not null or d is not null").toArrow()
    f = got["f"].to_numpy().view(np.uint64)
    order = np.argsort(f)
    models = []
    for name in ("d0", "d1", "d"):
        gain = got[name].to_numpy()[order].astype(float)
        models.append(ToxicityModel(f[order][~np.isnan(gain)], gain[~np.isnan(gain)], drift))

    def clean_scores(batches):
        """Histogram of token scores (in twentieths) over clean documents, for each model over those it was learned on."""
        hist: dict[tuple, int] = {}
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            halves = np.asarray(batch.column(2), np.int64)
            for a, b in runs(off):
                low, start, end, at = tokens(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                of = np.repeat(halves[a:b], np.diff(at))
                for k, m in enumerate(models):
                    gain = m.token_gain(low, start, end)
                    for v, c in zip(*np.unique(np.round((gain if k == 2 else gain[of != k]) * 20).astype(np.int64), return_counts=True)):
                        hist[k, int(v)] = hist.get((k, int(v)), 0) + int(c)
        k, v = zip(*hist) if hist else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v, pa.int64()), pa.array(list(hist.values()), pa.int64())], names=["k", "v", "c"])

    bins = sample.where("y = 0").mapInArrow(clean_scores, "k int, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c")).collect()
    for k, m in enumerate(models):
        seen = {r["v"]: r["c"] for r in bins if r["k"] == k}
        for v in np.unique(np.round(m.gain * 20).astype(int)):  # what clean text may hold at least
            seen[int(v)] = seen.get(int(v), 0) + 0.5
        values, weight = np.array(list(seen), float) / 20 - drift, np.array(list(seen.values()), float)
        if len(values):
            m.lam, m.k = karlin_altschul(values, weight / weight.sum())
    model = models[2]
    judges = models[:2] if len(models[0].keys) and len(models[1].keys) else [model, model]

    def observe(batches):
        for batch in batches:
            raw, off = column_bytes(batch.column(0))
            halves = np.asarray(batch.column(2), np.int64)
            x = [np.zeros((0, 5))]
            for a, b in runs(off):
                both = [segments_of(raw[off[a] : off[b]], off[a : b + 1] - off[a], m)[4] for m in judges]
                x.append(np.where(halves[a:b, None] == 0, *both))
            x = np.concatenate(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(1, 5)), batch.column(1)], names=["x1", "x2", "x3", "x4", "y"])

    seen = sample.mapInArrow(observe, "x1 double, x2 double, x3 double, x4 double, y int").toArrow()
    x = np.column_stack([np.ones(len(seen)), *(seen[f"x{k}"].to_numpy() for k in range(1, 5))])
    y = seen["y"].to_numpy().astype(float)
    model.weights = np.stack([_logistic(x, y), np.append(_logistic(x[:, :2], y), np.zeros(3))])
    model.fitted = True
    scratch.close()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, with non-negative slopes."""
    free = list(range(x.shape[1]))
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = (x.T @ (y - p) - ridge * np.r_[0.0, w[1:]])[free]
            h = ((x * (p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, [ridge] * (x.shape[1] - 1)]))[np.ix_(free, free)]
            step = np.linalg.solve(h, g)
            w[free] += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k in free if k and w[k] < 0]
        if not bad:
            return w
        free.remove(min(bad, key=lambda k: w[k]))


def score(spark: SparkSession, docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """`keep` columns, score, predicted, and the significant passages (code points, end exclusive)."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    out = StructType.fromDDL("score double, predicted int, passages array<struct<start:int,end:int,bits:double>>")
    schema = StructType([*docs.select(*keep).schema.fields, *out.fields])

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for batch in batches:
            raw, off = column_bytes(batch.column(len(keep)))
            x, passages = [], []
            for a, b in runs(off):
                part, base = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                start, end, at, found, seen = segments_of(part, base, m)
                x.append(seen)
                points = np.concatenate(([0], np.cumsum(char_starts(part)))) if any(found) else None
                for d, f in enumerate(found):
                    passages.append([{"start": int(points[start[at[d] + i]] - points[base[d]]), "end": int(points[end[at[d] + j]] - points[base[d]]), "bits": float(v)} for i, j, v in f])
            s = np.zeros(len(batch))
            if m.fitted and len(batch):
                s = 1 / (1 + np.exp(-np.clip((np.concatenate(x) @ m.weights.T).max(1), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(passages, kind)], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def detect(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, mod: int = 3, held: int = 1, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Learn from the labelled rows whose id remainder is not `held`; score every row of `docs`."""
    from .langid import id_remainder

    marks = labels.select(F.col("doc_id").alias("i"), "toxic").where("toxic is not null").where(~(id_remainder("i", mod) == held)).groupBy("i").agg(F.max("toxic").alias("toxic"))
    model = fit(spark, docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), marks, id_col="i", text_col="t", **params)
    return score(spark, docs.withColumn("held_out", id_remainder(id_col, mod) == held), model, text_col=text_col, keep=(*keep, "held_out"), threshold=threshold)
