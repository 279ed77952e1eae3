"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams of 1 to 4 characters per language on a bounded sample of labelled
rows; the log-probability matrix is broadcast, and texts are scored in numpy, batch by batch, whole. Every label is learned: the
matrix has 2**bits columns, or as many fewer bits as keep it within `MATRIX_BYTES` where labels are many (over 256).

Defined results: a null or letterless text is ``und`` with score 0, as is every text where there is no label to learn from; rows with
a null or blank label teach nothing; of equally likely languages the first by name is taken; equal texts, so repeated rows, score
alike; an empty table gives an empty result; texts of any length are scored whole; extra columns are ignored unless `keep` names them.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import ship
from .textnum import char_starts, column_bytes, runs

UND = "und"
MATRIX_BYTES = 1 << 26


def id_remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def _fold_table() -> np.ndarray:
    """Lower case of the characters of the first planes that have a single-character one."""
    t = np.arange(0x3000, dtype=np.uint32)
    for i in range(0x3000):
        low = chr(i).lower()
        if len(low) == 1:
            t[i] = ord(low)
    return t


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["fold"] = _fold_table()
        _TABLES["letter"] = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x3000)])
    return _TABLES["fold"], _TABLES["letter"]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of a run of texts."""
    if len(raw) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    at = np.concatenate(([0], np.cumsum(char_starts(raw))))
    text = raw.tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), at[offsets]


def grams(cp: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[int, ...]):
    """For each n-gram order the hashed feature of the n-gram starting at each character; 2**bits
    (the empty feature) where it would leave the text."""
    shift = np.uint32(32 - bits)
    n = len(cp)
    ends = np.zeros(n + 1, bool)
    ends[offsets[1:]] = True
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint32)
        dead = np.zeros(n, bool)
        for order in range(1, max(orders) + 1):
            if order > n:
                return
            j = order - 1
            nxt = np.zeros(n, np.uint32)
            nxt[: n - j] = cp[j:]
            h = (h ^ nxt) * np.uint32(0x01000193) + np.uint32(0x9E3779B1 * order & 0xFFFFFFFF)
            if j:
                dead[: n - j] |= ends[j:n]
                dead[n - j :] = True
            if order in orders:
                f = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift
                f = f.astype(np.int64)
                f[dead] = 1 << bits
                yield f


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    prior: np.ndarray  # [language]
    logp: np.ndarray  # [language, 2**bits + 1], last column 0
    bits: int
    orders: tuple[int, ...]


def fit(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    bits: int = 15,
    orders: tuple[int, ...] = (1, 2, 3, 4),
    max_docs_per_lang: int = 3000,
    alpha: float = 0.1,
) -> LanguageModel:
    """Learn from at most about `max_docs_per_lang` rows (by hash of the id) of each label. What reaches the driver is
    bounded by the matrix."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null and length(trim(l)) > 0")
    n = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    langs = tuple(sorted(n))
    bits = max(1, min(bits, int(np.log2(MATRIX_BYTES / 8 / max(len(langs), 1)))))
    if not langs:
        return LanguageModel((), np.zeros(0), np.zeros((0, (1 << bits) + 1)), bits, orders)
    share = spark.createDataFrame([(x, min(1.0, max_docs_per_lang / n[x])) for x in langs], "l string, share double")
    sample = rows.join(F.broadcast(share), "l").where(F.pmod(F.xxhash64(F.lit(17), F.col("i")), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30)))  # a row per label
    size = (1 << bits) + 1

    def count(batches):
        counts = {}
        for batch in batches:
            raw, off = column_bytes(batch.column("t"))
            labels = batch.column("l").to_pylist()
            for a, b in runs(off):
                cp, at = code_points(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                cp = _fold(cp)
                who = np.repeat([index[x] for x in labels[a:b]], np.diff(at))
                for g in grams(cp, at, bits, orders):
                    for k in np.unique(who):
                        counts[k] = counts.get(k, 0) + np.bincount(g[who == k], minlength=size)
        for k, c in counts.items():
            c = c[:-1]
            f = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), k, np.int32)), pa.array(f.astype(np.int32)), pa.array(c[f].astype(np.int64))], names=["k", "f", "c"])

    index = {x: i for i, x in enumerate(langs)}
    total = np.zeros((len(langs), size - 1))
    got = sample.select("t", "l").mapInArrow(count, "k int, f int, c long").groupBy("k", "f").agg(F.sum("c").alias("c")).toArrow()
    total[got["k"].to_numpy(), got["f"].to_numpy()] = got["c"].to_numpy()
    logp = np.log(total + alpha) - np.log(total.sum(1, keepdims=True) + alpha * (size - 1))
    weight = np.array([n[x] for x in langs], float)
    return LanguageModel(langs, np.log(weight / weight.sum()), np.hstack([logp, np.zeros((len(langs), 1))]), bits, orders)


def _fold(cp: np.ndarray) -> np.ndarray:
    fold, _ = _tables()
    small = cp < 0x3000
    return np.where(small, fold[np.where(small, cp, 0)], cp)


def _has_letter(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    _, letter = _tables()
    small = cp < 0x3000
    is_letter = letter[np.where(small, cp, 0)] & small
    for i in np.flatnonzero(~small):
        is_letter[i] = unicodedata.category(chr(cp[i]))[0] == "L"
    total = np.concatenate(([0], np.cumsum(is_letter)))
    return total[at[1:]] > total[at[:-1]]


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """`keep` columns, lang_pred, score (posterior of the predicted language)."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = StructType(docs.select(*keep).schema.fields).add("lang_pred", "string").add("score", "double")

    def score(batches):
        m = shared.value
        for batch in batches:
            raw, off = column_bytes(batch.column(len(keep)))
            best, prob = [], []
            for a, b in runs(off):
                cp, at = code_points(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                known = _has_letter(cp, at) if len(m.langs) else np.zeros(b - a, bool)
                ll = np.tile(m.prior, (b - a, 1))
                full = np.flatnonzero(np.diff(at))
                for g in grams(_fold(cp), at, m.bits, m.orders):
                    for k in range(len(m.langs)):
                        ll[full, k] += np.add.reduceat(m.logp[k][g], at[full])
                if len(m.langs):
                    top = ll.argmax(1)
                    p = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
                    best += [m.langs[i] if ok else UND for i, ok in zip(top, known)]
                    prob += np.where(known, p, 0.0).tolist()
                else:
                    best += [UND] * (b - a)
                    prob += [0.0] * (b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.string()), pa.array(prob, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(score, schema)


def identify(spark: SparkSession, docs: DataFrame, *, mod: int = 4, held: int = 2, **params) -> DataFrame:
    """Fit on the rows whose id remainder is not `held`, predict all rows."""
    part = docs.withColumn("held_out", id_remainder("doc_id", mod) == held)
    model = fit(spark, part.where("not held_out"), **params)
    return predict(spark, part, model)
