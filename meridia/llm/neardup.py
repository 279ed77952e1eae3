"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact links.

Sets are the distinct shingles of `k` lower-cased words (64-bit hashes of them). Documents with the same
set are one class, represented by its smallest id. Classes that share a band of their
signatures are candidates. A pair is compared in batches of hashes and dropped as soon as the
posterior probability that its similarity reaches the threshold falls below `miss`; the rest
is confirmed on the full sets.

Buckets of any size are handled without emitting all their pairs. First each member is paired
with the bucket's hub, the member that lies in most shared buckets. Linked members form
components; only members outside their hub's component ("minors") can then still add
anything. Buckets of at most `small` members pair those across components; larger ones compare
blocks of minors with blocks of members inside tasks of bounded size, which also confirm what
survives there and emit only links. So every pair of a bucket that lies across components is tested, and
what is lost is bounded by the chance of sharing no band and by `miss`.

Defined results: null, empty or wordless texts have an empty set and are linked with nothing; fewer
than `k` words are one shingle; repeated rows share a class; ids are keys (rows that repeat an
id must repeat its text); of a component the smallest id is kept; texts and words of any length are handled whole, one document in one
task; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Scratch
from .textnum import P, column_bytes, inside, lower_ascii, mix, runs, span_hashes, window_hashes, words

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
CELL = 512  # documents of a block, and
WEIGHT = 200_000  # shingles of a block, on average at most


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text of a run."""
    low = lower_ascii(raw)
    start, end, at = words(low, offsets)
    h = span_hashes(low, start, end)
    w = window_hashes(h, k)
    out = []
    n = np.diff(at)
    for d in range(len(n)):
        if n[d] >= k:
            s = np.sort(w[at[d] : at[d + 1] - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n[d]:
            with np.errstate(over="ignore"):
                out.append(mix(window_hashes(h[at[d] : at[d + 1]], int(n[d])) * P + np.uint64(n[d])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """uint16[document, HASHES]: 16 bits of each minimum. Sets must not be empty."""
    a, b = _family()
    out = np.empty((len(sets), HASHES), np.uint32)
    sizes = np.array([len(s) for s in sets])
    i = 0
    with np.errstate(over="ignore"):
        while i < len(sets):
            total = np.cumsum(sizes[i:])
            j = i + max(1, int(np.searchsorted(total, 1 << 14)))
            flat = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
            first = np.concatenate(([0], np.cumsum(sizes[i : j - 1]))).astype(np.int64)
            y = np.empty_like(flat)
            for k in range(HASHES):
                np.multiply(flat, a[k], out=y)
                np.add(y, b[k], out=y)
                out[i:j, k] = np.minimum.reduceat(y, first)
            i = j
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64[document, BANDS]: the four values of a band are 64 bits, mixed with the band's number."""
    number = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    return mix(np.ascontiguousarray(sig).view(np.uint64) ^ number).view(np.int64)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared hashes (a multiple of BATCH), the fewest agreeing ones whose posterior
    P(similarity >= threshold), from a uniform prior, is at least `miss`."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def _survive(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature matrices pass the sequential test."""
    alive = np.arange(len(x))
    match = np.zeros(len(x), np.int32)
    for i, m in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        match[alive] += (x[alive, part] == y[alive, part]).sum(1, dtype=np.int32)
        alive = alive[match[alive] >= m]
    return alive


def features(spark: SparkSession, docs: DataFrame, *, k: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), sig, bands."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema.fields
    schema = StructType([*kind, *StructType.fromDDL("n_shingles long, set_key binary, sig binary, bands array<long>").fields])

    def run(batches):
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            n, keys, sigs, bands = [], [], [], [np.zeros((0, BANDS), np.int64)]
            for a, b in runs(off):
                sets = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
                full = [s for s in sets if len(s)]
                every = signatures(full) if full else np.zeros((0, HASHES), np.uint16)
                bands.append(band_keys(every))
                sig = iter(every)
                for s in sets:
                    n.append(len(s))
                    keys.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                    sigs.append(next(sig).tobytes() if len(s) else None)
            o = np.concatenate(([0], np.cumsum([BANDS if x else 0 for x in n]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(o), pa.array(np.concatenate(bands).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), lists], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """(v, l): the smallest id reachable from each vertex of `edges` (a, b; written), by minimum labels and pointer jumps."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    state = scratch.put(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("l")), f"{tag}-0")
    i = 0
    while True:
        near = both.join(state.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("l").alias("m"))
        hooked = state.join(near, "v").select("v", F.least("l", "m").alias("n"), "l")
        target = hooked.select(F.col("v").alias("n"), F.col("n").alias("far"))
        i += 1
        jumped = scratch.put(hooked.join(target, "n").select("v", F.col("far").alias("l"), (F.col("far") != F.col("l")).alias("moved")), f"{tag}-{i}")
        scratch.drop(f"{tag}-{i - 1}")
        state = jumped.select("v", "l")
        if not jumped.where("moved").limit(1).count():
            return state


class _Verifier:
    """Bayesian pruning, then confirmation on the full sets."""

    def __init__(self, scratch: Scratch, docs: DataFrame, sigs: DataFrame, k: int, percent: int, miss: float, id_col: str, text_col: str):
        self.scratch, self.docs, self.sigs, self.k, self.percent = scratch, docs.select(F.col(id_col).alias("v"), F.col(text_col).alias("t")), sigs, k, percent
        self.least = least_matches(percent / 100, miss)

    def prune(self, pairs: DataFrame) -> DataFrame:
        least = self.least
        rows = pairs.join(self.sigs.selectExpr("v as a", "sig as x"), "a").join(self.sigs.selectExpr("v as b", "sig as y"), "b").select("a", "b", "x", "y")

        def run(batches):
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
                keep = pa.array(_survive(x, y, least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

        return rows.mapInArrow(run, rows.select("a", "b").schema)

    def sets(self, ids: DataFrame, tag: str) -> DataFrame:
        """(v, s): the full sets of some documents (written)."""
        k = self.k
        texts = self.docs.join(ids, "v", "left_semi")
        schema = StructType([*texts.select("v").schema.fields, *StructType.fromDDL("s array<long>").fields])

        def run(batches):
            for batch in batches:
                raw, off = column_bytes(batch.column(1))
                sets = [s for a, b in runs(off) for s in shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                o = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(o), pa.array(flat))], names=schema.names)

        return self.scratch.put(texts.mapInArrow(run, schema), tag)

    def confirm(self, pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
        """The linked ones of `pairs` (written)."""
        both = pairs.join(sets.selectExpr("v as a", "s as x"), "a").join(sets.selectExpr("v as b", "s as y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        linked = both.withColumn("c", common).where(100 * F.col("c") >= self.percent * (F.size("x") + F.size("y") - F.col("c"))).select("a", "b").distinct()
        return self.scratch.put(linked, f"{tag}-links")


def _cells(rows: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Linked pairs (a, b) across components, from cells (bk, mi, mj) of minors and members with their full sets."""
    schema = "a long, b long"

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        first, second = cell[cell["minor"]], cell[~cell["minor"]]
        x, y = (np.frombuffer(b"".join(c["sig"]), np.uint16).reshape(-1, HASHES) for c in (first, second))
        ids, others = first["v"].to_numpy(), second["v"].to_numpy()
        comp, theirs = first["comp"].to_numpy(), second["comp"].to_numpy()
        mine, full = ([np.asarray(s).view(np.uint64) for s in c["s"]] for c in (first, second))
        size = np.array([len(s) for s in full])
        out = [np.zeros((0, 2), np.int64)]
        for i, s in enumerate(mine):
            j = np.flatnonzero((theirs != comp[i]) & (100 * np.minimum(size, len(s)) >= percent * np.maximum(size, len(s))))
            j = j[_survive(np.broadcast_to(x[i], (len(j), HASHES)), y[j], least)]
            if not len(j):
                continue
            flat = np.concatenate([full[t] for t in j])
            hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size[j])[:-1])))
            j = j[100 * common >= percent * (size[j] + len(s) - common)]
            out.append(np.column_stack([np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])]))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("bk", "mi", "mj").applyInPandas(run, schema)


def link(spark: SparkSession, docs: DataFrame, *, k: int = 5, percent: int = 75, miss: float = 1e-6, small: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    scratch = Scratch(spark, "neardup")
    feats = scratch.put(features(spark, docs, k=k, text_col=text_col, id_col=id_col), "features")
    # of a class all rows have the same signature
    classes = scratch.put(feats.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    sigs = classes.select(F.col("rep").alias("v"), "sig", "n")
    verifier = _Verifier(scratch, docs, sigs, k, percent, miss, id_col, text_col)

    # buckets with at least two classes
    banded = classes.select(F.col("rep").alias("v"), F.explode("bands").alias("bk"))
    sizes = scratch.put(banded.groupBy("bk").agg(F.count("*").alias("c")).where("c > 1"), "sizes")  # written, so that a skewed join can be split
    shared = scratch.put(banded.join(sizes, "bk"), "buckets")
    weight = scratch.put(shared.groupBy("v").agg(F.count("*").alias("p")), "weight")
    sets = verifier.sets(weight.select("v"), "sets")  # the texts travel once, those of documents that share a bucket
    hubs = scratch.put(shared.join(weight, "v").groupBy("bk").agg(F.max(F.struct("p", (-F.col("v")).alias("n"))).alias("h")).select("bk", (-F.col("h.n")).alias("hub")), "hubs")
    star = scratch.put(shared.join(hubs, "bk").where("v != hub").select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct(), "star")
    links = [verifier.confirm(verifier.prune(star), sets, "star")]
    comp = components(scratch, links[0], "first")

    # what lies across components of a bucket
    placed = shared.join(comp, "v", "left").select("bk", "c", "v", F.coalesce("l", "v").alias("comp"))
    mixed = scratch.put(placed.groupBy("bk").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bk"), "mixed")
    open_ = scratch.put(placed.join(mixed, "bk", "left_semi"), "open")
    few = open_.where(f"c <= {small}")
    across = few.alias("x").join(few.alias("y"), F.expr("x.bk = y.bk and x.v < y.v and x.comp != y.comp")).selectExpr("x.v as a", "y.v as b").distinct().join(star, ["a", "b"], "left_anti")
    links.append(verifier.confirm(verifier.prune(across), sets, "rest"))

    hub_comp = hubs.join(comp, F.col("hub") == F.col("v"), "left").select("bk", F.coalesce("l", "hub").alias("own"))
    many = open_.where(f"c > {small}").join(hub_comp, "bk").withColumn("minor", F.col("comp") != F.col("own"))
    many = many.join(sigs, "v")
    blocks = lambda who: F.ceil(F.greatest(F.count_if(who) / CELL, F.sum(F.when(who, F.col("n"))) / WEIGHT)).cast("int")
    load = scratch.put(many.groupBy("bk").agg(blocks(F.col("minor")).alias("ni"), blocks(F.lit(True)).alias("nj")), "load")
    many = many.join(load, "bk").join(sets, "v")
    block = lambda n: F.pmod(F.xxhash64(F.lit(5), "v"), F.col(n)).cast("int")
    minors = many.where("minor").withColumn("mi", block("ni")).withColumn("mj", F.explode(F.sequence(F.lit(0), F.col("nj") - 1)))
    members = many.withColumn("minor", F.lit(False)).withColumn("mj", block("nj")).withColumn("mi", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
    cells = reduce(DataFrame.unionByName, [x.select("bk", "mi", "mj", "v", "comp", "sig", "s", "minor") for x in (minors, members)])
    links.append(scratch.put(_cells(cells, verifier.least, percent).distinct(), "cell-links"))
    comp = components(scratch, reduce(DataFrame.union, links), "last")
    scratch.drop("sizes", "buckets", "mixed", "load", "hubs", "star", "open", "sets", "weight", "star-links", "rest-links", "cell-links")

    found = feats.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left").join(comp.withColumnRenamed("v", "rep"), "rep", "left")
    component = F.coalesce("l", "rep", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
