"""Removal of repeated passages: windows of words that occur more than once in the corpus.

Documents of the same words are one class: of a class of several, every window repeats, so its documents are settled
at once, and one of them stands for the class in what follows.

Consecutive windows that share a minimiser (the least hash among the runs of `m` words inside the
window, leftmost on ties) form a super-k-mer. Equal windows have equal minimisers, so a window can
repeat only if its minimiser occurs in two super-k-mers; only those travel on, each as one
packed string of its words, equal strings collapsed to one with a count, to the bucket of their
minimiser, where sorting the windows counts them exactly. A window occurs at most once in a
super-k-mer, since its minimiser's place in it is fixed. Minimisers whose different strings
exceed `hot_bytes` together, the most that one task should sort at once, are split: their windows
are counted one by one under their own hash, summed before the shuffle (equal results).
Windows are compared by two 64-bit hashes of their words, taken from two unlike hashes of the words' bytes.

Defined results: null, empty and short texts have no window and lose nothing; repeated rows are
copies, so all their windows go, and each of them gives one row; rows that share an id but not the text are
documents of their own, as are rows without an id; texts and words may be of any length (a batch of rows is bounded in
bytes, a document is handled whole in one task); an empty table gives an empty result; extra columns, whatever
their names, are ignored by `dedup` and kept by `remove`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Scratch, flat_lists, named, plain
from .textnum import column_bytes, inside, runs, span_hashes, window_hashes, words


def super_kmers(h: np.ndarray, at: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer over the word hashes of a run of documents."""
    ok = inside(at, window)
    none = np.zeros(0, np.int64)
    if not ok.any():
        return none, none, none
    mins = window_hashes(h, m)
    bits = np.uint64(max(20, int(len(mins)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (mins & ~low) | np.arange(len(mins), dtype=np.uint64)
    span, width = window - m + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    place = (key & low).astype(np.int64)  # where the minimiser of each window is
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (place[1:] != place[:-1])
    return first, np.flatnonzero(last) - first + 1, mins[place[first]].view(np.int64)


def _scan(docs: DataFrame, window: int, m: int) -> DataFrame:
    """Of (doc_id, t, h): doc_id, h, n_words, words_sha256 and the super-k-mers (first window, windows, minimiser)."""
    schema = StructType([docs.schema["doc_id"], docs.schema["h"], *StructType.fromDDL("n_words long, words_sha256 string, s array<int>, n array<int>, m array<long>").fields])

    def run(batches):
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            count, sha, first, size, mini, each = [], [], [], [], [], [np.zeros(1, np.int64)]
            for a, b in runs(off):
                part, base = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                start, end, at = words(part, base)
                f, n, k = super_kmers(span_hashes(part, start, end), at, window, m)
                doc = np.searchsorted(at, f, side="right") - 1
                first.append(f - at[doc])
                size.append(n)
                mini.append(k)
                each.append(np.bincount(doc, minlength=b - a))
                count.append(np.diff(at))
                for d in range(b - a):
                    sha.append(hashlib.sha256(b" ".join(part[base[d] : base[d + 1]].tobytes().split())).hexdigest())
            o = pa.array(np.cumsum(np.concatenate(each)).astype(np.int32))
            flat = lambda x, kind: pa.ListArray.from_arrays(o, pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate([np.zeros(0, np.int64), *count]).astype(np.int64)), pa.array(sha, pa.string()), flat(first, np.int32), flat(size, np.int32), flat(mini, np.int64)],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


#: Keys of the strings that a task has sent, which it needn't send again.
SENT = 200_000
PACK_BYTES = 4 << 20


def _packed(texts: DataFrame, window: int) -> DataFrame:
    """A row per super-k-mer of `texts` (doc_id, h, t, copies, list of (s, n, m)): the 128-bit key of its packed string, and
    the string itself unless the task has sent it before."""
    schema = StructType([texts.schema["doc_id"], texts.schema["h"], *StructType.fromDDL("copies boolean, s int, m long, key binary, packed binary").fields])

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            raw, off = column_bytes(batch.column(2))
            o, s, n, m = flat_lists(batch.column(4), 0, 1, 2)
            keys, packs, held, lo = [], [], 0, 0
            for d in range(len(batch)):
                w = raw[off[d] : off[d + 1]].tobytes().split()
                for i in range(o[d], o[d + 1]):
                    p = b" ".join(w[s[i] : s[i] + n[i] + window - 1])
                    key = hashlib.blake2b(p, digest_size=16).digest()
                    keys.append(key)
                    if key in sent:
                        packs.append(None)
                    else:
                        packs.append(p)
                        held += len(p)
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                    if i + 1 < o[-1] and len(keys) < 20000 and held < PACK_BYTES:
                        continue
                    who = pa.array(np.searchsorted(o, np.arange(lo, i + 1), side="right") - 1)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(who) for c in (0, 1, 3)), pa.array(s[lo : i + 1]), pa.array(m[lo : i + 1]), pa.array(keys, pa.binary()), pa.array(packs, pa.binary())], names=schema.names
                    )
                    keys, packs, held, lo = [], [], 0, i + 1

    return texts.mapInArrow(run, schema)


def _windows(packs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pack, place in it, two hashes) of every window of packed strings."""
    raw = np.frombuffer(b"".join(packs), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(p) for p in packs]))).astype(np.int64)
    start, end, at = words(raw, off)
    h1, h2 = (window_hashes(span_hashes(raw, start, end, family), window) for family in (0, 1))
    i = np.flatnonzero(inside(at, window))
    pack = np.searchsorted(at, i, side="right") - 1
    return pack, i - at[pack], h1[i], h2[i]


def _count_buckets(packs: DataFrame, window: int) -> DataFrame:
    """(key, mask): bit i of the mask is set if window i of the string repeats. Rows come sorted by minimiser."""

    def count(keys, packed, c):
        pack, place, h1, h2 = _windows(packed, window)
        by = np.lexsort((h2, h1))
        same = (h1[by][1:] == h1[by][:-1]) & (h2[by][1:] == h2[by][:-1])
        group = np.concatenate(([0], np.cumsum(~same))) if len(by) else np.zeros(0, np.int64)
        total = np.bincount(group, weights=np.asarray(c, float)[pack[by]])
        again = by[total[group] >= 2] if len(by) else by
        mask = np.zeros(len(keys), np.int64)
        np.bitwise_or.at(mask, pack[again], np.int64(1) << place[again])
        hit = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), pa.array(mask[hit])], names=["key", "mask"])

    def run(batches):
        keys, packed, c, mini, held = [], [], [], [], 0
        for batch in batches:
            for m, key, p, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (len(keys) >= 5000 or held >= PACK_BYTES) and m != mini[-1]:  # a bucket is counted whole
                    yield count(keys, packed, c)
                    keys, packed, c, mini, held = [], [], [], [], 0
                mini.append(m)
                keys.append(key)
                packed.append(p)
                c.append(n)
                held += len(p)
        if keys:
            yield count(keys, packed, c)

    return packs.select("m", "key", "packed", "c").repartition("m").sortWithinPartitions("m").mapInArrow(run, "key binary, mask long")


def _count_split(packs: DataFrame, window: int) -> DataFrame:
    """The same for the strings of hot minimisers: windows are counted under their own hash."""

    def run(batches):
        for batch in batches:
            keys, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo, held = 0, 0
            for i in range(len(keys)):
                held += len(packed[i])
                if held < PACK_BYTES and i + 1 < len(keys):
                    continue
                pack, place, h1, h2 = _windows(packed[lo : i + 1], window)
                at = pa.array(pack + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(place.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(2).take(at)], names=["key", "i", "h1", "h2", "c"])
                lo, held = i + 1, 0

    rows = packs.select("key", "packed", "c").mapInArrow(run, "key binary, i int, h1 long, h2 long, c long")
    again = rows.groupBy("h1", "h2").agg(F.sum("c").alias("t")).where("t >= 2").select("h1", "h2")
    return rows.join(again, ["h1", "h2"], "left_semi").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def _same_row(a: DataFrame, b: DataFrame):
    """Rows of the same id (or of none) and text."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def repeated_windows(scratch: Scratch, docs: DataFrame, *, window: int, m: int, hot_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (doc_id, t, h): the scan (doc_id, h, n_words, words_sha256), the classes of several documents with windows
    (words_sha256), and for the other documents the super-k-mers that hold repeated windows (doc_id, h, list of (s, mask))."""
    scan = scratch.put(_scan(docs, window, m), "scan")
    # of a class of copies one row goes on (with its repeated rows, if any: that changes no count to or from one)
    groups = scan.where(F.col("n_words") >= window).groupBy("words_sha256").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "h")).alias("first"))
    copies = scratch.put(groups.where("c > 1").select("words_sha256", F.lit(True).alias("copies"), "first"), "copies")  # written, so that a skewed join can be split
    alone = scan.where(F.size("s") > 0).join(copies, "words_sha256", "left").where("copies is null or (doc_id <=> first.doc_id and h = first.h)")
    found = alone.select("doc_id", "h", F.coalesce("copies", F.lit(False)).alias("copies"), F.explode(F.arrays_zip("s", "n", "m")).alias("x")).select("doc_id", "h", "copies", "x.s", "x.n", "x.m")
    weight = F.sum(F.when(F.col("copies"), 2).otherwise(1))
    repeated = scratch.put(found.groupBy("m").agg(weight.alias("c")).where("c >= 2").select("m"), "repeated")
    chosen = found.join(repeated, "m", "left_semi").groupBy("doc_id", "h").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("s", "n", "m")).alias("x"))
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "copies", "x")
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))).select("doc_id", "h", "t", "copies", "x")
    packs = scratch.put(_packed(texts, window), "packs")
    scratch.drop("repeated")
    strings = packs.groupBy("key").agg(F.first("m").alias("m"), F.max("packed").alias("packed"), weight.alias("c"))
    strings = scratch.put(strings, "strings")
    busy = scratch.put(strings.groupBy("m").agg(F.sum(F.length("packed")).alias("b")).where(f"b > {hot_bytes}").select("m"), "busy")
    masks = _count_buckets(strings.join(busy, "m", "left_anti"), window).union(_count_split(strings.join(busy, "m", "left_semi"), window))
    hits = scratch.put(packs.where("not copies").select("doc_id", "h", "s", "key").join(masks, "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "mask")).alias("x")), "hits")
    scratch.drop("packs", "strings", "busy")
    return scan.select("doc_id", "h", "n_words", "words_sha256"), copies.select("words_sha256", "copies"), hits


def _removed(w: list[bytes], s: np.ndarray, mask: np.ndarray, window: int) -> list[bool]:
    """Which words of a text go."""
    edge = np.zeros(len(w) + 1, np.int64)
    for a, bits in zip(s.tolist(), mask.tolist()):
        while bits:
            i = (bits & -bits).bit_length() - 1
            edge[a + i] += 1
            edge[a + i + window] -= 1
            bits &= bits - 1
    return (np.cumsum(edge[:-1]) > 0).tolist()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, and h, a hash of the text, which with the id tells rows apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))


def _check(window: int, m: int) -> None:
    if not 0 < window - m + 1 <= 63:
        raise ValueError("a window may hold 1 to 63 runs of m words")


def dedup(spark: SparkSession, docs: DataFrame, *, window: int = 35, m: int = 8, hot_bytes: int = 1 << 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    _check(window, m)
    scratch = Scratch(spark, "substring")
    texts = _keyed(docs, id_col, text_col)
    scan, copies, hits = repeated_windows(scratch, texts, window=window, m=m, hot_bytes=hot_bytes)
    schema = StructType([texts.schema["doc_id"], texts.schema["h"], *StructType.fromDDL("n_removed long, new_sha256 string").fields])

    def run(batches):
        for batch in batches:
            raw, off = column_bytes(batch.column(2))
            o, s, mask = flat_lists(batch.column(3), 0, 1)
            n, sha = [], []
            for d in range(len(batch)):
                w = raw[off[d] : off[d + 1]].tobytes().split()
                gone = _removed(w, s[o[d] : o[d + 1]], mask[o[d] : o[d + 1]], window)
                n.append(sum(gone))
                sha.append(hashlib.sha256(b" ".join([x for x, g in zip(w, gone) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    changed = texts.join(hits, _same_row(texts, hits)).select(texts["doc_id"], texts["h"], "t", "x").mapInArrow(run, schema)
    changed = changed.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "n_removed", "new_sha256")
    out = scan.join(copies, "words_sha256", "left").join(changed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    whole = F.col("copies").isNotNull()
    n_removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("new_sha256", "words_sha256"))
    return out.select("doc_id", "n_words", n_removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def remove(spark: SparkSession, docs: DataFrame, *, window: int = 35, m: int = 8, hot_bytes: int = 1 << 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with the repeated windows' words cut from the texts that hold any (their other words joined by
    one space); all columns and rows stay."""
    _check(window, m)
    scratch = Scratch(spark, "substring")
    scan, copies, hits = repeated_windows(scratch, _keyed(docs, id_col, text_col), window=window, m=m, hot_bytes=hot_bytes)
    whole = scan.join(copies, "words_sha256").select("doc_id", "h").distinct().select("doc_id", "h", F.lit(None).alias("x"))
    hits = scratch.put(hits.unionByName(whole).withColumnsRenamed({"doc_id": "id", "h": "g"}).withColumn("hit", F.lit(True)), "all")
    scratch.drop("scan", "copies", "hits")
    place, key = docs.columns.index(text_col), docs.columns.index(id_col)
    rows = plain(docs)
    text = f"c{place}"
    rows = rows.join(hits, F.col(f"c{key}").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("g")), "left")
    rows = rows.select(*[f"c{i}" for i in range(len(docs.columns))], "x", F.coalesce("hit", F.lit(False)).alias("hit"))
    schema = StructType([f for f in rows.schema.fields if f.name[0] == "c"])
    schema[text].nullable = True

    def run(batches):
        for batch in batches:
            *cols, lists, hit = batch.columns
            o, s, mask = flat_lists(lists, 0, 1)
            at = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if len(at):
                texts = cols[place].to_pylist()
                for d in at:
                    w = texts[d].encode().split()
                    gone = _removed(w, s[o[d] : o[d + 1]], mask[o[d] : o[d + 1]], window) if o[d] < o[d + 1] else [True] * len(w)
                    texts[d] = b" ".join([x for x, g in zip(w, gone) if not g]).decode()
                cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return named(rows.mapInArrow(run, schema), docs.columns)
