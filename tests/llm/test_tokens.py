import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from meridia.llm import packing, piecebpe, queries
from meridia.llm.textnum import column_bytes

PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = [*"abcdehilnorstu  \n\té漢字🙂▁𝔸́ <s>0123'", " ", " ", "\x00", "½", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*texts, "", " ", "  a   b ", "a" * 700, "ab" * 400, " " * 900, "<s></s><unk>", "hello world\n\n"]


@pytest.fixture(scope="module")
def piece():
    with open(PIECES, "rb") as f:
        return piecebpe.PieceModel(f.read()), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(piece, spark, data):
    model, library = piece
    texts = odd_texts(1500) + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    raw, off = column_bytes(pa.array(texts))
    ids, o = model.encode(raw, off)
    decoded = model.decode(ids, o)
    for d, t in enumerate(texts):
        want = library.encode(t)
        assert ids[o[d] : o[d + 1]].tolist() == want
        assert decoded[d] == library.decode(want).encode()


def test_decoding_any_ids_equals_the_library(piece):
    model, library = piece
    rng = random.Random(2)
    runs = [[rng.choice((rng.randrange(320), rng.randrange(32000))) for _ in range(rng.randrange(14))] for _ in range(2000)]
    off = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    got = model.decode(np.array([i for r in runs for i in r], np.int32), off)
    assert got == [library.decode(r).encode() for r in runs]


def test_piece_operators(spark, data, piece):
    library = piece[1]
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello wörld", "x"), (3, "Hello wörld", "x"), (4, "lang " * 60000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = piecebpe.encode(spark, df, PIECES)
    assert sorted((r[0], tuple(r[1])) for r in ids.collect()) == sorted((i, tuple(library.encode(t or ""))) for i, t, _ in rows)
    back = piecebpe.decode(spark, ids, PIECES)
    assert sorted(tuple(r) for r in back.collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert piecebpe.encode(spark, df.limit(0), PIECES).count() == 0
    assert piecebpe.decode(spark, ids.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), PIECES).where("text <> ''").count() == 0
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op7_sentencepiece(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        want = library.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), sha(",".join(map(str, want)).encode()))
        assert r["decoded_sha256"] == sha(library.decode(want).encode())


def test_byte_tokens_equal_the_library():
    ours = packing.ByteTokenizer(open(BYTES, encoding="utf-8").read(), P.PATTERN)
    library = tokenizers.Tokenizer.from_file(BYTES)
    for t in [*odd_texts(1500, 3), "<|endoftext|>" * 300]:
        assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """The optimum, by trying every bin for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in {r: k for k, r in enumerate(bins) if r >= lengths[i]}.values():
            bins[b] -= lengths[i]
            go(i + 1, bins)
            bins[b] += lengths[i]
        go(i + 1, [*bins, capacity - lengths[i]])

    go(0, [])
    return best[0]


def held(bins, capacity):
    out = np.zeros(capacity + 1, int)
    for lengths, times in bins:
        assert sum(lengths) <= capacity
        for x in lengths:
            out[x] += times
    return out


def test_plans_are_optimal_on_small_cases():
    rng = np.random.default_rng(8)
    for _ in range(120):
        n = int(rng.integers(1, 10))
        lengths = rng.integers(1, 31, n)
        counts = np.bincount(lengths, minlength=31)
        bins = packing.plan(counts, 30)
        assert (held(bins, 30) == counts).all()
        assert sum(k for _, k in bins) == fewest(lengths.tolist(), 30)


def test_branching_beats_best_fit():
    counts = np.bincount([3, 4, 5, 7, 10, 11], minlength=21)  # 11 + 5 + 4 and 10 + 7 + 3; best fit starts with 11 + 7
    assert sum(k for _, k in packing.best_fit(counts, 20)) == 3
    assert sum(k for _, k in packing.plan(counts, 20)) == 2


def test_large_plans_are_near_the_bound():
    rng = np.random.default_rng(9)
    counts = np.bincount(rng.integers(1, 700, 50000), minlength=1025)
    bins = packing.plan(counts, 1024)
    assert (held(bins, 1024) == counts).all()
    floor = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(k for _, k in bins) <= floor * 1.002 + 1


def test_packing_is_whole_and_gapless(spark, data):
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = [(i, "tok " * (i * 7 % 900)) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 3000), (100, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string").repartition(5)
    got = packing.pack(spark, df, BYTES, P.PATTERN).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % 1024 or 1024
        starts = [0, *range(head, len(ids), 1024)]
        for k, (a, b) in enumerate(itertools.pairwise([*starts, len(ids)])):
            want.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert packing.pack(spark, df.limit(0), BYTES, P.PATTERN).count() == 0
    total = sum(w[3] for w in want)
    assert len(by_seq) <= -(-total // 1024) + 1
    assert queries.op8_packing(spark, data).select("doc_id").distinct().count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_search_beats_its_first_incumbent():
    rng = np.random.default_rng(0)
    for low, high, n, gain in ((200, 521, 3000, 25), (250, 401, 5000, 40), (100, 601, 3000, 3)):
        counts = np.bincount(rng.integers(low, high, n), minlength=1025)
        bins = packing.plan(counts, 1024)
        held = np.zeros(1025, np.int64)
        for lengths, k in bins:
            assert sum(lengths) <= 1024
            np.add.at(held, list(lengths), k)
        got, first, bound = sum(k for _, k in bins), sum(k for _, k in packing.best_fit(counts, 1024)), packing.lower_bound(counts, 1024)
        assert (held == counts).all() and bound <= got <= first - gain


def test_fillings_are_the_undominated_ones():
    from itertools import combinations

    rng = np.random.default_rng(1)
    for _ in range(60):
        items = sorted(rng.integers(1, 20, 7).tolist(), reverse=True)
        room = int(rng.integers(10, 40))
        every = {tuple(items[i] for i in c) for n in range(8) for c in combinations(range(7), n)}
        every = {f for f in every if sum(f) <= room}

        def spare(f, items=items):
            left = list(items)
            for x in f:
                left.remove(x)
            return left

        def worse(f, room=room, spare=spare):
            waste = room - sum(f)
            if any(s <= waste for s in spare(f)):
                return True
            parts = [c for n in range(1, len(f) + 1) for c in combinations(f, n)]
            return any(sum(c) + (len(c) == 1) <= s <= sum(c) + waste for c in parts for s in spare(f))

        counts = np.bincount(items, minlength=41)
        for price in (0, 5):
            got = list(packing.fillings(counts, room, price))
            assert len(got) == len(set(got)) and set(got) == {f for f in every if not worse(f)}


def test_lower_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(40):
        items = rng.integers(1, 31, int(rng.integers(1, 9))).tolist()
        bins: list[list[int]] = []
        best = [len(items)]

        def go(i, bins, items=items, best=best):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for b in bins:
                if sum(b) + items[i] <= 30:
                    b.append(items[i])
                    go(i + 1, bins)
                    b.pop()
            bins.append([items[i]])
            go(i + 1, bins)
            bins.pop()

        go(0, bins)
        assert packing.lower_bound(np.bincount(items, minlength=31), 30) <= best[0] == sum(k for _, k in packing.plan(np.bincount(items, minlength=31), 30))


def test_long_runs_of_blanks():
    ours, library = packing.ByteTokenizer(open(BYTES, encoding="utf-8").read(), P.PATTERN), tokenizers.Tokenizer.from_file(BYTES)
    for t in (" " * 1_300_000, "a" + "\n \t" * 100_000 + "b", " " * 49_999 + "x" + " " * 50_001, " " * 60_000, "ab " * 40_000, "z" * 300_000):
        assert ours.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_long_words_and_runs_are_encoded_as_by_the_library():
    rng = random.Random(12)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        m = piecebpe.PieceModel(f.read())
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [" " * 100_000, "x" + " " * 130_000 + "y", "a" * 100_000, "=" * 30_000, "\n" * 5_000, "é" * 20_000, "🙂" * 6_000, pick("etaoin", 100_000), pick("ab ", 20_000), pick("  =-", 20_000)]
    texts += [pick(rng.choice(["  a", " \t\n", "==-", "....!", "0123456789", "thei "]), rng.randrange(1, 700)) for _ in range(300)]
    raw = "".join(texts).encode()
    ids, off = m.encode(np.frombuffer(raw, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == library.encode(t), t[:40]


def test_words_of_one_hash_are_kept_apart(monkeypatch):
    monkeypatch.setattr(piecebpe, "mix", lambda h: h * np.uint64(0))
    cp = np.array([ord(c) for c in "abcabdababc"], np.uint32)
    start = np.array([0, 3, 6, 8, 11])
    first, number = piecebpe._distinct(cp, start)
    words = ["abc", "abd", "ab", "abc"]
    assert [words[first[k]] for k in number] == words
