import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meridia.llm import neardup, queries, substring
from tests.compare import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_links(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def links(spark, rows, **params):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(spark, df, **params).collect()}


def edited(words, rng, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    base = [f"b{rng.randrange(500)}" for _ in range(150)]
    rows = [(1000 - i, edited(base, rng, rng.choice([0.005, 0.01, 0.03, 0.06]))) for i in range(120)]  # a bucket full of them, many not linked
    rows += [(2000 + i, " ".join(base)) for i in range(30)]
    rows += [(3000 + i, edited(base[:60], rng, 0.02)) for i in range(20)]
    rows += [(4000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one two three four five"), (7, "ÄB c"), (8, "äB c"), (9, "word " * 30000), (10, "word " * 20000)]
    want = brute_links(rows)
    assert links(spark, rows) == want
    assert links(spark, rows, small=2) == want  # everything through the blocks
    assert want[4][1] == want[5][1] == 4 and want[8][1] == 8 and want[10][1] == 9 and want[1] == (0, 1, True)


def test_near_duplicates_edge_tables(spark):
    assert links(spark, []) == {}
    assert links(spark, [(5, None), (6, "")]) == {5: (0, 5, True), 6: (0, 6, True)}
    twice = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.link(spark, twice).collect()) == [(7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False)]


def test_sequential_test_keeps_the_similar():
    least = neardup.least_matches(0.75, 1e-6)
    assert least == sorted(least) and 0 < least[-1] < 0.75 * neardup.HASHES
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 16, (4000, neardup.HASHES)).astype(np.uint16)
    y = np.where(rng.random(x.shape) < 0.75, x, x + np.uint16(1))
    assert len(neardup._survive(x, y, least)) == len(x)
    far = np.where(rng.random(x.shape) < 0.4, x, x + np.uint16(1))
    assert len(neardup._survive(x, far, least)) < 40


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600).astype(np.uint64)])
    sig = neardup.signatures([np.sort(a), np.sort(b)])
    assert abs((sig[0] == sig[1]).mean() - 2400 / 3600) < 0.13


def test_near_duplicates_equal_sql(spark, data, duck):
    same(queries.op3_minhash_neardup(spark, data), duck, queries.ORACLE_SQL["op3_minhash_neardup"])


def plain_removal(rows, window):
    count, words = Counter(), {}
    for n, (_, t) in enumerate(rows):
        w = words[n] = WORD.findall(t or "")
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for n, (i, _) in enumerate(rows):
        w = words[n]
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_removal(rows, window):
    return sorted(plain_removal(rows, window), key=repr)


def removal_rows():
    rng = random.Random(4)
    text = lambda n, v=10**6: " ".join(f"é{rng.randrange(v)}" for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(rng.randrange(0, 30))} {passage}\n{text(rng.randrange(0, 30))}") for i in range(40)]
    rows += [(100, text(20)), (101, None), (102, ""), (103, " \t "), (104, "a " * 200), (105, text(34)), (106, text(35)), (107, text(3000, 5) + " " + text(3000, 5))]
    rows += [(200, text(50))] * 2 + [(300 + i, rows[0][1]) for i in range(5)]
    half = text(35)
    rows += [(400, half + " x " + half), (401, text(20000))]
    odd = text(70)
    rows += [(None, odd), (None, odd), (None, text(50)), (None, None), (500, odd + " y"), (501, odd.replace(" ", "\n")), (502, text(40)), (502, text(40)), (503, "w" * 300000 + " " + odd)]
    rows += [(504, text(20))] * 2
    return rows


def test_substring_removal_equals_brute_force(spark):
    rows = removal_rows()
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, n_words string")
    for hot_bytes in (1 << 20, 300):
        assert rows_of(substring.dedup(spark, df, hot_bytes=hot_bytes)) == brute_removal(rows, 35)
    assert rows_of(substring.dedup(spark, df, window=12, m=4)) == brute_removal(rows, 12)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substring_rewrite_and_empty(spark):
    rows = removal_rows()
    df = spark.createDataFrame([(i, t, "q", "r") for i, t in rows], "doc_id long, text string, x string, __x string")
    got = substring.remove(spark, df.select("x", "text", "doc_id", "__x"))
    assert got.columns == ["x", "text", "doc_id", "__x"] and {(r["x"], r["__x"]) for r in got.collect()} == {("q", "r")}
    digest = lambda t: hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()
    assert sorted(((r["doc_id"], digest(r["text"])) for r in got.collect()), key=repr) == sorted(((i, sha) for i, _, _, sha in brute_removal(rows, 35)), key=repr)
    untouched = {t for t, (_, _, n, _) in zip((t for _, t in rows), plain_removal(rows, 35)) if not n}
    assert untouched <= {r["text"] for r in got.collect()}
    assert substring.dedup(spark, df.limit(0)).count() == 0
    assert substring.remove(spark, df.limit(0)).count() == 0


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    at = np.array([0, 10, 45, 45, 900, 3000])
    first, n, _ = substring.super_kmers(h, at, 35, 8)
    got = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
    want = np.concatenate([np.arange(a, max(a, b - 34)) for a, b in zip(at, at[1:])])
    assert (got == want).all() and n.max() <= 28


def test_substring_equals_sql(spark, data, duck):
    same(queries.op10_substring_dedup(spark, data), duck, queries.ORACLE_SQL["op10_substring_dedup"])


def test_duplicate_rows_of_the_table_columns(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("sig", F.lit("x"))
    assert {r["component_id"] for r in neardup.link(spark, df).collect()} == {1}
