import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import langid, queries, toxicity


def test_language_accuracy_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    got = queries.op2_language_id(spark, data).join(docs, "doc_id")
    assert got.count() == docs.count()
    right, n = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95
    assert got.where("score < 0 or score > 1").count() == 0
    first = got.orderBy("doc_id").first()
    import zlib

    assert first["held_out"] == (zlib.crc32(str(first["doc_id"]).encode()) % 4 == 2)


def test_language_edge_cases(spark):
    rows = [(i, "the cat sat on the mat and the dog" if i % 2 else "der hund und die katze auf dem tisch", "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 34 !?", "de", "x"), (103, "the dog " * 50000, None, "x"), (104, "漢字", None, "x"), (1, "the cat sat on the mat and the dog", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(spark, df).collect()}
    assert langid.identify(spark, df).count() == len(rows)
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[100]["score"] == 0
    assert got[103]["lang_pred"] == "en" and got[104]["lang_pred"] in ("en", "de")
    assert langid.identify(spark, df.limit(0)).count() == 0
    unlabelled = langid.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_ngrams_stay_inside_texts():
    from meridia.llm.textnum import column_bytes
    import pyarrow as pa

    def counts(texts):
        raw, off = column_bytes(pa.array(texts))
        cp, at = langid.code_points(raw, off)
        out = np.zeros((len(texts), 1 << 10), int)
        for g in langid.grams(cp, at, 10, (1, 2, 3)):
            for d in range(len(texts)):
                mine = g[at[d] : at[d + 1]]
                np.add.at(out[d], mine[mine < 1 << 10], 1)
        return out

    texts = ["héllo wörld", "", "a", "漢字 ab", "héllo wörld"]
    joined = counts(texts)
    for i, t in enumerate(texts):
        assert (joined[i] == counts([t])[0]).all() and joined[i].sum() == sum(max(0, len(t) - n + 1) for n in (1, 2, 3))


def brute_segments(scores):
    """Maximal-scoring segments by the recursive definition."""
    def best(a, b):
        top = None
        for i in range(a, b):
            s = 0
            for j in range(i, b):
                s += scores[j]
                if s > 1e-12 and (top is None or s > top[2] + 1e-9 or (abs(s - top[2]) <= 1e-9 and j - i < top[1] - top[0])):
                    top = (i, j, s)
        if top is None:
            return []
        return [*best(a, top[0]), top, *best(top[1] + 1, b)]

    return best(0, len(scores))


def test_segments_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        gain = np.where(rng.random(n) < 0.3, rng.random(n) * 4 + 0.01, -0.5)
        pos = np.flatnonzero(gain > 0)
        got = toxicity.maximal_segments(pos, gain[pos], 0.5)
        want = brute_segments(gain.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def toxic_corpus(spark, n=400):
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 80))
        y = int(i % 4 == 0)
        if y:
            at = int(rng.integers(0, 70))
            w[at : at + 5] = ["grumble", "snarlier", "grumble", "snarled", "grumble"]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus(spark)
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "?! ...", "x"), (1003, "w1 w2 " * 100000 + "GRUMBLE snarly, grumble grumble!", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, passages string")
    marks = spark.createDataFrame([*labels, (5000, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.detect(spark, docs, marks).collect()
    assert len(out) == len(rows)
    truth = {i: y for i, _, y in labels}
    assert all(r["predicted"] == truth[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] in truth)
    by = {r["doc_id"]: r for r in out}
    assert {by[i]["predicted"] for i in (1000, 1001, 1002)} == {0} and by[1003]["predicted"] == 1
    text = dict((i, t) for i, t, _ in rows)
    p = by[1003]["passages"][0]
    assert text[1003][p["start"] : p["end"]].lower().startswith("grumble") and p["bits"] > 0
    for r in out:
        if truth.get(r["doc_id"]):
            assert any("grumble" in text[r["doc_id"]][q["start"] : q["end"]] for q in r["passages"])


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.detect(spark, docs, marks).collect()} == {0.0}
    assert toxicity.detect(spark, docs.limit(0), marks).count() == 0


def test_toxicity_query(spark, data):
    got = queries.op4_toxicity(spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_lambda_solves_its_equation():
    v, p = np.array([-0.5, 3.0]), np.array([0.999, 0.001])
    lam, k = toxicity.karlin_altschul(v, p)
    assert (p * np.exp(lam * v)).sum() == pytest.approx(1, abs=1e-6) and k == pytest.approx(0.001)


def plain_score(text, m):
    """The score of a text by its definition: tokens, their strongest features, best segments, bits, calibration."""
    import re

    raw = np.frombuffer(text.encode(), np.uint8)
    gain = []
    for w in re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), text)):
        found = [0.0]
        b = np.frombuffer(w.encode(), np.uint8)
        zero, end = np.array([0]), np.array([len(b)])
        for f in toxicity.features(b, zero, end):
            found += m.gain[m.keys == f[0]].tolist()
        gain.append(max(found))
    assert len(raw) == len(text.encode())
    segments = brute_segments([g - m.drift for g in gain])
    bits = [b for b in ((m.lam * s - np.log(max(m.k * len(gain), 1e-9))) / np.log(2) for *_, s in segments) if b > 0] or [0.0]
    hot, n = sum(g > m.drift for g in gain), max(len(gain), 1)
    x = np.array([1, *np.log1p([max(bits), sum(bits), 1000 * hot / n, 100 * sum(bits) / n])]) if hot else np.array([1, 0, 0, 0, 0.0])
    return max(1 / (1 + np.exp(-x @ w)) for w in m.weights)


def test_score_equals_a_plain_version(spark):
    rows, labels = toxic_corpus(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [t for _, t, _ in rows[:40]] + ["", "w1 Grumble-snarls é", "grumble " * 3 + "w2 " * 30 + "snarl", "größer GRUMBLE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(spark, df, model, keep=("doc_id",)).collect():
        assert r["score"] == pytest.approx(plain_score(texts[r["doc_id"]], model), abs=1e-9)


def test_toxicity_recall_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect()}
    got = [r for r in queries.op4_toxicity(spark, d).select("doc_id", "held_out", "predicted").collect() if r["held_out"] and r["doc_id"] in truth]
    toxic = [r["predicted"] for r in got if truth[r["doc_id"]]]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(r["predicted"] for r in got if not truth[r["doc_id"]]) <= 0.02 * len(got)


def plain_features(text, bits=15, orders=(1, 2, 3, 4)):
    """Hashed n-grams by their definition, one by one."""
    m = 0xFFFFFFFF
    cp = [ord(c.lower()) if len(c.lower()) == 1 and ord(c) < 0x3000 else ord(c) for c in text]
    out = []
    for i in range(len(cp)):
        h = 0
        for k in range(1, max(orders) + 1):
            if i + k > len(cp):
                break
            h = (((h ^ cp[i + k - 1]) * 0x01000193) & m) + (0x9E3779B1 * k & m) & m
            if k in orders:
                out.append((((h ^ (h >> 15)) * 0x85EBCA6B) & m) >> (32 - bits))
    return out


def test_predictions_equal_plain_naive_bayes(spark, data):
    import zlib
    from collections import Counter
    from math import exp, log

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    counts, n = {}, Counter()
    for i, t, lang in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None and lang.strip():
            counts.setdefault(lang, Counter()).update(plain_features(t))
            n[lang] += 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, data).collect()}
    for i, t, _ in docs[:120]:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        f = plain_features(t)
        ll = {x: log(n[x] / sum(n.values())) + sum(log(counts[x][y] + 0.1) - log(total[x] + 0.1 * 2**15) for y in f) for x in counts}
        best = max(sorted(ll), key=ll.get)
        assert got[i]["lang_pred"] == best
        assert got[i]["score"] == pytest.approx(1 / sum(exp(max(v - ll[best], -700)) for v in ll.values()), abs=1e-6)


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(1)
    words = {k: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3)] for k in range(400)}
    rows = [(n * 400 + k, " ".join(rng.choice(words[k], 30)), f"l{k:03}") for n in range(10) for k in range(400)]
    got = langid.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    truth = {i: x for i, _, x in rows}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got.collect()]
    assert np.mean(right) > 0.9 and got.select("lang_pred").distinct().count() > 390
