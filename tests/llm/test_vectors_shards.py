import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import annsearch, queries, sharding, topk
from meridia.llm.store import shared_dir
from tests.compare import same


def vectors(n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(8, dim))[rng.integers(0, 8, n)]
    x[100:400] = x[100]  # a third of the queries' neighbours are copies
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


ODD = [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] * 16), (5200, [float("inf")] + [1.0] * 15), (5250, [None] + [1.0] * 15), (5300, [1.0, 2.0]), (None, [1.0] * 16)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def brute(rows, score, k=5):
    good = [(i, v) for i, v in rows if i is not None]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], float)
    out = []
    for i, v in good:
        if i % 50 == 0:
            s = score(np.array(v), x)
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out += [(i, r + 1, ids[keep][o], s[keep][o]) for r, o in enumerate(order)]
    return out


def cosine(q, x):
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def test_neighbours_reach_the_recall(spark, data):
    rows = vectors()
    got = annsearch.search(spark, frame(spark, [*rows, *ODD, rows[0]]), list_size=64, part=100).collect()
    want = brute(rows, lambda q, x: np.round(cosine(q, x), 12))
    assert len(got) == len(want) and {r["query_id"] for r in got} == {i for i, _ in rows if i % 50 == 0}
    near = {(q, v) for q, _, v, _ in want}
    assert len(near & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(near)
    x = dict(rows)
    for r in got:
        assert r["vec_id"] != r["query_id"]
        assert r["score"] == pytest.approx(cosine(np.array(x[r["query_id"]]), np.array([x[r["vec_id"]]]))[0], abs=1e-12)
    copies = [r for r in got if r["query_id"] == 200]
    assert [r["vec_id"] for r in sorted(copies, key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    assert annsearch.search(spark, frame(spark, ODD[:1])).count() == 0
    few = annsearch.search(spark, frame(spark, rows[:3])).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]


def test_recall_holds_with_many_lists(spark):
    x = np.random.default_rng(9).normal(size=(4000, 48))
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    got = annsearch.search(spark, frame(spark, rows), list_size=8).collect()  # 500 lists, nearly all within the ratio
    near = {(q, v) for q, _, v, _ in brute(rows, lambda q, x: np.round(cosine(q, x), 12))}
    assert len(near & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(near)


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    c = annsearch._unit(rng.normal(size=(300, 16)))
    x = annsearch._unit(rng.normal(size=(200, 16)))
    order, cos = annsearch.Centroids(c).search(x, 10)
    exact = np.argsort(-(x @ c.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(order, exact)]) > 0.95 and (np.diff(cos) <= 1e-12).all()


def test_topk_is_exact(spark):
    rows = vectors(900)
    df = frame(spark, [*rows, *[o for o in ODD if o[0] != 5100], rows[0]])
    got = sorted(tuple(r) for r in topk.search(spark, df, list_size=200, segment=128, group=5, block=16).collect())
    want = sorted((q, r, v, int(s)) for q, r, v, s in brute(rows, lambda q, x: np.floor(256 * x) @ np.floor(256 * q)))
    assert got == want
    assert topk.search(spark, frame(spark, ODD[:1])).count() == 0
    huge = spark.createDataFrame([(0, [1e6, 3e6]), (1, [2e6, -3e6]), (2, [1e6, 3e6 + 1])], "vec_id long, embedding array<double>")
    exact = {r["vec_id"]: r["score"] for r in topk.search(spark, huge).collect()}
    a, b = 256 * 10**6, 256 * 3 * 10**6
    assert exact == {2: a * a + b * (b + 256), 1: 2 * a * a - b * b}  # beyond what doubles hold exactly
    beyond = spark.createDataFrame([(0, [3e8]), (1, [-3e8])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.search(spark, beyond).collect()] == [-(2**63)]


def test_blocks_are_pruned():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(640, 8)) * 0.05 + 3 * rng.normal(size=(10, 8))[rng.integers(0, 10, 640)]))
    got, scored, every = topk.block_search(x, np.arange(640), x[:20], np.arange(20), 5, 32)
    assert scored < every / 4
    least = np.array([np.sort(np.delete(x @ x[q], q))[-5] for q in range(20)])
    again, fewer, _ = topk.block_search(x, np.arange(640), x[:20], np.arange(20), 5, 32, least)
    assert fewer <= scored and all((a[1] == b[1]).all() for a, b in zip(got, again))
    for q, (_, ids, s) in enumerate(got):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(640), -scores))[:5]
        assert ids.tolist() == want.tolist() and s.tolist() == scores[want].tolist()


def test_topk_equals_sql(spark, data, duck):
    same(queries.op6_exact_topk(spark, data), duck, queries.ORACLE_SQL["op6_exact_topk"])


def test_shards(spark):
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", target=60_000, least=1000)
    assert store.versions() == []
    parts = [spark.range(i * 500, i * 500 + 500, 1, 2).select("id", F.when(F.col("id") % 3 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("t")) for i in range(6)]
    for n, p in enumerate(parts, 1):
        assert store.append(p) == n
    small = store.manifest()
    assert len(store.shards(small)) == 12 and len(small["lists"]) == 6
    latest = store.compact()
    merged = store.manifest()
    assert latest == merged["version"] > 6 and len(store.shards(merged)) < 12
    everything = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    for frame_ in (store.read(), store.read(6)):
        assert frame_.exceptAll(everything).count() == 0 and everything.exceptAll(frame_).count() == 0
    assert store.read(2).count() == 1000
    with pytest.raises(Exception):
        store._commit(small, [], small["schema"])  # a racing writer that still saw version 6
    assert store.manifest() == merged
    parts[0].write.parquet(f"{store.root}/data/lost")  # of a writer that never committed
    assert store.vacuum() == 12 and store.versions() == [latest] and store.read().count() == 3000
    assert store.vacuum() == 0 and store.vacuum(grace=-1) == 2 and store.read().count() == 3000 and store.manifest() == merged
    with pytest.raises(ValueError, match="kept"):
        store.vacuum(keep=0)
    with pytest.raises(ValueError, match="schema"):
        store.append(spark.range(1))
    store.append(parts[0].limit(0))
    assert store.read().count() == 3000
    store.append(parts[0])
    assert store.read().count() == 3500  # repeated rows stay


def test_sharding_query_is_whole(spark, data):
    got = queries.op9_sharding(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", "n_chars")
    mine = got.select(*want.columns)
    assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0


def test_results_are_complete_among_copies(spark):
    rng = np.random.default_rng(3)
    far = {i: rng.normal(size=8).tolist() for i in range(0, 500, 50)}
    rows = [(i, far.get(i, [1.0] * 8)) for i in range(4000)]
    got = annsearch.search(spark, frame(spark, rows)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in range(0, 4000, 50) for k in range(1, 6)]


def test_graph_and_reach_on_many_centroids():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(100, 32))
    c = annsearch._unit(z[rng.integers(0, 100, 4096)] + 0.5 * rng.normal(size=(4096, 32)))
    x = annsearch._unit(z[rng.integers(0, 100, 500)] + 0.5 * rng.normal(size=(500, 32)))
    graph = annsearch.Centroids(c)
    order, _ = graph.search(x, 1)
    assert (order[:, 0] == (x @ c.T).argmax(1)).mean() > 0.97
    far = np.sqrt(np.maximum(2 - 2 * x @ c.T, 0))
    rows, lists = graph.reach(x, 0.2)
    want = {(r, k) for r, k in zip(*np.nonzero(far <= 1.2 * far.min(1, keepdims=True)))}
    assert want <= set(zip(rows.tolist(), lists.tolist()))
