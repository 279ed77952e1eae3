"""The pipeline against plain versions of its stages, stage by stage."""

import re

import public_tokenizers as P
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import WORD, brute_links, brute_removal
from tests.llm.test_secrets import ASSIGN


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, state = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, state[-1], data).write.parquet(f"{tmp_path}/{k}")
        state.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == columns for s in state[:-1])
    before, clean, single, cut, safe, packed = (rows_of(s) if n < 5 else s.collect() for n, s in enumerate(state))

    # toxicity: documents without any word that only toxic ones hold stay
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert set(clean) <= set(before) and all(clean[i] == before[i] for i in clean)
    harmless = [i for i, y in marks.items() if y == 0]
    assert sum(i in clean for i in harmless) >= 0.98 * len(harmless)

    want = {i for i, (_, _, kept) in brute_links([(i, r["text"]) for i, r in clean.items()]).items() if kept}
    assert set(single) == want and all(single[i] == clean[i] for i in want)

    gone = {i: n for i, _, n, _ in brute_removal([(i, r["text"]) for i, r in single.items()], 35)}
    assert set(cut) == set(single)
    for i, r in cut.items():
        assert len(WORD.findall(single[i]["text"])) - len(WORD.findall(r["text"])) == gone[i]
        assert r["n_chars"] == len(r["text"]) and (gone[i] or r["text"] == single[i]["text"])

    assert set(safe) == set(cut)
    secret = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    for i, r in safe.items():
        assert not secret.search(r["text"]) and not any(len(m[2]) >= 6 for m in ASSIGN.finditer(r["text"]))
        if not secret.search(cut[i]["text"]) and not ASSIGN.search(cut[i]["text"]):
            assert r["text"] == cut[i]["text"]

    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in safe.items()}


def test_run_equals_the_stages_on_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (5, "word " * 30000, "en", "s", 150000), (6, "token=abcdefgh x y z", "en", "s", 19)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 5, 6}
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_repeated_rows_and_rows_without_an_id(spark, tmp_path):
    text = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(7, text("a")), (7, text("a")), (7, text("a")), (8, text("a")), (9, text("b")), (9, text("b")), (None, text("c")), (None, text("d")), (None, text("d") + " e"), (None, text("b")), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    corpus_pipeline.drop_near_duplicates(spark, docs, "").write.parquet(f"{tmp_path}/single")
    single = spark.read.parquet(f"{tmp_path}/single")
    got = [(r["doc_id"], r["text"]) for r in single.collect()]
    d = [t for i, t in got if t and t.startswith("d0")]
    assert len(d) == 1 and d[0] in (text("d"), text("d") + " e")
    assert sorted(got, key=str) == sorted([(7, text("a")), (9, text("b")), (None, text("c")), (None, d[0]), (None, None), (None, "")], key=str)
    cut = corpus_pipeline.cut_repeats(spark, single, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in cut), key=str) == sorted(got, key=str)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = ["score", "predicted", "passages", "held_out", "spans", "base", "found", "hex", "assign", "access", "__x", "__id", "x", "id", "h", "hit", "kept", "n", "__key", "__text", "c0", "sig", "m"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [(1, text), (1, text), (2, text + " token=abcdefgh"), (3, None), (4, "a token=abcdefgh b"), (None, "x " + text)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.create_map(F.lit("k"), F.lit(1)) if name == "sig" else F.lit(k))
    spark.createDataFrame([(i, 1, i % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k + 1}")
    last = spark.read.parquet(f"{tmp_path}/4")
    assert all(r[n] == k for r in last.collect() for k, n in enumerate(names) if n != "sig")
    assert sorted((r["doc_id"], r["text"]) for r in last.collect()) == [(1, text), (3, None), (4, "a [secret] b")]
