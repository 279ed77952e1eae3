"""Thin queries over the tables: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annsearch, langid, neardup, packing, piecebpe, secrets, sharding, substring, topk, toxicity
from .store import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed("base").cast("binary"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(spark, docs)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.detect(spark, docs, table(spark, sf_dir, "labels"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.search(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piecebpe.digests(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


#: The documents arrive in so many slices.
ARRIVALS = 4


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the documents in arrivals of small shards, compacting after each, and read the committed version: where each row lies."""
    store = sharding.ShardStore(spark, f"{Scratch(spark, 'shards').root}")
    docs = table(spark, sf_dir, "documents")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        version = store.compact()
        store.vacuum()
    return store.read().select(
        "doc_id", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"), F.lit(version).alias("version"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", "n_chars"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_toxicity": op4_toxicity,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_exact_topk": op6_exact_topk,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_substring_dedup": op10_substring_dedup,
}

_TOPK_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM c q JOIN c d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"

_NEARDUP_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS t FROM c),
e AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rep AS v, rep AS l FROM c UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.v),
g AS (SELECT v, min(l) AS l FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(g.l, s.doc_id) AS component_id, coalesce(g.l, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN g ON g.v = c.rep
"""

_SUBSTRING_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN rep USING (t), (SELECT unnest(range(0, 35)) AS k)),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (
  SELECT u.doc_id, count(hit.p) AS n_removed, string_agg(CASE WHEN hit.p IS NULL THEN word END, ' ' ORDER BY u.p) AS kept
  FROM u LEFT JOIN hit ON hit.doc_id = u.doc_id AND hit.p = u.p GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

#: The other operators rest on fitted models, tokenisers, spans or files, which SQL can't express.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_neardup": _NEARDUP_SQL,
    "op10_substring_dedup": _SUBSTRING_SQL,
    "op6_exact_topk": _TOPK_SQL,
}
