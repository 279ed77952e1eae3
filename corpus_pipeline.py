"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeated passages
and secrets are cut, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's `docs` (a stage frees what the one before it has left, so its result must have been written). All
but the last return the columns of `documents`, with `n_chars` kept true.

Defined results: an empty table stays empty; a null or empty text stays as it is and is packed as the end id alone; rows that
repeat an id are one document (see `drop_near_duplicates`), rows without an id are documents of their own; ties (equal texts) go to
the smallest id; texts of any length are handled whole; columns beyond those of `documents`, whatever their names, are kept up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import neardup, packing, secrets, substring, toxicity
from meridia.llm.store import Scratch, delete, named, plain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_mine: set[int] = set()
KEY = "__key"


def _stage(f: Stage) -> Stage:
    """Frees what the stage before still held: its result has been written by now."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for s in list(Scratch._open):
            if id(s) in _mine:
                s.close()
        _mine.clear()
        before = {id(s) for s in Scratch._open}
        out = f(spark, docs, sf_dir)
        _mine.update({id(s) for s in Scratch._open} - before)
        return out

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _at(docs: DataFrame, name: str) -> str:
    """The name of a column in `plain(docs)`."""
    return f"c{docs.columns.index(name)}"


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    marks, rows = spark.read.parquet(f"{sf_dir}/labels.parquet"), plain(docs)
    return named(toxicity.detect(spark, rows, marks, keep=tuple(rows.columns), id_col=_at(docs, "doc_id"), text_col=_at(docs, "text")).where("predicted = 0"), docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of the document with the smallest id of each linked group stays.

    Rows that repeat an id are copies of one document: the first by text, then by its other columns, is taken. A row
    without an id is a document of its own that comes after all with one."""
    keyed = _keyed(spark, plain(docs), _at(docs, "doc_id"))
    kept = neardup.link(spark, keyed, id_col=KEY, text_col=_at(docs, "text")).where("kept").groupBy(F.col("doc_id").alias(KEY)).agg(F.count("*").alias("n"))
    kept = Scratch(spark, "kept").put(kept, "ids")
    if kept.where("n > 1").isEmpty():
        return named(keyed.join(kept, KEY, "left_semi"), docs.columns)
    once = keyed.join(kept.where("n = 1"), KEY, "left_semi").drop(KEY)
    # of each repeated id one row, picked in part before the shuffle
    order = F.struct(_at(docs, "text"), *[c for c, (_, kind) in zip(once.columns, docs.dtypes) if not kind.startswith(("map", "array", "struct", "variant"))])
    again = keyed.join(kept.where("n > 1"), KEY, "left_semi").groupBy(KEY).agg(F.min_by(F.struct(*once.columns), order).alias("r")).select("r.*")
    return named(once.unionByName(again), docs.columns)


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by repeated windows go; texts without any stay as they are."""
    return _measured(plain(substring.remove(spark, docs)), docs)


@_stage
def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    rows, text = plain(docs), _at(docs, "text")
    found = secrets.scan(spark, rows, text_col=text, keep=tuple(rows.columns))
    return _measured(found.withColumn(text, secrets.redact(F.col(text), F.col("spans"))), docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of at most 1024 tokens."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _keyed(spark: SparkSession, docs: DataFrame, id_col: str) -> DataFrame:
    """`docs` with KEY: the id, or where that is null a number of its own above all ids (written, so that it stays)."""
    ids = docs.agg(F.max(id_col).alias("top"), F.count_if(F.col(id_col).isNull()).alias("none")).first()
    known = docs.withColumn(KEY, F.col(id_col).cast("long"))
    if not ids["none"]:
        return known
    top = max(ids["top"] or 0, 0)
    if top >= 1 << 62:
        raise ValueError("no room above the ids for rows without one")
    rest = docs.where(F.col(id_col).isNull()).withColumn(KEY, F.lit(top + 1) + F.monotonically_increasing_id())
    return known.where(F.col(id_col).isNotNull()).unionByName(Scratch(spark, "keys").put(rest, "rest"))


def _measured(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """`rows` (plain columns of `docs`) with `n_chars` of the present texts."""
    return named(rows.withColumn(_at(docs, "n_chars"), F.char_length(_at(docs, "text")).cast("long")), docs.columns)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scan", cut_secrets),
    ("packing", pack_sequences),
]

#: Fitted scores and tokenisers have no SQL; the tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's result."""
    folder = Scratch(spark, "pipeline").root  # what the last stage reads goes when the session ends
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if last is not None:
            delete(spark, f"{folder}/{last}")
        last = k
    raise ValueError("STAGES is empty")
