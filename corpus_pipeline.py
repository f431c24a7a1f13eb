"""Training-data pipeline over ``documents``: five stages, each of which calls one operator of quantlake.llm.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and returns the columns of its documents (the last
one its own). run() writes each result to the folder that all executors share and reads it for the next stage.

Null and empty texts have no language and go in the first stage. Repeated rows, and rows of one doc_id or of none, are rows of
their own until near duplicates go; of ties the first by doc_id, then by a hash of the row, stays. Very long texts pass
through every stage whole. An empty table gives an empty one; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm import language, minhash, mixing, pieces, suffixes
from quantlake.llm.common import Workspace, small_batches, tidy

LEAST_SCORE = 0.5


def tidied(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables leave no shuffle files behind."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tidy(spark):
            return stage(spark, docs, sf_dir)

    return run


def packed(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one, d: no name of theirs can meet one of a stage's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))


def in_order(docs: DataFrame) -> DataFrame:
    """row, a number of each row's own (ascending with doc_id, nulls last, and then with a hash of the row), and d. Hash and doc_id
    together spread a doc_id that many rows share, or lack, over the sorted parts."""
    rows = packed(docs).orderBy(F.col("d.doc_id").asc_nulls_last(), F.xxhash64("d"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "d")


def numbered(work: Workspace, docs: DataFrame) -> DataFrame:
    """in_order(), written out, so that every later read sees the same numbers."""
    return work.save(in_order(docs), "numbered", "zstd")


@tidied
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of at least LEAST_SCORE; those without a letter, or between languages, go."""
    small_batches(spark)
    model = language.fit(spark, language.training_rows(docs))
    found = packed(docs).withColumn("language", language.predictor(spark, model)(F.col("d.text")))
    kept = (F.col("language.lang_pred") != language.UNDETERMINED) & (F.col("language.score") >= LEAST_SCORE)
    return found.where(kept).select("d.*")


@tidied
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, repeated rows included: the first by doc_id."""
    rows = numbered(Workspace(spark, "pipeline-minhash"), docs)
    kept = minhash.near_duplicates(spark, rows.select(F.col("row").alias("doc_id"), "d.text")).where("kept")
    return rows.join(kept.select(F.col("doc_id").alias("row")), "row", "left_semi").select("d.*")


@tidied
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier row by doc_id has; documents with nothing left go."""
    work = Workspace(spark, "pipeline-suffixes")
    data = F.coalesce("d.text", F.lit("")).cast("binary").alias("data")
    rows = in_order(docs).select("row", F.col("row").alias("doc"), data, F.col("d").dropFields("text").alias("d"))
    kept = suffixes.cut(spark, work, work.save_by(rows, "texts", "row"), keep=("d",)).where("kept <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


def copy_column(docs: DataFrame) -> str:
    """A name that is free in ``docs``: copy, or that with underscores."""
    name, taken = "copy", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


@tidied
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, to the nearest whole number; sources get their target weights. A last column, copy (or
    the name that copy_column() finds), numbers them."""
    rows = numbered(Workspace(spark, "pipeline-mixing"), docs)
    taken = mixing.mix(spark, rows.select("row", "d.doc_id", "d.text", "d.source"), keep=("row",)).where("size > 0")
    copies = taken.select("row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    many = rows.join(copies, "row").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return many.select("d.*", F.col("n").alias(copy_column(docs)))


@tidied
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, n_pieces, lossless and ids. The last column numbers copies, if mix_sources() made it."""
    last = docs.columns[-1]
    made = last.rstrip("_") == "copy" and dict(docs.dtypes)[last] == "int"
    return pieces.encode(spark, docs, copy=last if made else None)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: SQL has neither the language model nor the hash-shuffled blocks; tests/llm/test_pipeline.py holds run() against plain
#: Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
