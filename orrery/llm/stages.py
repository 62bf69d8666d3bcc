"""The stages of the corpus pipeline: language ID, near-duplicates, shared substrings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. Rows with a null doc_id can't be named by a decision: the filters leave them in. Clashing columns
beside those of documents are not read and not returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import collected, release, settled, written
from .decontaminate import leaks
from .langid import identify
from .packing import pack
from .simhash import near_duplicates
from .suffixes import without_shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROWS_A_FILE = 20_000  # of documents that a stage writes
MOST_BROADCAST = 1_000_000  # ids


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is not among ids. Texts stay where they are unless there are very many ids."""
    gone = settled(ids.distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, "doc_id", "left_anti").select(COLUMNS)


def _stage(f: Callable) -> Callable:
    """A stage on its own: executors have the package, Arrow batches are bounded, and heaps hold nothing of earlier stages."""

    @wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(ship(spark))
        return f(spark, docs, sf_dir)

    return begun


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; `lang` is what they declare, `source` their host."""
    found = identify(docs, declared=F.col("lang"), host=F.col("source"))
    return _without(docs, found.where(~F.col("accepted")).select("doc_id"))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Of rows that share a doc_id, that with
    the smallest text stays, then the smallest of the other columns."""
    groups = settled(near_duplicates(docs))
    left = _without(docs, groups.where("doc_id <> component_id").select("doc_id"))
    ids = groups.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids["n"] != ids["d"]:
        known = left.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
        left = known.unionByName(left.where("doc_id is null"))
    return left


@_stage
def shared_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that one with a smaller doc_id holds; those of which nothing stays go."""
    cut = without_shared(docs, carry=("lang", "source"), characters=True)
    rows = cut.withColumn("text", F.col("kept").cast("string")).where(~((F.col("n_removed") > 0) & F.col("text").rlike(r"^\s*$")))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@_stage
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("shared_text", shared_text), ("benchmark_free", benchmark_free), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        files = 1 + docs.count() // ROWS_A_FILE
        docs = written(stage(spark, docs, sf_dir).coalesce(files))
        release()
    return docs
