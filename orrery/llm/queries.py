"""The operators as registered queries: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .decontaminate import leaks
from .langid import identify, page_evidence
from .oracles import ORACLES  # noqa: F401
from .packing import pack
from .permutation import neighbours
from .quality import quality_scores
from .simhash import simhash_groups
from .substring import without_repeats
from .suffixes import without_shared
from .transducer import token_counts
from .warc import read_archive, write_archive


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare their language in `lang`; `source` stands for the host."""
    return identify(_read(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages: markup language, address suffix and host; likelihoods from documents."""
    pages = page_evidence(_read(spark, sf_dir, "pages"))
    return identify(pages, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), labelled=_read(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "page_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write_archive(_read(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op5_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_read(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_shared(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_quality, op3_warc, op4_transducer, op5_permutation, op6_packing, op7_recompression, op8_decontaminate, op9_suffixes, op10_simhash, langid_pages)}
