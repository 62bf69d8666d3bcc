"""Paging, grouping and reranking of ranked results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import vectors as V


def window_size(top_k: int, offset: int = 0, group_by: str | None = None, group_size: int | None = None) -> int:
    """How many candidates the first stage must return for a page or its groups."""
    if offset < 0:
        raise M.InvalidArgument("offset must not be negative")
    if not group_by and group_size:
        raise M.InvalidArgument("group_size needs group_by")
    if top_k <= 0:
        raise M.InvalidArgument("top_k must be positive")
    if offset + top_k > M.MAX_WINDOW:
        raise M.InvalidArgument(f"offset + top_k must not exceed {M.MAX_WINDOW}")
    if not group_by:
        return offset + top_k
    M.between("group_size", group_size or 1, 1, M.MAX_GROUP_SIZE)
    return min((offset + top_k) * (group_size or 1) * M.GROUP_OVERSAMPLE, M.MAX_WINDOW)


def page(ranked: DataFrame, order: Sequence[Column], top_k: int, offset: int = 0) -> DataFrame:
    return ranked.orderBy(*order).offset(offset).limit(top_k) if offset else ranked.orderBy(*order).limit(top_k)


def grouped(candidates: DataFrame, value: Column, order: Sequence[Column], top_k: int, offset: int = 0, group_size: int = 1) -> DataFrame:
    """Hits of the groups `offset`..`offset + top_k` in order of their best hit, at most `group_size` each.

    Adds group_rank and hit_rank from 1. Candidates are a bounded page, so one window orders them. Null values are in no
    group.
    """
    ranked = candidates.withColumn("_g", value).withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where("_g is not null")
    own = Window.partitionBy("_g")
    placed = ranked.withColumn("_first", F.min("_rn").over(own)).withColumn("hit_rank", F.row_number().over(own.orderBy("_rn")))
    placed = placed.withColumn("group_rank", F.dense_rank().over(Window.orderBy("_first")))
    kept = placed.where((F.col("group_rank") > offset) & (F.col("group_rank") <= offset + top_k) & (F.col("hit_rank") <= group_size))
    return kept.drop("_g", "_rn", "_first")


def typed_value(name: str, column: str = "metadata") -> Column:
    """A metadata field as a grouping key that keeps kinds apart; null where missing or null."""
    e = F.col(column)[name]
    return F.when(e["kind"].isin("s", "d", "b", "x"), F.concat(e["kind"], F.lit(":"), F.coalesce(e["s"], e["d"].cast("string"), e["b"].cast("string"), e["raw"])))


def rerank_pool(window: int, candidates: int = 0, most: int = M.MAX_RERANK) -> int:
    """How many first-stage results a second stage reads."""
    if not 0 <= candidates <= M.MAX_RERANK or window > M.MAX_RERANK:
        raise M.InvalidArgument(f"rerank candidates and the window must not exceed {M.MAX_RERANK}")
    if candidates > most:
        raise M.InvalidArgument(f"the reranker takes at most {most} documents")
    return max(candidates, window) if candidates else max(min(max(M.DEFAULT_RERANK, window), most), window)


def rescored(results: DataFrame, records: DataFrame, column: str, metric: str, query: Sequence[Sequence[float]]) -> DataFrame:
    """Late interaction: candidates that have the field, scored anew on its vectors."""
    own = records.select("namespace", "id", F.col(column).alias("_vectors")).where(F.col("_vectors").isNotNull() & (F.size("_vectors") > 0))
    joined = results.drop("score").join(own, ["namespace", "id"])
    return joined.withColumn("score", V.max_sim(metric, query, F.col("_vectors"))).drop("_vectors")


class Reranker(Protocol):
    max_documents: int

    def score(self, query: str, documents: list[str]) -> list[float]: ...


def document_column(source: str = "text") -> Column:
    """What a reranker reads: the record's text, or a payload or metadata key; what is no string as JSON."""
    if source in ("", "text"):
        return F.coalesce(F.col("text"), F.lit(""))
    place, _, key = source.partition(".")
    if place not in ("payload", "metadata") or not key:
        raise M.InvalidArgument(f"bad document source {source!r}")
    if place == "payload":
        return F.coalesce(F.get_json_object("payload", f"$['{key}']"), F.lit(""))
    e = F.col("metadata")[key]
    return F.coalesce(e["s"], e["raw"], e["d"].cast("string"), e["b"].cast("string"), F.lit(""))


def cut_bytes(text: str, most: int = M.MAX_RERANK_BYTES) -> str:
    """The longest prefix of at most `most` UTF-8 bytes that cuts no character."""
    return text.encode()[:most].decode("utf-8", "ignore")


def cross_encoded(rows: list, document: Callable, query: str, reranker: Reranker) -> tuple[list, bool]:
    """Rows in the order of the reranker's scores, equal ones as they were; the given order if it fails."""
    try:
        scores = [float(s) for s in reranker.score(query, [cut_bytes(document(r)) for r in rows])]
        if len(scores) != len(rows) or any(s != s for s in scores):
            raise ValueError("one score a document is needed")
    except Exception:
        return rows, False
    order = sorted(range(len(rows)), key=lambda i: -scores[i])
    return [(rows[i], scores[i]) for i in order], True
