"""Requests to plans: a collection's records, one search entry point, and the choice of strategy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import routing
from ..functions import text as T
from ..functions import vectors as V
from ..operators import filters, graph, lexical, quantized, shape

RESULT = ("id", "namespace", "score", "metadata", "payload")


def batch_scores(batch: pa.RecordBatch, queries: np.ndarray, metric: str, k: int) -> pa.RecordBatch:
    """(query, namespace, id, score) of a batch's rows that may be among the k best of a query: one matrix product tells
    which, and these are then scored row by row, so that equal vectors have equal scores wherever they lie."""
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    own, theirs = (x * x).sum(1), (queries * queries).sum(1)

    def scores(product, i, j):
        if metric == "dot":
            return product
        if metric == "l2":
            return 2 * product - own[i] - theirs[j]
        norms = own[i] * theirs[j]
        return np.divide(product, np.sqrt(norms), out=np.zeros_like(product), where=norms > 0)

    rough = scores(x @ queries.T, np.arange(len(x))[:, None], np.arange(len(queries))[None, :])
    if len(x) > k:
        bar = np.partition(rough, len(x) - k, axis=0)[len(x) - k]
        i, j = np.nonzero(rough >= bar - 1e-9 * (1 + np.abs(bar) + own.max() + theirs))
    else:
        i, j = (a.ravel() for a in np.indices(rough.shape))
    sharp = -((x[i] - queries[j]) ** 2).sum(1) if metric == "l2" else scores((x[i] * queries[j]).sum(1), i, j)
    at = pa.array(i)
    return pa.record_batch({"query": pa.array(j, pa.int32()), "namespace": batch.column("namespace").take(at), "id": batch.column("id").take(at), "score": pa.array(sharp)})


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("namespace"), F.asc("id")]


@dataclass(frozen=True)
class Rerank:
    """A second stage: `maxsim` over a multi-vector field, or `cross_encoder` with a Reranker."""

    type: str
    candidates: int = 0
    field: str = ""
    multi_vector: Sequence[Sequence[float]] = ()
    reranker: shape.Reranker | None = None
    query: str = ""
    document: str = "text"


@dataclass
class Collection:
    """A collection's live records with its configuration; a stored graph, codebook or inverted index may come along."""

    config: M.CollectionConfig
    records: DataFrame
    fields: object = None
    graph_index: DataFrame | None = None
    codebook: quantized.Codebook | None = None
    postings: DataFrame | None = None
    text_totals: DataFrame | None = None
    rerank_applied: bool = field(default=False, init=False)

    # ---- first stage

    def _allowed(self, namespace: str, filter: Mapping | None) -> DataFrame:
        kept = self.records.where(F.col("namespace") == namespace)
        return kept if not filter else kept.where(filters.where(filter, self.fields, exact=False))

    def dense(self, vector: Sequence[float], k: int, namespace: str = "", filter: Mapping | None = None, ef: int = 0) -> DataFrame:
        """The k best of the default vector: exact, or candidates by codes or graph and then exact."""
        q = M.check_vector(vector, self.config.dimension)
        config, rows = self.config.index.normalized(self.config.dimension), self._allowed(namespace, filter)
        if config.quantization == "binary":
            rows = quantized.sign_candidates(rows, q, k * config.oversampling)
        elif config.quantization == "pq" and self.codebook is not None:
            coded = rows if "codes" in rows.columns else quantized.with_pq_codes(rows, self.codebook)
            rows = quantized.pq_candidates(coded, self.codebook, q, self.config.metric, k * config.oversampling)
        elif config.type in ("hnsw", "diskann") and self.graph_index is not None and not filter:
            hits = graph.search(self.graph_index, self.config.metric, [("q", q)], k, ef or config.ef_search)
            rows = rows.join(F.broadcast(hits.select("namespace", "id")), ["namespace", "id"])  # k rows
        return self._scored(rows, "vector", self.config.metric, q).orderBy(*best_first()).limit(k)

    def _scored(self, rows: DataFrame, column: str, metric: str, q: Sequence[float]) -> DataFrame:
        return rows.where(F.col(column).isNotNull()).select("id", "namespace", V.to_query(metric, F.col(column), q).alias("score"), "metadata", "payload")

    def named(self, using: str, k: int, vector: Sequence[float] | None = None, multi_vector=None, namespace: str = "", filter: Mapping | None = None, candidates: int = 0) -> DataFrame:
        """The k best of a named field. A multi-vector field is searched by mean vectors; a list of query vectors is then
        matched one by one over the candidates."""
        spec = self.config.vector_field(using)
        column, rows = M.column_of(using, spec.multi_vector), self._allowed(namespace, filter)
        if multi_vector is not None and not spec.multi_vector:
            raise M.InvalidArgument(f"{using} holds single vectors")
        if multi_vector is None:
            if vector is None:
                raise M.InvalidArgument("a query vector is needed")
            q = M.check_vector(vector, spec.dimension)
        else:
            many = M.check_multi_vector(multi_vector, spec.dimension)
            q = [sum(c) / len(many) for c in zip(*many)]
        if not spec.multi_vector:
            return self._scored(rows, column, spec.metric, q).orderBy(*best_first()).limit(k)
        held = rows.where(F.col(column).isNotNull() & (F.size(column) > 0)).withColumn("_pooled", V.mean_pool(F.col(column), spec.dimension))
        pooled = held.select("id", "namespace", V.to_query(spec.metric, F.col("_pooled"), q).alias("score"), "metadata", "payload")
        if multi_vector is None:
            return pooled.orderBy(*best_first()).limit(k)
        count = max(candidates, k) if candidates else min(max(4 * k, 100), max(1000, k))
        first = pooled.orderBy(*best_first()).limit(count)
        return shape.rescored(first, self.records, column, spec.metric, many).select(*RESULT).orderBy(*best_first()).limit(k)

    def hybrid(self, k: int, vector=None, sparse_vector=None, text: str = "", alpha: float | None = None, fusion: str = "weighted", namespace: str = "", filter: Mapping | None = None) -> DataFrame:
        """Each signal's best, fused. Weighted: every candidate's scores under all signals, joined back for the candidates
        only. rrf: reciprocal ranks in the signals' own lists, over the whole collection."""
        if sparse_vector is None and not text:
            raise M.InvalidArgument("hybrid search needs sparse_vector or text")
        if fusion not in ("", "weighted", "rrf"):
            raise M.InvalidArgument(f"unknown fusion {fusion!r}")
        M.between("alpha", 0.5 if alpha is None else alpha, 0, 1)
        if k <= 0:
            raise M.InvalidArgument("top_k must be positive")
        reach, rows = max(4 * k, 100), self._allowed(namespace, filter)
        lists: dict[str, DataFrame] = {}
        if vector is not None:
            q = M.check_vector(vector, self.config.dimension)
            lists["dense"] = self._scored(rows, "vector", self.config.metric, q).select("namespace", "id", "score")
        if sparse_vector is not None:
            lists["sparse"] = lexical.sparse(rows, M.check_sparse(sparse_vector))
        known = None
        if text:
            if self.postings is not None:
                known = lexical.corpus_of_postings(self.postings, M.check_text(text), self.text_totals)
                asked = self.postings.where(F.col("namespace") == namespace)
                lists["text"] = lexical.bm25_from_postings(asked, text, rows if filter else None, known)
            else:
                known = lexical.corpus(self.records, M.check_text(text))
                lists["text"] = lexical.bm25(rows, text, known=known)
        tops = {n: s.orderBy(*best_first()).limit(reach) for n, s in lists.items()}
        if fusion == "rrf":
            order = Window.orderBy(*best_first())
            ranks = [t.withColumn("rank", F.row_number().over(order)).select("namespace", "id", (1.0 / (M.RRF_CONSTANT + F.col("rank"))).alias("part")) for t in tops.values()]
            fused = reduce(DataFrame.unionByName, ranks).groupBy("namespace", "id").agg(F.sum("part").alias("score"))
        elif len(lists) == 1:
            fused = next(iter(lists.values()))
        else:
            keys = reduce(DataFrame.unionByName, [t.select("namespace", "id") for t in tops.values()]).distinct()
            near = rows.join(F.broadcast(keys), ["namespace", "id"])  # at most `reach` keys of each list
            fused = self._mixed(near, lists, keys, known, vector, sparse_vector, 0.5 if alpha is None else alpha)
        top = fused.orderBy(*best_first()).limit(k)
        return rows.select("namespace", "id", "metadata", "payload").join(F.broadcast(top), ["namespace", "id"]).select(*RESULT).orderBy(*best_first())  # k rows

    def _mixed(self, near: DataFrame, lists: Mapping, keys: DataFrame, known: lexical.Corpus | None, vector, sparse_vector, alpha: float) -> DataFrame:
        """(namespace, id, score) of the candidates: their scores under all signals, weighted."""
        parts = []
        if "sparse" in lists:
            weights = M.check_sparse(sparse_vector)
            parts.append((F.coalesce(V.sparse_cosine(F.col("sparse_vector"), weights), F.lit(0.0)) + 1) / 2)
        if "text" in lists:
            if self.postings is not None:
                found = lists["text"].join(F.broadcast(keys), ["namespace", "id"], "left_semi").withColumnRenamed("score", "_text")
                near = near.join(F.broadcast(found), ["namespace", "id"], "left")
                own = F.coalesce("_text", F.lit(0.0))
            else:
                near = near.withColumn("_tokens", F.explode(F.array(F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")))))
                own = known.score(F.col("_tokens"), F.size("_tokens"))
            parts.append(V.bm25_saturated(own))
        score = sum(parts[1:], parts[0]) / len(parts)
        if vector is not None:
            q = M.check_vector(vector, self.config.dimension)
            dense = V.normalized_score(self.config.metric, V.to_query(self.config.metric, F.col("vector"), q))
            score = alpha * F.when(F.col("vector").isNull(), 0.0).otherwise(dense) + (1 - alpha) * score
        return near.select("namespace", "id", score.alias("score"))

    # ---- the whole request

    def search(self, vector=None, *, top_k: int, sparse_vector=None, text: str = "", alpha: float | None = None, fusion: str = "weighted", ef_search: int = 0, namespace: str = "", filter: Mapping | None = None, offset: int = 0, group_by: str | None = None, group_size: int | None = None, using: str | None = None, multi_vector=None, candidates: int = 0, rerank: Rerank | None = None) -> DataFrame:
        """Search, rerank, then page or group. Columns: id, namespace, score, metadata, payload (and group_rank, hit_rank)."""
        count = shape.window_size(top_k, offset, group_by, group_size)
        M.between("ef_search", ef_search, 0, 10_000)
        filters.parse(filter)
        words = sparse_vector is not None or bool(text)
        if multi_vector is not None and not using:
            raise M.InvalidArgument("multi_vector needs using")
        if using and words:
            raise M.InvalidArgument("a named search takes neither sparse_vector nor text")
        if candidates and not using:
            raise M.InvalidArgument("candidates needs using")
        M.between("candidates", candidates, 0, M.MAX_RERANK)
        pool = count
        if rerank is not None:
            if rerank.type not in ("maxsim", "cross_encoder"):
                raise M.InvalidArgument(f"unknown rerank type {rerank.type!r}")
            most = rerank.reranker.max_documents if rerank.type == "cross_encoder" and rerank.reranker else M.MAX_RERANK
            pool = shape.rerank_pool(count, rerank.candidates, most)
        if using:
            found = self.named(using, pool, vector, multi_vector, namespace, filter, candidates)
        elif words:
            found = self.hybrid(pool, vector, sparse_vector, text, alpha, fusion, namespace, filter)
        else:
            if vector is None:
                raise M.InvalidArgument("a query is needed")
            found = self.dense(vector, pool, namespace, filter, ef_search)
        order = best_first()
        if rerank is not None:
            found, order = self._reranked(found, rerank)
        if group_by:
            out = shape.grouped(found.orderBy(*order).limit(count), shape.typed_value(group_by), order, top_k, offset, group_size or 1)
            return out.orderBy("group_rank", "hit_rank").drop("_at")
        return shape.page(found, order, top_k, offset).drop("_at")

    def _reranked(self, found: DataFrame, rerank: Rerank) -> tuple[DataFrame, list[Column]]:
        if rerank.type == "maxsim":
            spec = self.config.vector_field(rerank.field)
            if not spec.multi_vector:
                raise M.InvalidArgument("maxsim needs a multi-vector field")
            many = M.check_multi_vector(rerank.multi_vector, spec.dimension)
            return shape.rescored(found, self.records, M.column_of(rerank.field, True), spec.metric, many).select(*RESULT), best_first()
        if rerank.reranker is None or not rerank.query:
            raise M.InvalidArgument("cross_encoder needs a reranker and a query")
        read = shape.document_column(rerank.document)
        texts = self.records.select("namespace", "id", "text").join(F.broadcast(found.select("namespace", "id")), ["namespace", "id"])  # the pool
        rows = found.join(texts, ["namespace", "id"]).withColumn("_document", read).drop("text").orderBy(*best_first()).collect()  # at most MAX_RERANK
        done, self.rerank_applied = shape.cross_encoded(rows, lambda r: r["_document"], rerank.query, rerank.reranker)
        if not self.rerank_applied:
            done = [(r, r["score"]) for r in rows]
        spark = found.sparkSession
        out = spark.createDataFrame([(r["id"], r["namespace"], s, r["metadata"], r["payload"], i) for i, (r, s) in enumerate(done)], f"id string, namespace string, score double, metadata {M.METADATA.simpleString()}, payload string, _at int")
        return out, [F.asc("_at")]

    def batch_search(self, queries: Sequence[Sequence[float]], top_k: int, namespace: str = "", filter: Mapping | None = None) -> DataFrame:
        """The k best for each of up to MAX_BATCH_QUERIES queries, in one pass: query (from 0), rank, id, namespace, score."""
        if not 1 <= len(queries) <= M.MAX_BATCH_QUERIES:
            raise M.InvalidArgument(f"a batch holds 1 to {M.MAX_BATCH_QUERIES} queries")
        asked = [M.check_vector(q, self.config.dimension) for q in queries]
        rows = self._allowed(namespace, filter).where(F.col("vector").isNotNull()).select("namespace", "id", "vector")
        metric, many = self.config.metric, np.array(asked, np.float64)

        def score(batches):
            for batch in batches:
                if batch.num_rows:
                    yield batch_scores(batch, many, metric, top_k)

        scored = rows.mapInArrow(score, "query int, namespace string, id string, score double")
        order = Window.partitionBy("query").orderBy(*best_first())
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query", "rank", "id", "namespace", "score")

    # ---- keys and scans

    def get(self, id: str, namespace: str = "") -> DataFrame:
        found = self.records.where((F.col("namespace") == namespace) & (F.col("id") == id)).limit(1)
        if found.isEmpty():
            raise M.NotFound(id)
        return found

    def scroll(self, limit: int = M.DEFAULT_PAGE, namespace: str = "", after: tuple[str, str] | None = None, include_vector: bool = False, shard: int | None = None) -> DataFrame:
        """A page of records in key order after a key; an empty namespace means all. Only the default vector is left out.
        A shard number keeps the keys of one logical shard."""
        M.between("limit", limit, 1, M.MAX_PAGE)
        return self.page(limit, namespace, after, include_vector, shard)

    def page(self, limit: int, namespace: str = "", after: tuple[str, str] | None = None, include_vector: bool = False, shard: int | None = None) -> DataFrame:
        """The same without a bound, for a caller that asks for one more to see whether any follow."""
        rows = self.records if not namespace else self.records.where(F.col("namespace") == namespace)
        if after is not None:
            ns, key = after
            rows = rows.where((F.col("namespace") > ns) | ((F.col("namespace") == ns) & (F.col("id") > key)))
        if shard is not None:
            rows = rows.where(routing.shard(F.col("namespace"), F.col("id"), self.config.shard_count) == shard)
        if not include_vector:
            rows = rows.drop("vector")
        return rows.orderBy("namespace", "id").limit(limit)

    def count(self) -> int:
        return self.records.count()


def recall(found: DataFrame, exact: DataFrame, by: Sequence[str] = ("query",), key: str = "id") -> DataFrame:
    """Share of the exact hits that an approximate search found, over all queries: recall."""
    hits = exact.select(*by, key).join(found.select(*by, key).withColumn("hit", F.lit(1)), [*by, key], "left")
    return hits.agg((F.count("hit") / F.count("*")).alias("recall"))
