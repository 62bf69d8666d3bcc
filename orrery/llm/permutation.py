"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `prefix` nearest pivots in order. Vectors are dealt into blocks; a block is one row that
holds its vectors, their ids and the pivot inverted file: for each pivot the block's vectors that list it, with the place
it has there. A query reads the lists of its own nearest pivots only, sums each vector's footrule distance (pivots outside
a prefix count as lying at its end), keeps the best `share` of the block and ranks these by exact cosine.

Equal vectors are one entry with the ids that can still count. Queries go over the blocks in broadcast slabs of a fixed
number of rows, so nothing that is sent grows with the tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

PIVOTS = 128
PREFIX = 64
BLOCK = 8192
SLAB = 8192
LEAST = 64  # vectors of a block that are reranked at least
SAMPLE, TRIALS, RECALL = 2048, 128, 0.97  # vectors and queries by which the reranked share is fitted, and what to reach
BLOCK_ROW = "block long, rows int, vectors binary, first binary, ids binary, starts binary, members binary, places binary"


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indexes of each vector's nearest pivots by cosine, nearest first; ties to the lower index."""
    out = np.empty((len(unit), min(prefix, len(pivots))), np.int16)
    for lo in range(0, len(unit), 4096):
        out[lo : lo + 4096] = np.argsort(-(unit[lo : lo + 4096] @ pivots.T), axis=1, kind="stable")[:, : out.shape[1]]
    return out


def inverted(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pivot inverted file of ordered pivots: where each pivot's list starts, its members, and the pivot's place there."""
    flat = order.ravel().astype(np.int64)
    by = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[by], np.arange(pivots + 1)).astype(np.int32), (by // order.shape[1]).astype(np.int32), (by % order.shape[1]).astype(np.int16)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def fitted_share(unit: np.ndarray, pivots: int, prefix: int, k: int) -> float:
    """The share of a sample that must be reranked by exact cosine so that RECALL of the true k nearest are among them."""
    trials = min(TRIALS, len(unit) // 2)
    if trials < 8:
        return 1.0
    order = nearest_pivots(unit, unit[:pivots], prefix)
    place = np.full((len(unit), min(pivots, len(unit))), order.shape[1], np.int32)
    np.put_along_axis(place, order.astype(np.int64), np.arange(order.shape[1], dtype=np.int32)[None, :].repeat(len(unit), 0), 1)
    asked = np.arange(len(unit) - trials, len(unit))  # none of them a pivot, if there are enough
    needed = []
    for q in asked:
        foot = np.abs(place - place[q]).sum(1)
        near = unit @ unit[q]
        near[q], foot[q] = -2, 1 << 30
        rank = np.empty(len(unit), np.int64)
        rank[np.argsort(foot, kind="stable")] = np.arange(len(unit))
        needed.append(rank[np.argsort(-near)[:k]] + 1)
    return float(np.quantile(np.concatenate(needed), RECALL)) / len(unit)


def _search_block(queries: np.ndarray, q_order: np.ndarray, vectors: np.ndarray, unit: np.ndarray, lists: tuple, rerank: int):
    """Yields for each query the rows of the block that are best by footrule, and their cosines."""
    starts, members, places = lists
    prefix = q_order.shape[1]
    for i in range(len(queries)):
        shared = np.zeros(len(vectors), np.int32)  # a vector's footrule is a constant less this
        for place, pivot in enumerate(q_order[i]):
            a, b = starts[pivot], starts[pivot + 1]
            shared[members[a:b]] += 2 * (prefix - np.maximum(places[a:b], place))
        rows = np.argpartition(-shared, rerank)[:rerank] if len(shared) > rerank else np.arange(len(shared))
        rows = np.sort(rows)
        yield i, rows, (unit[rows] * queries[i]).sum(1)


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK, share: float | None = None, least: int = LEAST, slab: int = SLAB) -> DataFrame:
    """Per query and rank 1..k: query_id, rank, vec_id, score (cosine in double precision, largest first, ties to the
    smaller vec_id).

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those with the query's own id.
    Rows take no part whose vector or id is null, whose vector is zero, holds null or non-finite components, or has not
    the length that most vectors have (ties: the smaller). Rows repeated with id and vector count once. Fewer candidates
    than k give fewer rows; other columns are not read; an empty table gives an empty result. Pivots are a bounded sample
    of distinct vectors; every vector is indexed. Of each block the best `share` by footrule (at least `least` vectors)
    are reranked, so recall does not fall as blocks are added. If None, the share is fitted on a sample of SAMPLE vectors
    so that RECALL of its nearest are found: vectors with less structure, or more dimensions, get a larger one.
    """
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    sound_rows = rows.where(sound)
    common = sound_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], result)
    dim = common["d"]
    clean = sound_rows.where(F.size("v") == dim)
    own = Window.partitionBy("v").orderBy("id")
    firsts = clean.distinct().withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)  # more can't be among k
    classes = kept(firsts.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = classes.count()
    drawn = classes.orderBy(F.xxhash64("v"), "v").select("v").limit(max(pivots, SAMPLE if share is None else 0)).toArrow()
    sample = _unit(drawn.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
    anchor = sample[:pivots]
    share = fitted_share(sample, pivots, prefix, k) if share is None else share
    blocks = max(1, -(-total // block))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        starts, members, places = inverted(nearest_pivots(_unit(x), anchor, prefix), len(anchor))
        ids = table.column("ids").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int32)
        cells = {"vectors": x, "first": bounds, "ids": ids.flatten().to_numpy(), "starts": starts, "members": members, "places": places}
        out = {"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "rows": pa.array([len(x)], pa.int32())}
        return pa.table(out | {n: pa.array([c.tobytes()], pa.binary()) for n, c in cells.items()})

    index = kept(classes.withColumn("first", F.col("ids")[0]).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).groupBy("block").applyInArrow(build, BLOCK_ROW))
    asked = kept(clean.where(F.col("id") % every == 0).distinct())
    count = asked.count()
    slabs = max(1, -(-count // slab))
    parts = []
    for n in range(slabs):
        here = asked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(slabs)) == n).select("id", "v").toArrow()  # about `slab` rows, whatever the table holds
        if not here.num_rows:
            continue
        q_ids = here.column("id").to_numpy()
        q = _unit(here.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        shared = spark.sparkContext.broadcast((q_ids, q, nearest_pivots(q, anchor, prefix)))

        def search(batches, shared=shared):
            q_ids, q, q_order = shared.value
            best: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids)
            for batch in batches:
                for r in batch.select([c for c in batch.schema.names if c != "block"]).to_pylist():
                    x = np.frombuffer(r["vectors"], np.float64).reshape(r["rows"], dim)
                    first, ids = np.frombuffer(r["first"], np.int32), np.frombuffer(r["ids"], np.int64)
                    lists = np.frombuffer(r["starts"], np.int32), np.frombuffer(r["members"], np.int32), np.frombuffer(r["places"], np.int16)
                    for i, at, score in _search_block(q, q_order, x, _unit(x), lists, max(least, int(share * len(x)))):
                        at, score = at[(top := np.argsort(-score, kind="stable")[: 2 * k + 2])], score[top]
                        span = first[at + 1] - first[at]
                        found = np.concatenate([ids[first[a] : first[a + 1]] for a in at])
                        scores = np.repeat(score, span)
                        ok = found != q_ids[i]
                        scores, found = np.concatenate([best[i][0], scores[ok]]), np.concatenate([best[i][1], found[ok]])
                        order = np.lexsort((found, -scores))[:k]
                        best[i] = scores[order], found[order]
            sizes = [len(f) for _, f in best]
            if sum(sizes):
                yield pa.record_batch({"query_id": pa.array(np.repeat(q_ids, sizes)), "vec_id": pa.array(np.concatenate([f for _, f in best])), "score": pa.array(np.concatenate([s for s, _ in best]))})

        parts.append(index.mapInArrow(search, "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], result)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
