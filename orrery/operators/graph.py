"""Graph indexes: a proximity graph per block of records, searched block by block, best hits merged.

A block is one row with its vectors and adjacency. Layered graphs (`hnsw`) descend from the top layer; single-layer ones
(`diskann`) are pruned by angle with a slack factor and entered at their medoid. Blocks are independent, so a build or a
search is as many tasks as there are blocks, and a lost one is redone alone.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import IndexConfig

BLOCK = 4096


def _scores(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric == "l2":
        return -((x - q) ** 2).sum(-1)
    return x @ q


def _beam(x: np.ndarray, metric: str, links, q: np.ndarray, entry: list[int], width: int) -> list[tuple[float, int]]:
    """Best-first walk that keeps the `width` best nodes seen; descending by score."""
    seen = set(entry)
    first = _scores(metric, x[entry], q)
    best = [(float(s), -i) for s, i in zip(first, entry)]
    heapq.heapify(best)
    queue = [(-float(s), i) for s, i in zip(first, entry)]
    heapq.heapify(queue)
    while queue:
        score, node = heapq.heappop(queue)
        if len(best) >= width and -score < best[0][0]:
            break
        fresh = [j for j in links(node) if j not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for s, j in zip(_scores(metric, x[fresh], q).tolist(), fresh):
            if len(best) < width or s > best[0][0]:
                heapq.heappush(best, (s, -j))
                heapq.heappush(queue, (-s, j))
                if len(best) > width:
                    heapq.heappop(best)
    return sorted(((s, -i) for s, i in best), key=lambda b: (-b[0], b[1]))


def _diverse(x: np.ndarray, metric: str, node: int, found: list[tuple[float, int]], most: int, slack: float = 1.0) -> list[int]:
    """Neighbours in order of nearness, without those that lie nearer to one taken than to the node."""
    taken: list[int] = []
    for score, j in found:
        if j == node or len(taken) == most:
            continue
        if taken:
            near = float(_scores(metric, x[taken], x[j]).max())
            if (near * slack > score) if metric != "l2" else (near > score * slack):
                continue
        taken.append(j)
    for _, j in found:  # fill up, so that clusters stay connected
        if len(taken) == most:
            break
        if j != node and j not in taken:
            taken.append(j)
    return taken


def build_layers(x: np.ndarray, metric: str, config: IndexConfig, seed: int = 42) -> dict:
    """A layered graph: each node enters at a random height and links to diverse neighbours on every layer below."""
    draw = np.random.default_rng(seed)
    height = np.minimum((-np.log(np.maximum(draw.random(len(x)), 1e-12)) / np.log(config.m)).astype(int), 16)
    layers: list[dict[int, list[int]]] = [{} for _ in range(int(height.max(initial=0)) + 1)]
    entry, top = 0, int(height[0]) if len(x) else 0
    for node in range(len(x)):
        at = [entry]
        for level in range(top, int(height[node]), -1):
            if node:
                at = [_beam(x, metric, lambda i, g=layers[level]: g.get(i, ()), x[node], at, 1)[0][1]]
        for level in range(min(top, int(height[node])), -1, -1):
            graph, most = layers[level], config.m * (2 if level == 0 else 1)
            found = _beam(x, metric, lambda i, g=graph: g.get(i, ()), x[node], at, config.ef_construction) if node else []
            graph[node] = _diverse(x, metric, node, found, config.m)
            for j in graph[node]:
                graph.setdefault(j, []).append(node)
                if len(graph[j]) > most:
                    near = _scores(metric, x[graph[j]], x[j])
                    ranked = sorted(zip(near.tolist(), graph[j]), key=lambda b: (-b[0], b[1]))
                    graph[j] = _diverse(x, metric, j, ranked, most)
            at = [i for _, i in found] or at
        for level in range(top + 1, int(height[node]) + 1):
            layers[level][node] = []
        if height[node] > top:
            entry, top = node, int(height[node])
    return {"layers": layers, "entry": entry, "top": top}


def build_flat_graph(x: np.ndarray, metric: str, config: IndexConfig, seed: int = 42) -> dict:
    """A single-layer graph from random links, refined in two passes (the second with slack) around the medoid."""
    n, degree = len(x), min(config.max_degree, max(len(x) - 1, 1))
    draw = np.random.default_rng(seed)
    middle = int(_scores("l2", x, x.mean(0)).argmax()) if n else 0
    graph = {i: [int(j) for j in draw.choice(n, min(degree, n), replace=False) if j != i] for i in range(n)}
    for slack in (1.0, config.alpha):
        for node in draw.permutation(n).tolist():
            found = _beam(x, metric, lambda i: graph[i], x[node], [middle], config.ef_construction)
            pool = {j for _, j in found} | set(graph[node])
            pool.discard(node)
            ids = sorted(pool)
            ranked = sorted(zip(_scores(metric, x[ids], x[node]).tolist(), ids), key=lambda b: (-b[0], b[1])) if ids else []
            graph[node] = _diverse(x, metric, node, ranked, degree, slack)
            for j in graph[node]:
                if node not in graph[j]:
                    graph[j].append(node)
                    if len(graph[j]) > degree:
                        ranked = sorted(zip(_scores(metric, x[graph[j]], x[j]).tolist(), graph[j]), key=lambda b: (-b[0], b[1]))
                        graph[j] = _diverse(x, metric, j, ranked, degree, slack)
    return {"layers": [graph], "entry": middle, "top": 0}


def search_graph(x: np.ndarray, metric: str, built: dict, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
    at = [built["entry"]]
    for level in range(built["top"], 0, -1):
        at = [_beam(x, metric, lambda i, g=built["layers"][level]: g.get(i, ()), q, at, 1)[0][1]]
    return _beam(x, metric, lambda i, g=built["layers"][0]: g.get(i, ()), q, at, max(k, ef))[:k]


def build(records: DataFrame, metric: str, config: IndexConfig, column: str = "vector", block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """(block, rows, vectors, keys, graph): records dealt into blocks by key hash, a graph for each."""
    dimension = records.where(F.col(column).isNotNull()).select(F.size(column).alias("d")).first()
    c = config.normalized(dimension["d"] if dimension else 0)
    total = records.count() if rows is None else rows
    blocks = max(1, -(-total // block))
    unit = metric == "cosine"

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("namespace", "ascending"), ("id", "ascending")])
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        if unit:
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x = x / np.where(norm == 0, 1, norm)
        built = (build_flat_graph if c.type == "diskann" else build_layers)(x, "l2" if metric == "l2" else "dot", c)
        keys = list(zip(table.column("namespace").to_pylist(), table.column("id").to_pylist()))
        return pa.table({"block": table.column("block").slice(0, 1), "rows": pa.array([len(x)], pa.int32()), "vectors": pa.array([x.tobytes()]), "keys": pa.array([pickle.dumps(keys)]), "graph": pa.array([pickle.dumps(built)])})

    dealt = records.where(F.col(column).isNotNull()).select("namespace", "id", F.col(column).cast("array<double>").alias("v"), F.pmod(F.xxhash64("namespace", "id"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInArrow(one, "block long, rows int, vectors binary, keys binary, graph binary")


def search(index: DataFrame, metric: str, queries: Sequence[tuple[str, Sequence[float]]], k: int, ef: int) -> DataFrame:
    """(query, rank, namespace, id, score): a block's k best each, merged; ties by key."""
    asked = [(n, np.asarray(q, float)) for n, q in queries]

    def look(batches):
        for batch in batches:
            out = []
            for r in batch.select(["rows", "vectors", "keys", "graph"]).to_pylist():
                x, keys, built = np.frombuffer(r["vectors"]).reshape(r["rows"], -1), pickle.loads(r["keys"]), pickle.loads(r["graph"])
                for name, q in asked:
                    size = np.sqrt((q * q).sum())
                    own = q / size if metric == "cosine" and size else q
                    out += [(name, *keys[i], s) for s, i in search_graph(x, "l2" if metric == "l2" else "dot", built, own, k, ef)]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(("query", "namespace", "id", "score"), cols, (pa.string(), pa.string(), pa.string(), pa.float64()))})

    order = Window.partitionBy("query").orderBy(F.desc("score"), "namespace", "id")
    found = index.mapInArrow(look, "query string, namespace string, id string, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "namespace", "id", "score")
