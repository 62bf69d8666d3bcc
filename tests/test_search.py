"""Retrieval semantics: distances, top-k, hybrid, named fields, shaping and reranking."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import model as M
from orrery.functions import text as T
from orrery.functions import vectors as V
from orrery.operators import filters, graph, lexical, quantized, shape
from orrery.plans.planner import Collection, Rerank, recall


def collection(spark, config, rows):
    """rows: dicts with id, vector and perhaps namespace, metadata, text, sparse_vector, payload, vectors."""
    schema, out = config.record_schema(), []
    floats = lambda v: v if v is None else [floats(x) if isinstance(x, list) else float(x) for x in v]
    for r in rows:
        cells = {"namespace": r.get("namespace", ""), "id": r["id"], "vector": floats(r["vector"]), "sparse_vector": r.get("sparse_vector"), "text": r.get("text"), "metadata": filters.metadata_of(r.get("metadata")), "payload": json.dumps(r["payload"]) if "payload" in r else None, "timestamp": 0, "version": 0}
        for n, spec in config.vectors.items():
            cells[M.column_of(n, spec.multi_vector)] = floats(r.get("vectors", {}).get(n))
        out.append(tuple(cells[f.name] for f in schema))
    return Collection(config, spark.createDataFrame(out, schema))


def ids(df):
    return [r["id"] for r in df.collect()]


def test_distances(spark):
    a, b, z = V.literal([1, 2]), V.literal([3, 4]), V.literal([0, 0])
    row = spark.range(1).select(V.dot(a, b), V.l2(a, b), V.cosine(a, b), V.cosine(a, z), V.normalized_score("l2", V.l2(a, b)), V.normalized_score("cosine", F.lit(0.0)), V.normalized_score("dot", F.lit(0.0))).first()
    assert list(row) == [11, -8, pytest.approx(11 / 125**0.5), 0, pytest.approx(1 / 9), 0.5, 0.5]


def test_every_length_matches_numpy(spark):
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 16, 65):
        a, b = r.normal(size=n).round(4), r.normal(size=n).round(4)
        row = spark.range(1).select(V.dot(V.literal(a), V.literal(b)), V.l2(V.literal(a), V.literal(b)), V.cosine(V.literal(a), V.literal(b))).first()
        assert np.allclose(list(row), [a @ b, -((a - b) ** 2).sum(), a @ b / np.sqrt((a @ a) * (b @ b))])


def brute(rows, score, k, keep=lambda r: True):
    """Ids by score, then namespace and id."""
    found = [(-score(r), r.get("namespace", ""), r["id"]) for r in rows if keep(r)]
    return [i for _, _, i in sorted(found)[:k]]


def harbour(seed=21, n=60):
    """Records with tied vectors, two namespaces, metadata, texts and sparse terms."""
    r = np.random.default_rng(seed)
    words = "anchor buoy crane dock eel ferry gull hull".split()
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words, size=r.integers(0, 9)))
        rows.append({"id": f"v{(i * 7) % n:02d}", "namespace": ("", "north")[i % 4 == 3], "vector": [float(x) for x in r.integers(-2, 3, size=3)], "metadata": {"depth": int(r.integers(1, 9)), "flag": str(r.choice(["nl", "pt"]))}, "text": text or None, "sparse_vector": {w: float(r.integers(1, 4)) for w in set(text.split()[:2])} or None})
    return rows


def inner(q):
    return lambda row: float(np.dot(q, row["vector"]))


def test_filtered_and_namespaces(spark):
    rows = harbour()
    c = collection(spark, M.CollectionConfig("t", 3, "dot", 2), rows)
    for q in ([1, 0, 2], [0, -1, 0]):
        for name in ("", "north", "nowhere"):
            deep = lambda row, n=name: row["namespace"] == n and row["metadata"]["depth"] >= 5 and row["metadata"]["flag"] == "pt"
            assert ids(c.search(q, top_k=6, namespace=name)) == brute(rows, inner(q), 6, lambda row, n=name: row["namespace"] == n)
            assert ids(c.search(q, top_k=6, namespace=name, filter={"flag": "pt", "depth": {"$gte": 5}})) == brute(rows, inner(q), 6, deep)


def test_order_ties_and_limits(spark):
    rows = harbour(22, 90)
    c = collection(spark, M.CollectionConfig("t", 3, "dot"), rows)
    here = lambda row: row["namespace"] == ""
    for k in (1, 7, 50):
        assert ids(c.search([0, 1, 0], top_k=k)) == brute(rows, inner([0, 1, 0]), k, here)  # five scores for all rows
    for bad in ({"top_k": 0}, {"top_k": 1, "offset": -1}, {"top_k": 10_001}, {"top_k": 1, "group_size": 2}, {"top_k": 1, "ef_search": 10_001}, {"top_k": 1, "multi_vector": [[1, 0, 0]]}, {"top_k": 1, "candidates": 5}, {"top_k": 1, "using": "x", "text": "y"}, {"top_k": 1, "alpha": 2, "text": "x"}, {"top_k": 1, "fusion": "sum", "text": "x"}):
        with pytest.raises(M.InvalidArgument):
            c.search([1, 0, 0], **bad)
    with pytest.raises(M.DimensionMismatch):
        c.search([1, 0], top_k=1)


def brute_bm25(rows, query, keep=lambda r: True):
    """(namespace, id) -> score, with statistics of all rows."""
    docs = {(r["namespace"], r["id"]): r["text"].split() for r in rows if r["text"]}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for r in filter(keep, rows):
        own = docs.get((r["namespace"], r["id"]), [])
        for w in dict.fromkeys(query.split()):
            df = sum(w in d for d in docs.values())
            if tf := own.count(w):
                weight = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                out[r["namespace"], r["id"]] = out.get((r["namespace"], r["id"]), 0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
    return out


def test_tokens_and_bm25(spark):
    assert spark.range(1).select(T.tokens(F.lit("To the Dock-side: 3 cranes_and a GULL!"))).first()[0] == ["dock", "side", "3", "cranes", "gull"]
    rows = harbour(23)
    c = collection(spark, M.CollectionConfig("t", 3), rows)
    stored = Collection(c.config, c.records, postings=lexical.postings(c.records))
    for query in ("gull", "eel crane eel", "ferry unheard"):
        for name in ("", "north"):
            for f, keep in ((None, lambda r: True), ({"depth": {"$lt": 4}}, lambda r: r["metadata"]["depth"] < 4)):
                want = brute_bm25(rows, query, lambda r, n=name, k=keep: r["namespace"] == n and k(r))
                for view in (c, stored):  # statistics are those of all rows, whatever is asked for
                    got = {(h["namespace"], h["id"]): h["score"] for h in view.search(text=query, top_k=60, namespace=name, filter=f).collect()}
                    assert got == pytest.approx(want)
    assert c.search(text="the of", top_k=3).count() == 0 and stored.search(text="the of", top_k=3).count() == 0


def test_hybrid(spark):
    rows = [r for r in harbour(24) if r["namespace"] == ""]
    c = collection(spark, M.CollectionConfig("t", 3), rows)
    q, asked, query = [1, 1, 0], {"buoy": 2.0, "hull": 1.0}, "buoy dock"
    norm = lambda v: float(np.sqrt(np.dot(v, v)))
    cosine = lambda r: 0.0 if not norm(r["vector"]) else float(np.dot(q, r["vector"])) / norm(q) / norm(r["vector"])

    def thin(r):
        own = r["sparse_vector"] or {}
        return sum(own.get(t, 0) * w for t, w in asked.items()) / max(1e-9, norm(list(own.values())) * norm(list(asked.values())))

    bm25 = brute_bm25(rows, query)
    saturated = lambda r: (s := bm25.get(("", r["id"]), 0.0)) / (s + 2)
    lists = (sorted((-cosine(r), r["id"]) for r in rows), sorted((-thin(r), r["id"]) for r in rows if thin(r)), sorted((-s, i) for (_, i), s in bm25.items()))
    for view in (c, Collection(c.config, c.records, postings=lexical.postings(c.records))):
        for alpha in (0.0, 0.3, 1.0):
            mixed = lambda r, a=alpha: a * (cosine(r) + 1) / 2 + (1 - a) * (((thin(r) + 1) / 2 if thin(r) else 0.5) + saturated(r)) / 2
            got = [(h["id"], h["score"]) for h in view.search(q, sparse_vector=asked, text=query, alpha=alpha, top_k=8).collect()]
            assert [s for _, s in got] == pytest.approx(sorted(map(mixed, rows), reverse=True)[:8])
            assert all(s == pytest.approx(mixed(next(r for r in rows if r["id"] == i))) for i, s in got)
        ranks = {}
        for found in lists:
            for place, (_, i) in enumerate(found):
                ranks[i] = ranks.get(i, 0) + 1 / (61 + place)
        got = {h["id"]: h["score"] for h in view.search(q, sparse_vector=asked, text=query, fusion="rrf", top_k=len(ranks)).collect()}
        assert got == pytest.approx(ranks, rel=0.08)  # equal scores may differ in the last bits, and so trade places


SPEC = {"title": M.VectorField(3, "dot", M.IndexConfig("hnsw"), "float16"), "body": M.VectorField(2, "l2", datatype="bfloat16"), "colbert": M.VectorField(2, "dot", multi_vector=True)}


def test_named_and_multi_vectors(spark):
    c = collection(spark, M.CollectionConfig("t", 2, vectors=SPEC), [
        {"id": "a", "vector": [1.0, 0.0], "vectors": {"title": [1.0, 0, 0], "body": [0.0, 0.0], "colbert": [[1.0, 0.0], [0.0, 0.1]]}},
        {"id": "b", "vector": [0.0, 1.0], "vectors": {"title": [0.0, 1, 0], "body": [5.0, 5.0], "colbert": [[0.6, 0.0], [0.0, 0.6]]}},
        {"id": "c", "vector": [1.0, 1.0], "vectors": {"title": [0.1, 0.1, 0.3]}},
    ])
    assert ids(c.search([0, 1, 0], top_k=2, using="title"))[0] == "b"
    assert ids(c.search([4, 4], top_k=5, using="body")) == ["b", "a"]
    top = c.search(top_k=1, using="colbert", multi_vector=[[1, 0]]).first()
    assert (top["id"], top["score"]) == ("a", 1.0)
    assert ids(c.search([1, 1], top_k=3, rerank=Rerank("maxsim", field="colbert", multi_vector=[[1, 0]]))) == ["a", "b"]
    row = spark.range(1).select(V.max_sim("dot", [[1, 0], [0, 1]], F.lit(None).cast("array<array<float>>")), V.max_sim("dot", [[1, 0], [0, 1]], F.array(V.literal([0.5, 0]), V.literal([0, 2]), V.literal([1, 0])))).first()
    assert list(row) == [0, 3]
    with pytest.raises(M.InvalidArgument):
        c.search([1, 0], top_k=1, using="nothing")


def test_grouping_and_paging(spark):
    rows = [{"id": f"r{i:02d}", "vector": [float(i), 0.0], "metadata": {"author": f"u{i % 3}"}} for i in range(12)]
    c = collection(spark, M.CollectionConfig("t", 2, "l2"), rows)
    assert ids(c.search([0, 0], top_k=3, offset=3)) == ["r03", "r04", "r05"]
    assert c.search([0, 0], top_k=3, offset=20).count() == 0
    got = c.search([0, 0], top_k=2, group_by="author", group_size=2).collect()
    assert [(r["id"], r["group_rank"], r["hit_rank"]) for r in got] == [("r00", 1, 1), ("r03", 1, 2), ("r01", 2, 1), ("r04", 2, 2)]
    authors = ["a", "b", "a", None, "c", "b", "a", "d", 1.0]
    c = collection(spark, M.CollectionConfig("t", 1, "dot"), [{"id": str(i), "vector": [10.0 - i], "metadata": {"author": x} if x is not None else {}} for i, x in enumerate(authors)])
    got = c.search([1], top_k=2, offset=1, group_by="author", group_size=2).collect()
    assert [(r["id"], r["group_rank"]) for r in got] == [("1", 2), ("5", 2), ("4", 3)]
    assert shape.window_size(2, 1, "author", 2) == (1 + 2) * 2 * 4


class Length:
    max_documents = 200

    def __init__(self, fail=False):
        self.fail = fail

    def score(self, query, documents):
        if self.fail:
            raise TimeoutError
        return [len(d) for d in documents]


def test_cross_encoder(spark):
    c = collection(spark, M.CollectionConfig("t", 2, "dot", 2), [{"id": "a", "vector": [1.0, 0.0], "text": "apples", "payload": {"doc": "alpha"}}, {"id": "b", "vector": [0.9, 0.0], "text": "bananas", "payload": {"doc": "beta"}}, {"id": "c", "vector": [0.8, 0.0], "text": "cherries!", "payload": {"doc": "gamma"}}])
    ask = lambda k, **more: ids(c.search([1, 0], top_k=k, rerank=Rerank("cross_encoder", query="q", **more)))
    assert ask(2, reranker=Length()) == ["c", "b"] and c.rerank_applied
    assert ask(1, reranker=Length(), document="payload.doc") == ["a"]
    assert ask(2, reranker=Length(True)) == ["a", "b"] and not c.rerank_applied
    assert shape.cut_bytes("é" * 5000) == "é" * 4096
    for bad in ({"type": "x"}, {"type": "cross_encoder"}, {"type": "maxsim", "field": "none"}, {"type": "cross_encoder", "reranker": Length(), "query": "q", "candidates": 2000}):
        with pytest.raises(M.InvalidArgument):
            c.search([1, 0], top_k=1, rerank=Rerank(**bad))


def test_scroll_and_get(spark):
    c = collection(spark, M.CollectionConfig("t", 1), [{"id": "b", "vector": [1.0]}, {"id": "a", "vector": [1.0]}, {"id": "c", "vector": [1.0], "namespace": "tenant"}])
    assert ids(c.scroll(2)) == ["a", "b"] and "vector" not in c.scroll(2).columns
    assert ids(c.scroll(2, after=("", "b"))) == ["c"]
    assert ids(c.scroll(5, "tenant", include_vector=True)) == ["c"]
    assert c.get("a").first()["id"] == "a"
    with pytest.raises(M.NotFound):
        c.get("c")


def vectors(spark, n, dim, clusters, seed=3):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(clusters, dim))[r.integers(clusters, size=n)] + 0.3 * r.normal(size=(n, dim))).astype(np.float32)
    rows = [("", f"{i:05d}", v.tolist(), None, None) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, f"namespace string, id string, vector array<float>, metadata {M.METADATA.simpleString()}, payload string").cache()


def mean_recall(c, exact, queries, k=10, **more):
    found = [set(ids(c.search(q, top_k=k, **more))) for q in queries]
    return np.mean([len(f & set(ids(exact.search(q, top_k=k)))) / k for f, q in zip(found, queries)])


def test_sign_codes_and_int8(spark):
    row = spark.range(1).select(V.sign_words(V.literal([1, -1, 0, 2, 0.5]), 5), F.size(V.sign_words(V.literal([1.0] * 130), 130)), V.hamming(V.sign_words(V.literal([1, -1]), 2), V.sign_words(V.literal([-1, -1]), 2))).first()
    assert list(row) == [[0b11001], 3, 1]
    v = [-1, -0.25, 0, 0.5, 1]
    scale = V.int8_scale(V.literal(v))
    row = spark.range(1).select(scale, V.int8_codes(V.literal(v), scale), V.int8_codes(V.literal([0, 0]), V.int8_scale(V.literal([0, 0])))).first()
    assert row[0] == pytest.approx(1 / 127) and list(row[1]) == [-127, -32, 0, 64, 127] and list(row[2]) == [0, 0]


def test_quantized_and_graph_recall(spark):
    x, rows = vectors(spark, 1500, 32, 30)
    exact = Collection(M.CollectionConfig("t", 32), rows)
    queries = [x[i].tolist() for i in (3, 77, 500)]
    signs = Collection(M.CollectionConfig("t", 32, index=M.IndexConfig(quantization="binary", oversampling=20)), rows)
    assert mean_recall(signs, exact, queries) >= 0.9
    book = quantized.train_codebook(rows, 8, "cosine")
    codes = Collection(M.CollectionConfig("t", 32, index=M.IndexConfig(quantization="pq", oversampling=10)), rows, codebook=book)
    assert mean_recall(codes, exact, queries) >= 0.95
    for kind in (M.IndexConfig("hnsw"), M.IndexConfig("diskann", max_degree=24, ef_construction=48)):
        index = graph.build(rows, "cosine", kind, block=800).cache()
        walked = Collection(M.CollectionConfig("t", 32, index=kind), rows, graph_index=index)
        assert mean_recall(walked, exact, queries, ef_search=128) >= 0.9
    assert recall(exact.search(queries[0], top_k=3).withColumn("query", F.lit(0)), exact.search(queries[0], top_k=3).withColumn("query", F.lit(0))).first()[0] == 1.0


@pytest.mark.parametrize("index", [{"type": "tree"}, {"type": "hnsw", "m": 1}, {"type": "hnsw", "ef_construction": 4}, {"type": "diskann", "m": 4}, {"type": "diskann", "alpha": 3.0}, {"type": "hnsw", "quantization": "pq"}, {"quantization": "pq", "pq_subspaces": 3}, {"oversampling": 3}, {"alpha": 1.1}, {"pq_subspaces": 2}, {"quantization": "binary", "oversampling": 101}])
def test_bad_configurations(index):
    with pytest.raises(M.InvalidArgument):
        M.CollectionConfig("t", 4, index=M.IndexConfig(**index)).validate()
