"""The query catalogue over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import text as T
from ..functions import vectors as V
from ..operators import control, filters, graph, lexical, memory, quantized
from ..session import ship
from ..sources import imports, store
from ..streaming import changelog
from .planner import Collection, Rerank, recall

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIM = 64
NOW = 1_700_000_000


def _asked(seed: int = 0, dimension: int = DIM) -> list[float]:
    """A query vector that SQL can hold as a literal."""
    return [round(math.sin(1.7 * i + seed), 3) for i in range(1, dimension + 1)]


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


Q0 = _list(_asked())


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _temporary(spark: SparkSession) -> str:
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orrery-")
    return f"{root.rstrip('/')}/catalogue-{uuid.uuid4().hex}"


# ---- vectors


def _vectors(spark: SparkSession, sf_dir: str, metric: str = "cosine", index: M.IndexConfig | None = None, **more) -> Collection:
    e = _table(spark, sf_dir, "embeddings")
    rows = e.select(F.lit("").alias("namespace"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label", filters.metadata_map({"label": "label"}, {"label": "d"}).alias("metadata"), F.lit(None).cast("string").alias("payload"))
    return Collection(M.CollectionConfig("embeddings", DIM, metric, index=index or M.IndexConfig()), rows, filters.NativeColumns({"label": ("label", "d")}), **more)


def _scores(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("score", 6).alias("score"))


_NORM = "list_inner_product(v, v)"
_VEC = "(SELECT vec_id::VARCHAR AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_COS = f"list_cosine_similarity(v, {Q0})"


@query(f"SELECT id, round({_COS}, 6) AS score FROM {_VEC} ORDER BY {_COS} DESC, id LIMIT 10")
def dense_cosine_topk(spark, sf_dir):
    return _scores(_vectors(spark, sf_dir).search(_asked(), top_k=10))


@query(f"SELECT id, round(list_inner_product(v, {Q0}), 6) AS score FROM {_VEC} ORDER BY list_inner_product(v, {Q0}) DESC, id LIMIT 10")
def dense_dot_topk(spark, sf_dir):
    return _scores(_vectors(spark, sf_dir, "dot").search(_asked(), top_k=10))


@query(f"SELECT id, round(-(list_distance(v, {Q0}) ** 2), 6) AS score FROM {_VEC} ORDER BY list_distance(v, {Q0}), id LIMIT 10")
def dense_l2_topk(spark, sf_dir):
    return _scores(_vectors(spark, sf_dir, "l2").search(_asked(), top_k=10))


@query(f"SELECT id, round({_COS}, 6) AS score FROM {_VEC} WHERE label IN (1, 3, 5) OR label >= 8 ORDER BY {_COS} DESC, id LIMIT 15")
def dense_filtered_topk(spark, sf_dir):
    return _scores(_vectors(spark, sf_dir).search(_asked(), top_k=15, filter={"$or": [{"label": {"$in": [1, 3, 5]}}, {"label": {"$gte": 8}}]}))


@query(f"SELECT id, round({_COS}, 6) AS score FROM {_VEC} ORDER BY {_COS} DESC, id LIMIT 7 OFFSET 5")
def offset_page(spark, sf_dir):
    return _scores(_vectors(spark, sf_dir).search(_asked(), top_k=7, offset=5))


@query(f"""WITH c AS (SELECT id, label, {_COS} AS s FROM {_VEC} ORDER BY s DESC, id LIMIT 32),
r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rn FROM c),
f AS (SELECT *, min(rn) OVER (PARTITION BY label) AS first, row_number() OVER (PARTITION BY label ORDER BY rn) AS hit_rank FROM r),
g AS (SELECT *, dense_rank() OVER (ORDER BY first) AS group_rank FROM f)
SELECT id, group_rank::INT AS group_rank, hit_rank::INT AS hit_rank, round(s, 6) AS score FROM g WHERE group_rank > 1 AND group_rank <= 4 AND hit_rank <= 2""")
def group_by_topn(spark, sf_dir):
    found = _vectors(spark, sf_dir).search(_asked(), top_k=3, offset=1, group_by="label", group_size=2)
    return found.select("id", "group_rank", "hit_rank", F.round("score", 6).alias("score"))


_MANY = " UNION ALL ".join(f"SELECT {i} AS query, {_list(_asked(i))} AS q" for i in range(20))


@query(f"""SELECT query::INT AS query, rank::INT AS rank, id, round(s, 6) AS score FROM (
SELECT query, id, list_inner_product(v, q) AS s, row_number() OVER (PARTITION BY query ORDER BY list_inner_product(v, q) DESC, id) AS rank FROM {_VEC}, ({_MANY})) WHERE rank <= 10""")
def batch_search(spark, sf_dir):
    found = _vectors(spark, sf_dir, "dot").batch_search([_asked(i) for i in range(20)], 10)
    return found.select("query", "rank", "id", F.round("score", 6).alias("score"))


_BITS = lambda v: f"list_transform({v}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_HAM = f"list_sum(list_transform(list_zip({_BITS('v')}, {_BITS(Q0)}), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))"


@query(f"SELECT id, round({_COS}, 6) AS score FROM (SELECT id, v FROM {_VEC} ORDER BY {_HAM}, id LIMIT 40) ORDER BY {_COS} DESC, id LIMIT 10")
def binary_rescore_topk(spark, sf_dir):
    return _scores(_vectors(spark, sf_dir, index=M.IndexConfig(quantization="binary")).search(_asked(), top_k=10))


@query(f"""WITH a AS (SELECT id FROM (SELECT id, v FROM {_VEC} ORDER BY {_HAM}, id LIMIT 100) ORDER BY {_COS} DESC, id LIMIT 10), e AS (SELECT id FROM {_VEC} ORDER BY {_COS} DESC, id LIMIT 10)
SELECT round(count(a.id) / count(e.id), 6) AS recall FROM e LEFT JOIN a ON a.id = e.id""")
def recall_binary(spark, sf_dir):
    exact = _vectors(spark, sf_dir).search(_asked(), top_k=10).withColumn("query", F.lit(0))
    found = _vectors(spark, sf_dir, index=M.IndexConfig(quantization="binary", oversampling=10)).search(_asked(), top_k=10).withColumn("query", F.lit(0))
    return recall(found, exact).select(F.round("recall", 6).alias("recall"))


@query()
def recall_pq(spark, sf_dir):
    plain = _vectors(spark, sf_dir)
    book = quantized.train_codebook(plain.records, 8, "cosine")
    exact = plain.search(_asked(), top_k=10).withColumn("query", F.lit(0))
    found = _vectors(spark, sf_dir, index=M.IndexConfig(quantization="pq", oversampling=20), codebook=book).search(_asked(), top_k=10).withColumn("query", F.lit(0))
    return recall(found, exact)


_SCALE = "(list_max(list_transform(v, lambda x: abs(x))) / 127)"
_CODES = "list_transform(v, lambda x: sign(x) * floor(abs(x / sc) + 0.5))"
_QS = max(abs(x) for x in _asked()) / 127
_QC = _list([math.copysign(math.floor(abs(x / _QS) + 0.5), x) for x in _asked()])


@query(f"""SELECT id, round(list_inner_product(c, {_QC}) * sc * {_QS!r}, 6) AS score FROM (SELECT id, sc, {_CODES} AS c FROM (SELECT id, v, {_SCALE} AS sc FROM {_VEC}))
ORDER BY list_inner_product(c, {_QC}) * sc * {_QS!r} DESC, id LIMIT 10""")
def int8_topk(spark, sf_dir):
    return _scores(quantized.int8_scores(_vectors(spark, sf_dir).records, _asked()).orderBy(F.desc("score"), "id").limit(10))


@query()
def ann_graph_topk(spark, sf_dir):
    c = _vectors(spark, sf_dir)
    index = graph.build(c.records, "cosine", M.IndexConfig("hnsw"))
    return graph.search(index, "cosine", [("0", _asked()), ("1", _asked(1))], 10, 128)


@query()
def ann_flat_graph_topk(spark, sf_dir):
    c = _vectors(spark, sf_dir)
    index = graph.build(c.records, "cosine", M.IndexConfig("diskann", max_degree=24, ef_construction=48), block=1024)
    return graph.search(index, "cosine", [("0", _asked()), ("1", _asked(1))], 10, 100)


def _lists(spark, sf_dir) -> DataFrame:
    """Four neighbouring vectors as one multi-vector record."""
    e = _table(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 4))
    rolled = e.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("mvec_parts"))
    first = F.get("mvec_parts", F.lit(0))
    return rolled.select(F.lit("").alias("namespace"), F.col("block").cast("string").alias("id"), first.alias("vector"), first.alias("vec_title"), "mvec_parts", F.map_from_entries(F.array().cast(f"array<struct<k:string,v:{imports.CELL}>>")).alias("metadata"), F.lit(None).cast("string").alias("payload"), F.concat(F.lit("block "), F.col("block").cast("string")).alias("text"))


_SPEC = {"parts": M.VectorField(DIM, "dot", multi_vector=True), "title": M.VectorField(DIM, "l2")}


def _multi(spark, sf_dir) -> Collection:
    return Collection(M.CollectionConfig("lists", DIM, vectors=_SPEC), _lists(spark, sf_dir))


_ROLLED = "(SELECT (vec_id // 4)::VARCHAR AS id, list(embedding::DOUBLE[] ORDER BY vec_id) AS vs FROM embeddings GROUP BY vec_id // 4)"
_POOL = "list_transform(range(1, 65), lambda i: list_sum(list_transform(vs, lambda v: v[i])) / len(vs))"
_SIM = lambda q: f"list_max(list_transform(vs, lambda v: list_inner_product(v, {_list(q)})))"
_TWO = f"({_SIM(_asked())} + {_SIM(_asked(1))})"
_MEANQ = _list([(a + b) / 2 for a, b in zip(_asked(), _asked(1))])


@query(f"SELECT id, round(s, 6) AS score FROM (SELECT id, list_inner_product({_POOL}, {Q0}) AS s FROM {_ROLLED}) ORDER BY s DESC, id LIMIT 10")
def mean_pool(spark, sf_dir):
    return _scores(_multi(spark, sf_dir).search(_asked(), top_k=10, using="parts"))


@query(f"SELECT id, round(-(list_distance(vs[1], {Q0}) ** 2), 6) AS score FROM {_ROLLED} ORDER BY list_distance(vs[1], {Q0}), id LIMIT 10")
def named_field_topk(spark, sf_dir):
    return _scores(_multi(spark, sf_dir).search(_asked(), top_k=10, using="title"))


@query(f"""WITH c AS (SELECT id, vs, list_inner_product({_POOL}, {_MEANQ}) AS p FROM {_ROLLED} ORDER BY p DESC, id LIMIT 100)
SELECT id, round({_TWO}, 6) AS score FROM c ORDER BY {_TWO} DESC, id LIMIT 10""")
def maxsim_topk(spark, sf_dir):
    return _scores(_multi(spark, sf_dir).search(top_k=10, using="parts", multi_vector=[_asked(), _asked(1)]))


@query(f"""WITH c AS (SELECT id, vs, list_cosine_similarity(vs[1], {Q0}) AS p FROM {_ROLLED} ORDER BY p DESC, id LIMIT 50)
SELECT id, round({_TWO}, 6) AS score FROM c ORDER BY {_TWO} DESC, id LIMIT 10""")
def maxsim_rerank(spark, sf_dir):
    return _scores(_multi(spark, sf_dir).search(_asked(), top_k=10, rerank=Rerank("maxsim", field="parts", multi_vector=[_asked(), _asked(1)])))


@query(f"""SELECT round(avg(list_inner_product(v, {Q0})), 6) AS dot, round(avg(-(list_distance(v, {Q0}) ** 2)), 6) AS l2, round(avg({_COS}), 6) AS cosine,
round(avg(({_COS} + 1) / 2), 6) AS n_cosine, round(avg(1 / (1 + list_distance(v, {Q0}) ** 2)), 6) AS n_l2, round(avg(1 / (1 + exp(-list_inner_product(v, {Q0})))), 6) AS n_dot,
round(avg(sqrt({_NORM})), 6) AS norm FROM {_VEC}""")
def vector_functions(spark, sf_dir):
    v, q = F.col("vector"), V.literal(_asked())
    row = {"dot": V.dot(v, q), "l2": V.l2(v, q), "cosine": V.cosine(v, q), "n_cosine": V.normalized_score("cosine", V.cosine(v, q)), "n_l2": V.normalized_score("l2", V.l2(v, q)), "n_dot": V.normalized_score("dot", V.dot(v, q)), "norm": F.sqrt(V.squared_norm(v))}
    return _vectors(spark, sf_dir).records.select(*[c.alias(n) for n, c in row.items()]).agg(*[F.round(F.avg(n), 6).alias(n) for n in row])


@query(f"""WITH e AS (SELECT unnest(v) AS x, (generate_subscripts(v, 1) - 1)::INT AS place FROM {_VEC}), r AS (SELECT place, min(x) AS low, (max(x) - min(x)) / 255 AS step FROM e GROUP BY place)
SELECT place, round(any_value(low), 6) AS low, round(any_value(step), 9) AS step, sum(CASE WHEN step = 0 THEN 0 ELSE round((x - low) / step) END)::BIGINT AS codes FROM e JOIN r USING (place) GROUP BY place""")
def component_ranges(spark, sf_dir):
    """Ranges of the components, and the sums of all vectors' codes by these."""
    rows = _vectors(spark, sf_dir).records
    ranges = quantized.component_ranges(rows)
    each = quantized.with_component_codes(rows, ranges).select(F.posexplode("codes").alias("at", "code")).groupBy("at").agg(F.sum("code").alias("codes"))
    return each.join(ranges, "at").select(F.col("at").alias("place"), F.round("low", 6).alias("low"), F.round("step", 9).alias("step"), "codes")


# ---- filters


def _events(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    even = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2 == 0)
    return e.withColumn("flag", even).withColumn("metadata", filters.metadata_map({"event_type": "event_type", "value": "value", "k": "k", "flag": "flag"}, {"event_type": "s", "value": "d", "k": "d", "flag": "b"}))


_EV = "(SELECT *, (props->>'$.k')::DOUBLE AS k, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS flag FROM events)"


def _counted(rows: DataFrame, cases: dict[str, dict]) -> DataFrame:
    """(filter, n, ids): how many rows each filter keeps, in one pass."""
    kept = {n: filters.where(f) for n, f in cases.items()}
    flagged = rows.select("event_id", *[c.alias(n) for n, c in kept.items()])
    sums = flagged.agg(*[F.struct(F.lit(n).alias("filter"), F.count_if(F.col(n)).alias("n"), F.coalesce(F.sum(F.when(F.col(n), F.col("event_id"))), F.lit(0)).alias("ids")).alias(n) for n in cases])
    return sums.select(F.explode(F.array(*cases)).alias("r")).select("r.*")


def _counted_sql(cases: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n, coalesce(sum(event_id), 0)::BIGINT AS ids FROM {_EV} WHERE {c}" for n, c in cases.items())


@query(_counted_sql({"eq": "event_type = 'click'", "ne": "event_type <> 'click'", "in": "event_type IN ('click', 'view')", "nin": "event_type NOT IN ('click', 'view')", "bool": "coalesce(flag, false)", "number": "k = 7", "kinds": "k = 7 OR event_type = 'click'"}))
def filter_eq_ne_in_nin(spark, sf_dir):
    return _counted(_events(spark, sf_dir), {"eq": {"event_type": "click"}, "ne": {"event_type": {"$ne": "click"}}, "in": {"event_type": {"$in": ["click", "view"]}}, "nin": {"event_type": {"$nin": ["click", "view"]}}, "bool": {"flag": True}, "number": {"k": 7.0}, "kinds": {"$or": [{"k": {"$in": ["7", 7]}}, {"event_type": {"$in": [None, "click", 1]}}]}})


@query(_counted_sql({"range": "value >= 20 AND value < 60", "text": "event_type > 'd'", "json": "k >= 60", "none": "false", "mixed": "k > 10 AND k <= 20 AND value > 50"}))
def filter_range(spark, sf_dir):
    return _counted(_events(spark, sf_dir), {"range": {"value": {"$gte": 20, "$lt": 60}}, "text": {"event_type": {"$gt": "d"}}, "json": {"k": {"$gte": 60}}, "none": {"value": {"$gt": True}}, "mixed": {"k": {"$gt": 10, "$lte": 20}, "value": {"$gt": 50}}})


@query(_counted_sql({"exists": "flag IS NOT NULL", "absent": "flag IS NULL", "not": "flag IS NULL OR NOT flag", "null": "false", "not_ne": "flag IS NULL OR flag", "empty": "true", "not_empty": "false"}))
def filter_exists_not(spark, sf_dir):
    return _counted(_events(spark, sf_dir), {"exists": {"flag": {"$exists": True}}, "absent": {"flag": {"$exists": False}}, "not": {"$not": {"flag": True}}, "null": {"flag": None}, "not_ne": {"$not": {"flag": {"$ne": True}}}, "empty": {}, "not_empty": {"$not": {}}})


@query(_counted_sql({"and": "event_type = 'click' AND value > 50", "or": "event_type = 'click' OR k < 5", "nested": "(event_type = 'click' OR NOT (k >= 50)) AND value <= 90"}))
def filter_and_or(spark, sf_dir):
    return _counted(_events(spark, sf_dir), {"and": {"$and": [{"event_type": "click"}, {"value": {"$gt": 50}}]}, "or": {"$or": [{"event_type": "click"}, {"k": {"$lt": 5}}]}, "nested": {"$and": [{"$or": [{"event_type": "click"}, {"$not": {"k": {"$gte": 50}}}]}, {"value": {"$lte": 90}}]}})


_WORDS = "regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{Nd}}]+')"


@query(f"""SELECT p_partkey, p_name FROM part WHERE list_contains({_WORDS.format('p_name')}, 'red') UNION ALL
SELECT doc_id AS p_partkey, lang AS p_name FROM documents WHERE list_has_all({_WORDS.format('text')}, ['the', 'of', 'thing'])""")
def filter_text_words(spark, sf_dir):
    p = _table(spark, sf_dir, "part").where(filters.where({"name": {"$text": "RED!"}}, filters.NativeColumns({"name": ("p_name", "s")})))
    d = _table(spark, sf_dir, "documents").where(filters.where({"body": {"$text": "the of, Thing"}}, filters.NativeColumns({"body": ("text", "s")})))
    return p.select("p_partkey", "p_name").unionAll(d.select("doc_id", "lang"))


_GEO = "(SELECT c_custkey, (c_custkey % 180 - 90)::DOUBLE AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon FROM customer)"
_FAR = lambda la, lo: f"2 * 6371008.8 * asin(least(1, sqrt(sin(radians(lat - {la}) / 2) ** 2 + cos(radians(lat)) * cos(radians({la})) * sin(radians(lon - {lo}) / 2) ** 2)))"


@query(" UNION ALL ".join(f"SELECT '{n}' AS place, c_custkey, round({_FAR(la, lo)}, 3) AS meters FROM {_GEO} WHERE {_FAR(la, lo)} <= {m}" for n, la, lo, m in (("paris", 48.8566, 2.3522, 900000), ("antimeridian", -16.5, 179.95, 800000), ("pole", 89.99, 10, 700000))))
def filter_geo_radius(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 180 - 90).cast("double").alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).cast("double").alias("lon"))
    fields, out = filters.NativeColumns({"lat": ("lat", "d"), "lon": ("lon", "d")}), None
    for n, la, lo, m in (("paris", 48.8566, 2.3522, 900000), ("antimeridian", -16.5, 179.95, 800000), ("pole", 89.99, 10, 700000)):
        near = c.where(filters.where({"$geo_radius": {"lat": la, "lon": lo, "meters": m}}, fields))
        near = near.select(F.lit(n).alias("place"), "c_custkey", F.round(filters.haversine(F.col("lat"), F.col("lon"), la, lo), 3).alias("meters"))
        out = near if out is None else out.unionAll(near)
    return out


# ---- scans


@query("SELECT o_orderstatus AS namespace, o_orderkey::VARCHAR AS id, o_totalprice FROM orders WHERE (o_orderstatus, o_orderkey::VARCHAR) > ('F', '3') ORDER BY 1, 2 LIMIT 50")
def keyset_scroll(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").cast("string").alias("id"), "o_totalprice")
    return Collection(M.CollectionConfig("orders", 1), o).scroll(50, after=("F", "3"), include_vector=True)


@query("SELECT o_orderstatus AS namespace, o_orderkey::VARCHAR AS id, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 1")
def point_get(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").cast("string").alias("id"), "o_custkey")
    found = Collection(M.CollectionConfig("orders", 1), o)
    key = o.where("namespace = 'O'").agg(F.max_by("id", F.col("id").cast("long"))).first()[0]
    return found.get(key, "O")


# ---- text


def _documents(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    dense = F.array((F.col("n_chars") % 97 / 97).cast("float"), (F.col("doc_id") % 13 / 13).cast("float"), (F.col("doc_id") % 7 / 7 + 0.1).cast("float"))
    sparse = F.map_from_arrays(F.array(*[F.lit(x) for x in ("a", "b", "c")]), F.array(*[((F.col("doc_id") % m) + 0.0).cast("float") for m in (3, 5, 11)]))
    meta = filters.metadata_map({"lang": "lang", "n_chars": "n_chars"}, {"lang": "s", "n_chars": "d"})
    return d.select(F.lit("").alias("namespace"), F.col("doc_id").cast("string").alias("id"), dense.alias("vector"), sparse.alias("sparse_vector"), "text", meta.alias("metadata"), F.lit(None).cast("string").alias("payload"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOK = f"list_filter({_WORDS.format('text')}, lambda x: x <> '' AND x NOT IN ({_STOP}))"
_DOCS = f"(SELECT doc_id::VARCHAR AS id, lang, n_chars, doc_id, {_TOK} AS t FROM documents)"
_TERMS = ("thing", "ing", "tion", "edthe")
_TEXT = "The thing, ing of tion? Thing edthe"
_BM = f"""d AS (SELECT *, len(t) AS dl FROM {_DOCS} WHERE len(t) > 0), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d),
q AS (SELECT unnest({list(_TERMS)}) AS w), df AS (SELECT w, count(*)::DOUBLE AS df FROM q, d WHERE list_contains(t, w) GROUP BY w),
bm AS (SELECT d.id, sum(ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
FROM (SELECT d.id, dl, w, len(list_filter(t, lambda x: x = w)) AS tf FROM d, q WHERE list_contains(t, w)) d JOIN df USING (w), s GROUP BY d.id)"""


@query(f"SELECT count(*) AS docs, sum(len(t))::BIGINT AS tokens, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM {_DOCS})) AS terms FROM {_DOCS} WHERE len(t) > 0")
def tokenize_counts(spark, sf_dir):
    t = lexical.tokenized(_documents(spark, sf_dir))
    each = t.select("length", F.explode("tokens").alias("w"))
    return t.agg(F.count("*").alias("docs"), F.sum("length").alias("tokens")).crossJoin(each.agg(F.countDistinct("w").alias("terms")))


@query(f"WITH {_BM} SELECT id, round(score, 4) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def bm25_topk(spark, sf_dir):
    found = lexical.bm25(_documents(spark, sf_dir), _TEXT)
    return found.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 4).alias("score"))


@query(f"WITH {_BM} SELECT id, round(score, 4) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def bm25_postings_topk(spark, sf_dir):
    found = lexical.bm25_from_postings(lexical.postings(_documents(spark, sf_dir)), _TEXT)
    return found.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 4).alias("score"))


@query("""WITH o AS (SELECT l_orderkey, map_from_entries(list((l_partkey % 50, q))) AS m FROM (SELECT l_orderkey, l_partkey % 50 AS l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey),
s AS (SELECT l_orderkey, coalesce(m[3], 0) * 2 + coalesce(m[7], 0) + coalesce(m[11], 0) * 0.5 AS dot, sqrt(list_sum(list_transform(map_values(m), lambda x: x * x))) AS norm FROM o)
SELECT l_orderkey::VARCHAR AS id, round(dot / (norm * sqrt(5.25)), 6) AS score FROM s WHERE dot > 0 ORDER BY dot / (norm * sqrt(5.25)) DESC, id LIMIT 10""")
def sparse_cosine_topk(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 50).cast("string").alias("part")).agg(F.sum("l_quantity").alias("q"))
    o = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("part", "q"))).alias("sparse_vector"))
    rows = o.select(F.lit("").alias("namespace"), F.col("l_orderkey").cast("string").alias("id"), "sparse_vector")
    return _scores(lexical.sparse(rows, {"3": 2.0, "7": 1.0, "11": 0.5}).orderBy(F.desc("score"), "id").limit(10))


_HV = "[(n_chars % 97 / 97)::FLOAT, (doc_id % 13 / 13)::FLOAT, (doc_id % 7 / 7 + 0.1)::FLOAT]::DOUBLE[]"
_HQ = "[0.3, 0.6, 0.2]::DOUBLE[]"
_HS = "(doc_id % 3 * 1.0 + doc_id % 11 * 2.0) / (sqrt((doc_id % 3) ** 2 + (doc_id % 5) ** 2 + (doc_id % 11) ** 2) * sqrt(5.0))"
_SIG = f"""{_BM}, b AS (SELECT doc_id::VARCHAR AS id, list_cosine_similarity({_HV}, {_HQ}) AS dense, CASE WHEN doc_id % 3 <> 0 OR doc_id % 11 <> 0 THEN {_HS} END AS sparse FROM documents),
k1 AS (SELECT id, row_number() OVER (ORDER BY dense DESC, id) AS r FROM b QUALIFY r <= 100),
k2 AS (SELECT id, row_number() OVER (ORDER BY sparse DESC, id) AS r FROM b WHERE sparse IS NOT NULL QUALIFY r <= 100),
k3 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 100)"""


def _hybrid(spark, sf_dir, fusion: str) -> DataFrame:
    c = Collection(M.CollectionConfig("documents", 3), _documents(spark, sf_dir))
    return _scores(c.search([0.3, 0.6, 0.2], top_k=10, sparse_vector={"a": 1.0, "c": 2.0}, text=_TEXT, alpha=0.4, fusion=fusion))


@query(f"""WITH {_SIG}, k AS (SELECT id FROM k1 UNION SELECT id FROM k2 UNION SELECT id FROM k3),
f AS (SELECT k.id, 0.4 * (b.dense + 1) / 2 + 0.6 * ((coalesce(b.sparse, 0) + 1) / 2 + coalesce(bm.score, 0) / (coalesce(bm.score, 0) + 2)) / 2 AS s FROM k JOIN b USING (id) LEFT JOIN bm USING (id))
SELECT id, round(s, 6) AS score FROM f ORDER BY s DESC, id LIMIT 10""")
def hybrid_weighted(spark, sf_dir):
    return _hybrid(spark, sf_dir, "weighted")


@query(f"""WITH {_SIG}, f AS (SELECT id, sum(1.0 / (60 + r)) AS s FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3) GROUP BY id)
SELECT id, round(s, 6) AS score FROM f ORDER BY round(s, 12) DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rrf")


@query("""WITH p AS (SELECT url AS path, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, html AS body FROM pages),
c AS (SELECT path, (length(lower(title)) - length(replace(lower(title), 'the', ''))) // 3 AS t1, (length(lower(body)) - length(replace(lower(body), 'the', ''))) // 3 AS b1,
(length(lower(title)) - length(replace(lower(title), 'ing', ''))) // 3 AS t2, (length(lower(body)) - length(replace(lower(body), 'ing', ''))) // 3 AS b2 FROM p)
SELECT path, (t1 * 5 + least(b1, 20) + t2 * 5 + least(b2, 20))::INT AS score FROM c WHERE t1 + b1 > 0 AND t2 + b2 > 0 ORDER BY score DESC, path LIMIT 20""")
def doc_site_search(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("body"))
    return lexical.site_search(p, "The, ing").select("path", "score")


class _Length:
    max_documents = 200

    def score(self, query: str, documents: list[str]) -> list[float]:
        return [float(len(d)) for d in documents]


class _Broken:
    max_documents = 200

    def score(self, query, documents):
        raise TimeoutError


@query(f"SELECT id, round({_COS}, 6) AS score FROM {_VEC} ORDER BY {_COS} DESC, id LIMIT 10")
def cross_encoder_fallback(spark, sf_dir):
    """A reranker that fails leaves the first stage's order."""
    c = _vectors(spark, sf_dir)
    c.records = c.records.withColumn("text", F.concat(F.lit("vector "), F.col("id")))
    return _scores(c.search(_asked(), top_k=10, rerank=Rerank("cross_encoder", reranker=_Broken(), query="x")))


@query(f"""WITH {_BM} SELECT bm.id, round(score, 6) AS score FROM bm JOIN d USING (id) WHERE d.lang = 'en' AND d.n_chars >= 400 ORDER BY score DESC, bm.id LIMIT 10""")
def bm25_namespace_filter(spark, sf_dir):
    """One language is a namespace, and a filter holds; the statistics are those of all documents."""
    rows = _documents(spark, sf_dir).withColumn("namespace", F.col("metadata")["lang"]["s"])
    return _scores(Collection(M.CollectionConfig("documents", 3), rows).search(text=_TEXT, top_k=10, namespace="en", filter={"n_chars": {"$gte": 400}}))


@query(f"""WITH {_BM} SELECT bm.id, round(score, 6) AS score FROM bm JOIN d USING (id) WHERE d.lang = 'de' ORDER BY score DESC, bm.id LIMIT 10""")
def bm25_stored_index(spark, sf_dir):
    """The same from an inverted index that the store keeps."""
    s = store.Store(spark, _temporary(spark))
    s.create(M.CollectionConfig("documents", 3))
    s.load("documents", _documents(spark, sf_dir).withColumn("namespace", F.col("metadata")["lang"]["s"]))
    s.index_text("documents")
    return _scores(s.open("documents").search(text=_TEXT, top_k=10, namespace="de"))


@query("""SELECT id, n::DOUBLE AS score FROM (SELECT (vec_id // 4)::VARCHAR AS id, max(length('block ' || (vec_id // 4)::VARCHAR)) AS n,
list_cosine_similarity(min_by(embedding, vec_id)::DOUBLE[], """ + Q0 + """) AS s FROM embeddings GROUP BY vec_id // 4 ORDER BY s DESC, id LIMIT 50) ORDER BY n DESC, s DESC, id LIMIT 10""")
def cross_encoder_rerank(spark, sf_dir):
    return _scores(_multi(spark, sf_dir).search(_asked(), top_k=10, rerank=Rerank("cross_encoder", reranker=_Length(), query="x")))


# ---- log, memory, control plane


def _log(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("lsn"), F.when(F.col("event_id") % 9 == 4, "delete").otherwise("upsert").alias("op"), F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("id"), "value")


_LOG = "(SELECT event_id AS lsn, CASE WHEN event_id % 9 = 4 THEN 'delete' ELSE 'upsert' END AS op, event_type AS namespace, user_id::VARCHAR AS id, value FROM events)"
_LAST = f"SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY lsn DESC) AS rn FROM {_LOG}"


@query(f"SELECT namespace, id, lsn, value FROM ({_LAST}) WHERE rn = 1 AND op <> 'delete'")
def lww_resolve(spark, sf_dir):
    return store.resolved(_log(spark, sf_dir)).select("namespace", "id", "lsn", "value")


@query(f"SELECT namespace, id, lsn, value FROM ({_LAST}) WHERE rn = 1 AND op <> 'delete'")
def checkpoint_delta(spark, sf_dir):
    """A base up to the middle of the log, and the rest on top of it."""
    log = _log(spark, sf_dir)
    half = log.agg((F.max("lsn") / 2).cast("long")).first()[0] or 0
    base = store.resolved(log.where(F.col("lsn") <= half)).drop("op")
    later = log.where(F.col("lsn") > half)
    latest = later.withColumn("n", F.row_number().over(Window.partitionBy("namespace", "id").orderBy(F.desc("lsn")))).where("n = 1").drop("n")
    return store.shadowed(base, latest).select("namespace", "id", "lsn", "value")


@query("SELECT '' AS namespace, c_custkey::VARCHAR AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def tombstone_antijoin(spark, sf_dir):
    """A base without the keys that a delta deletes."""
    base = _table(spark, sf_dir, "customer").select(F.lit("").alias("namespace"), F.col("c_custkey").cast("string").alias("id"), "c_name")
    dead = _table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit("").alias("namespace"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("c_name"), F.lit("delete").alias("op"))
    return store.shadowed(base, dead)


def _customers(spark, sf_dir) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("namespace"), F.col("c_custkey").cast("string").alias("id"), F.array(F.col("c_acctbal").cast("float")).alias("vector"))


_KEPT = "SELECT c_mktsegment AS namespace, c_custkey::VARCHAR AS id, round((CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END * c_acctbal::FLOAT)::DOUBLE, 2) AS value FROM customer WHERE c_custkey % 7 <> 0"


def _stored(spark, sf_dir) -> store.Store:
    """Customers loaded, a third of them replaced after a checkpoint, and a seventh deleted."""
    s, rows = store.Store(spark, _temporary(spark)), _customers(spark, sf_dir)
    s.create(M.CollectionConfig("customers", 1, "dot"))
    s.load("customers", rows)
    s.checkpoint("customers")
    s.load("customers", rows.where("id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    s.delete_keys("customers", rows.where("id % 7 = 0"))
    return s


@query(_KEPT)
def store_lifecycle(spark, sf_dir):
    """The live view of a base with later batches, after a checkpoint and a clean-up of what nothing names."""
    s = _stored(spark, sf_dir)
    s.checkpoint("customers")
    s.clean("customers")
    return s.records("customers").select("namespace", "id", F.round(F.col("vector")[0].cast("double"), 2).alias("value"))


@query("SELECT c_mktsegment AS namespace, c_custkey::VARCHAR AS id, round(c_acctbal::FLOAT::DOUBLE, 2) AS value FROM customer")
def store_snapshot(spark, sf_dir):
    """A snapshot from before later batches, read after these, a checkpoint and a clean-up."""
    s, rows = store.Store(spark, _temporary(spark)), _customers(spark, sf_dir)
    s.create(M.CollectionConfig("customers", 1, "dot"))
    s.load("customers", rows)
    kept = s.snapshot("customers")
    s.delete_keys("customers", rows.where("id % 2 = 0"))
    s.checkpoint("customers")
    s.clean("customers")
    return s.open("customers", kept).records.select("namespace", "id", F.round(F.col("vector")[0].cast("double"), 2).alias("value"))


@query(f"SELECT namespace, id FROM ({_KEPT}) ORDER BY 1, 2 LIMIT 300")
def store_scroll(spark, sf_dir):
    """Three pages by cursor (a page is the feature)."""
    s, found, cursor = _stored(spark, sf_dir), [], ""
    for _ in range(3):
        page, cursor = s.scroll("customers", 100, cursor=cursor)
        found += [(r["namespace"], r["id"]) for r in page]
        if not cursor:
            break
    return spark.createDataFrame(found, "namespace string, id string")


@query("""WITH e AS (SELECT (event_id % 4)::INTEGER AS shard, event_id // 4 + 1 AS lsn FROM events), r AS (SELECT * FROM e WHERE NOT (shard = 3 AND lsn = 50)),
l AS (SELECT shard, coalesce(max(lsn) FILTER (WHERE lsn = nth), 0) AS last FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY lsn) AS nth FROM r) GROUP BY shard)
SELECT shard, outcome, count(*) AS n FROM (SELECT shard, CASE WHEN lsn > last THEN 'gap' ELSE 'applied' END AS outcome FROM r JOIN l USING (shard)
UNION ALL SELECT shard, CASE WHEN lsn > last THEN 'gap' WHEN lsn <= last - 1024 THEN 'compacted' ELSE 'duplicate' END FROM r JOIN l USING (shard) WHERE lsn % 10 = 0) GROUP BY shard, outcome""")
def ordered_apply_stream(spark, sf_dir):
    """Outcomes of a log with a hole, and of repeats that come after it, as a stream."""
    e = _table(spark, sf_dir, "events")
    rows = e.select((F.col("event_id") % 4).cast("int").alias("shard"), (F.floor(F.col("event_id") / 4) + 1).cast("long").alias("lsn"), F.col("event_type").alias("digest")).where("not (shard = 3 and lsn = 50)")
    root = _temporary(spark)
    for part in (rows, rows.where("lsn % 10 = 0")):
        part.write.mode("append").parquet(f"{root}/in")
        log = spark.readStream.schema("shard int, lsn long, digest string").parquet(f"{root}/in")
        changelog.ordered_apply(log).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("shard", "outcome").agg(F.count("*").alias("n"))


@query(f"SELECT namespace, id, lsn FROM ({_LAST}) WHERE rn = 1 AND op <> 'delete'")
def lww_stream(spark, sf_dir):
    """The live view kept by a stream over log files, in two micro-batches; the second one brings older writes too."""
    root = _temporary(spark)
    log = _log(spark, sf_dir).withColumn("shard", F.lit(0)).withColumn("payload", F.col("value").cast("string"))
    for odd in (1, 0):
        log.where(F.col("lsn") % 2 == odd).select(*[f.name for f in changelog.LOG]).coalesce(1).write.mode("append").parquet(f"{root}/log")
        changelog.materialize(changelog.read(spark, f"{root}/log"), f"{root}/view", f"{root}/state").awaitTermination()
    return changelog.live(spark, f"{root}/view", 1).select("namespace", "id", "lsn")


_AGE = f"({NOW} - vec_id * 7919 % 2000000)"
_MIXED = f"0.8 * sim + 0.2 * pow(2, -greatest(0, ({NOW} - created) / 3600.0) / 168)"


@query(f"""WITH m AS (SELECT vec_id::VARCHAR AS id, {_AGE} AS created, list_cosine_similarity(embedding::DOUBLE[], {Q0}) AS sim FROM embeddings WHERE vec_id % 5 <> 0),
f AS (SELECT * FROM m ORDER BY sim DESC, id LIMIT 40) SELECT id, round({_MIXED}, 6) AS score FROM f ORDER BY {_MIXED} DESC, sim DESC, id LIMIT 10""")
def memory_recall(spark, sf_dir):
    """The nearest of those that have not expired, by similarity and recency."""
    e = _table(spark, sf_dir, "embeddings").withColumn("expires", F.when(F.col("vec_id") % 5 == 0, F.lit(float(NOW - 1))).otherwise(F.lit(float(memory.NEVER))))
    meta = filters.metadata_map({"expires_at": "expires", "created_at": "created"}, {"expires_at": "d", "created_at": "d"})
    rows = e.withColumn("created", (F.lit(NOW) - F.col("vec_id") * 7919 % 2000000).cast("double")).select(F.lit("").alias("namespace"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), meta.alias("metadata"), F.lit(None).cast("string").alias("payload"))
    hits = Collection(M.CollectionConfig("memories", DIM), rows).dense(_asked(), 40, filter={"expires_at": {"$gt": NOW}})
    return memory.ranked(hits.withColumn("created_at", F.col("metadata")["created_at"]["d"]), NOW, 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT user_id::VARCHAR AS user_id, count(*) AS live, (SELECT count(*) FROM events WHERE value <= 30) AS pruned FROM events WHERE value > 30 GROUP BY user_id")
def ttl_prune(spark, sf_dir):
    """Memories in a store, after those that have expired were deleted from it."""
    s = store.Store(spark, _temporary(spark))
    s.create(M.CollectionConfig("events", 1))
    meta = filters.metadata_map({"expires_at": "value"}, {"expires_at": "d"})
    e = _table(spark, sf_dir, "events")
    s.load("events", e.select(F.col("user_id").cast("string").alias("namespace"), F.col("event_id").cast("string").alias("id"), F.array(F.lit(1.0).cast("float")).alias("vector"), meta.alias("metadata")))
    gone = memory.Memory(s, "events", memory.HashEmbedder(1), lambda: 30).prune()
    return s.records("events").groupBy(F.col("namespace").alias("user_id")).agg(F.count("*").alias("live")).withColumn("pruned", F.lit(gone).cast("long"))


@query("SELECT DISTINCT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def namespace_listing(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = n.select(F.array("r_name", "n_name", F.lit("notes")).alias("path")).where(F.col("path")[0].isin("ASIA", "EUROPE"))
    found = memory.namespaces(items, matches=[(["*", "*"], False), (["notes"], True)], max_depth=2)
    return found.select(F.col("path")[0].alias("a"), F.col("path")[1].alias("b"))


def _cluster(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"), F.lit(1).alias("capacity"))
    r = _table(spark, sf_dir, "region").select(F.col("r_name").alias("collection"), F.lit(32).alias("shard_count"))
    return n, control.shard_rows(r)


_BID = "SELECT r_name AS collection, shard, n_name AS node, sha256(encode(r_name) || unhex('00') || unhex(printf('%08X', shard)) || encode(n_name)) AS s FROM region, (SELECT unnest(range(32)) AS shard), nation"


def _replicas_sql(where: str, name: str = "") -> str:
    return f"SELECT collection, shard::INT AS shard, rank::INT AS rank, node FROM (SELECT *, row_number() OVER (PARTITION BY collection, shard ORDER BY s DESC, node) AS rank FROM ({_BID} {name})) WHERE {where}"


@query(f"SELECT collection, shard, node FROM ({_replicas_sql('rank = 1')})")
def placement_rendezvous(spark, sf_dir):
    return control.replicas(*_cluster(spark, sf_dir)).select("collection", "shard", "node")


@query(_replicas_sql("rank <= 3"))
def replica_top_r(spark, sf_dir):
    return control.replicas(*_cluster(spark, sf_dir), 3)


@query(f"""WITH a AS (SELECT collection, shard, list(node ORDER BY rank) AS src FROM ({_replicas_sql('rank <= 2')}) GROUP BY ALL), b AS (SELECT collection, shard, list(node ORDER BY rank) AS dst FROM ({_replicas_sql('rank <= 2', "WHERE n_name <> 'NATION_3'")}) GROUP BY ALL)
SELECT collection, shard, src[1] AS source_leader, dst[1] AS target_leader, array_to_string(list_filter(dst, lambda x: NOT list_contains(src, x)), ',') AS added, array_to_string(list_filter(src, lambda x: NOT list_contains(dst, x)), ',') AS removed FROM a JOIN b USING (collection, shard) WHERE src <> dst""")
def rebalance_diff(spark, sf_dir):
    nodes, shards = _cluster(spark, sf_dir)
    moved = control.rebalance(control.replicas(nodes, shards, 2), control.replicas(nodes.where("node <> 'NATION_3'"), shards, 2))
    return moved.select("collection", "shard", "source_leader", "target_leader", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("SELECT * FROM (SELECT unnest([10.0, 50.0, 90.0])::DOUBLE AS le) e, LATERAL (SELECT count(*) AS count FROM events WHERE value <= e.le) UNION ALL SELECT NULL, count(*) FROM events")
def metrics_histogram(spark, sf_dir):
    return control.histogram(_table(spark, sf_dir, "events"), "value", [10, 50, 90])


@query("SELECT event_id AS sequence, event_type AS level FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 100")
def recent_logs(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.col("event_type").alias("level"))
    return control.recent_events(e, "click")


@query("SELECT (user_id % 3)::INT AS node, event_id AS sequence FROM events ORDER BY ts DESC, node, event_id DESC LIMIT 50")
def merged_logs(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("node"), "ts", F.col("event_id").alias("sequence"))
    return control.merged_events([e.where(F.col("node") == i) for i in range(3)], 50).select("node", "sequence")


@query("""WITH h AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS n FROM events GROUP BY 1), c AS (SELECT hour, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) % 1000 AS total FROM h),
d AS (SELECT *, total - lag(total) OVER (ORDER BY hour) AS grown, hour - lag(hour) OVER (ORDER BY hour) AS passed FROM c)
SELECT hour, total, round(CASE WHEN grown < 0 THEN 0.0 ELSE grown / passed END, 9) AS rate FROM d""")
def counter_rate_lag(spark, sf_dir):
    """Hourly totals of a counter that wraps at a thousand, and its rate."""
    h = _table(spark, sf_dir, "events").groupBy(F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour")).agg(F.count("*").alias("n"))
    c = h.select("hour", (F.sum("n").over(Window.orderBy("hour")) % 1000).alias("total"))  # one row an hour
    return control.rates(c, "hour", "total").withColumn("rate", F.round("rate", 9))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.99).alias("p99"))


# ---- imports


@query("SELECT p_partkey::VARCHAR AS id, p_size::DOUBLE AS size, p_brand AS brand, [p_size::FLOAT, p_retailprice::FLOAT]::FLOAT[] AS vector FROM part WHERE p_size <> 3")
def csv_import_typed_metadata(spark, sf_dir):
    """Parts as CSV and back: columns become typed metadata, rows without a sound vector are rejected."""
    path = f"{_temporary(spark)}/parts"
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ID"), F.when(F.col("p_size") == 3, "1").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(";"), F.col("p_retailprice").cast("string"))).alias("Vector"), F.col("p_size").alias("size"), F.col("p_brand").alias("Brand"))
    p.write.csv(path, header=True, quote='"', escape='"')
    good, _ = imports.validated(imports.read_csv(spark, path), 2)
    return good.select("id", F.col("metadata")["size"]["d"].alias("size"), F.col("metadata")["brand"]["s"].alias("brand"), "vector")


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'expected 2 dimensions' WHEN c_custkey % 10 = 1 THEN 'neither vector nor text' ELSE 'valid' END AS reason, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY 1")
def jsonl_import_validate(spark, sf_dir):
    """Customers as JSON lines and back, with faults."""
    path = f"{_temporary(spark)}/customers"
    k = F.col("c_custkey") % 10
    vector = F.when(k == 0, F.array(F.lit(1.0))).when(k != 1, F.array(F.col("c_acctbal"), F.lit(0.5)))
    _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), vector.alias("vector"), F.struct("c_mktsegment", "c_acctbal").alias("metadata")).write.json(path)
    good, bad = imports.validated(imports.read_json_lines(spark, path), 2)
    both = good.withColumn("reason", F.lit("valid")).unionByName(bad)
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct(F.col("metadata")["c_mktsegment"]["s"]).alias("kinds"))


@query()
def synthetic_vectors(spark, sf_dir):
    return imports.synthetic(spark, 500, 16).select("id", F.size("vector").alias("size"))
