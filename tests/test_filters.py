"""The predicate language against a plain evaluator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.text import query_words
from orrery.model import METADATA, InvalidArgument
from orrery.operators import filters

BOATS = [
    (10, {"hull": "steel", "length": 31.5, "crew": 4, "sold": False}),
    (11, {"hull": "oak", "length": 9, "sold": True}),
    (12, {"hull": "steel", "length": 9.0, "crew": None}),
    (13, {"length": "9", "crew": 2}),
    (14, {}),
    (15, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, filters.metadata_of(m)) for i, m in rows], f"id int, metadata {METADATA.simpleString()}")


def kept(df, f):
    return sorted(r["id"] for r in df.where(filters.where(f)).select("id").collect())


FILTERS = [
    None,
    {},
    {"$not": {}},
    {"hull": "steel"},
    {"length": 9},
    {"length": "9"},
    {"crew": None},
    {"length": {"$gt": 8.5, "$lte": 9}},
    {"length": {"$gt": "8"}},
    {"length": {"$lt": True}},
    {"sold": {"$gte": False}},
    {"crew": {"$lt": None}},
    {"hull": {"$ne": "oak"}},
    {"crew": {"$ne": None}},
    {"hull": {"$in": ["oak", 9, None]}},
    {"length": {"$nin": [9, "nine"]}},
    {"crew": {"$exists": True}},
    {"crew": {"$exists": False}, "length": 9},
    {"$or": [{"sold": True}, {"crew": {"$gte": 3}}]},
    {"$and": [{"hull": {"$exists": True}}, {"$not": {"length": {"$lt": 10}}}]},
    {"$not": {"$or": [{"hull": "oak"}, {"length": "9"}]}},
]


@pytest.mark.parametrize("f", FILTERS, ids=str)
def test_boats(spark, f):
    """Each filter keeps the rows that a plain evaluator keeps."""
    assert kept(frame(spark, BOATS), f) == [i for i, row in BOATS if holds(filters.parse(f), row)]


def test_boats_by_hand(spark):
    for f, ids in (({"length": 9}, [11, 12]), ({"crew": None}, [12]), ({"hull": {"$ne": "oak"}}, [10, 12]), ({"$not": {"hull": "oak"}}, [10, 12, 13, 14, 15]), ({"length": {"$gt": "8"}}, [13])):
        assert kept(frame(spark, BOATS), f) == ids


def test_null_and_nested_values(spark):
    df = frame(spark, [(1, {"a": None}), (2, {"a": [1]}), (3, {}), (4, {"a": 1})])
    assert kept(df, {"a": None}) == [1]
    assert kept(df, {"a": {"$exists": True}}) == [1, 4]
    assert kept(df, {"a": {"$ne": 2}}) == [1, 4]
    assert kept(df, {"a": {"$in": [None, 1]}}) == [1, 4]
    assert kept(df, {"$not": {"a": 1}}) == [1, 2, 3]


def test_whole_words(spark):
    notes = [(1, {"note": "Mast re-rigged; sails: TWO new!"}), (2, {"note": "new mast"}), (3, {"note": 2}), (4, {"log": "mast"}), (5, {"note": "masts"})]
    df = frame(spark, notes)
    for words in ("mast", "NEW mast", "two, sails", "re rigged", "sail", "mast keel"):
        f = {"note": {"$text": words}}
        assert kept(df, f) == [i for i, row in notes if holds(filters.parse(f), row)]
    assert kept(df, {"note": {"$text": "NEW mast"}}) == [1, 2] and kept(df, {"$not": {"note": {"$text": "mast"}}}) == [3, 4, 5]


def metres(a, b):
    """Great-circle distance, by the angle between unit vectors."""
    (x, y), (u, v) = ((math.radians(p), math.radians(q)) for p, q in (a, b))
    dots = math.sin(x) * math.sin(u) + math.cos(x) * math.cos(u) * math.cos(y - v)
    return filters.EARTH_RADIUS * math.acos(max(-1.0, min(1.0, dots)))


def test_geo_radius(spark):
    r = random.Random(3)
    centres = [(53.55, 9.99), (-36.85, 179.95), (89.97, -120.0), (0.0, 0.0)]
    places = [(i, max(-90.0, min(90.0, c[0] + r.uniform(-1, 1) * k)), (c[1] + r.uniform(-1, 1) * k + 180) % 360 - 180) for i, (c, k) in enumerate((c, k) for c in centres for k in (0.01, 0.2, 3.0) for _ in range(12))]
    df = frame(spark, [*[(i, {"lat": a, "lon": b}) for i, a, b in places], (900, {"lat": 53.55}), (901, {"up": 53.55, "across": 9.99}), (902, {"lat": "53.55", "lon": 9.99})])
    for lat, lon in centres:
        for reach in (900, 20_000, 250_000):
            near = {"$geo_radius": {"lat": lat, "lon": lon, "meters": reach}}
            assert kept(df, near) == [i for i, a, b in places if metres((lat, lon), (a, b)) <= reach]
    own = {"$geo_radius": {"lat": 53.55, "lon": 9.99, "meters": 10, "lat_field": "up", "lon_field": "across"}}
    assert kept(df, own) == [901] and kept(df, {"across": {"$gt": 10}, **own}) == []


@pytest.mark.parametrize(
    "f",
    [
        {"$unknown": True}, {"year": {"$gte": [1]}}, {"kind": {"$in": []}}, {"$and": "x"}, {"$and": []}, {"score": float("inf")}, {"": 1}, {"a": {}}, {"a": {"$what": 1}},
        {"a": {"$exists": 1}}, {"a": {"$text": ""}}, {"a": {"$text": "  ,, "}}, {"a": {"$text": 7}}, {"a": {"$text": "x" * 1025}}, {"$not": 1}, {"$geo_radius": {"lat": 1}},
        {"$geo_radius": {"lat": 91, "lon": 0, "meters": 1}}, {"$geo_radius": {"lat": 1, "lon": 0, "meters": 0}}, {"$geo_radius": {"lat": 1, "lon": 0, "meters": 1, "x": 2}},
    ],
)
def test_rejected(f):
    with pytest.raises(InvalidArgument):
        filters.parse(f)


def holds(node, row):
    """A plain evaluator."""
    row = {k: v for k, v in (row or {}).items() if v is None or isinstance(v, (str, bool, int, float))}
    if node.op == "and":
        return all(holds(c, row) for c in node.children)
    if node.op == "or":
        return any(holds(c, row) for c in node.children)
    if node.op == "not":
        return not holds(node.children[0], row)
    there, x, v = node.field in row, row.get(node.field), node.value
    kind = lambda y: None if y is None else bool if isinstance(y, bool) else str if isinstance(y, str) else float
    same = lambda y: there and kind(x) == kind(y) and x == y
    if node.op == "$exists":
        return there == v
    if node.op in ("$eq", "$ne"):
        return same(v) if node.op == "$eq" else there and not same(v)
    if node.op in ("$in", "$nin"):
        return any(map(same, v)) if node.op == "$in" else there and not any(map(same, v))
    if node.op == "$text":
        return there and isinstance(x, str) and set(query_words(v)) <= set(query_words(x))
    if not there or kind(x) != kind(v) or kind(v) not in (str, float):
        return False
    return {"$gt": x > v, "$gte": x >= v, "$lt": x < v, "$lte": x <= v}[node.op]


def test_random_filters_match_the_evaluator(spark):
    r = random.Random(7)
    value = lambda: r.choice([None, True, False, 0, 1, 2, 1.0, "a", "b", "a b", [1]])
    rows = [(i, {k: value() for k in "xyz" if r.random() < 0.7}) for i in range(60)]
    scalar = lambda: r.choice([None, True, False, 0, 1, 2, "a", "b"])

    def make(depth):
        if depth and r.random() < 0.5:
            op = r.choice(["$and", "$or", "$not"])
            return {op: make(depth - 1)} if op == "$not" else {op: [make(depth - 1) for _ in range(r.randint(1, 3))]}
        op = r.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$text"])
        v = [scalar() for _ in range(2)] if op in ("$in", "$nin") else r.random() < 0.5 if op == "$exists" else r.choice("ab") if op == "$text" else scalar()
        return {r.choice("xyzw"): {op: v}}

    made = [make(2) for _ in range(60)]
    df = frame(spark, rows)
    got = df.select("id", *[filters.where(f).alias(f"f{i}") for i, f in enumerate(made)]).collect()
    metadata = dict(rows)
    for row in got:
        for i, f in enumerate(made):
            assert row[f"f{i}"] == holds(filters.parse(f), metadata[row["id"]]), (f, metadata[row["id"]])


def test_native_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.col("id").cast("double").alias("value")).write.parquet(path)
    df = spark.read.parquet(path).where(filters.where({"value": {"$gte": 50}}, filters.NativeColumns({"value": ("value", "d")}), exact=False))
    assert df.count() == 50
    assert "GreaterThanOrEqual(value,50.0)" in df._jdf.queryExecution().toString()
