"""Change log, imports, memory, control plane and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import model as M
from orrery.functions import routing
from orrery.operators import control, memory, quantized
from orrery.sources import adapters, imports
from orrery.sources.store import Store, decode_cursor, encode_cursor
from orrery.streaming import changelog


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create(M.CollectionConfig("t", 2, "dot", 2))
    return s


def live(store):
    return {r["id"]: [round(x, 3) for x in r["vector"]] for r in store.records("t").collect()}


def test_log_checkpoints_and_deltas(store):
    up = lambda *rows: store.upsert("t", [{"id": i, "vector": v, **m} for i, v, m in rows])
    up(("a", [1, 0], {}), ("b", [0, 1], {}))
    store.checkpoint("t")
    up(("a", [2, 0], {"metadata": {"kind": "new"}}), ("c", [0, 2], {}), ("c", [0, 3], {}))
    store.delete("t", "b")
    assert live(store) == {"a": [2, 0], "c": [0, 3]}
    store.checkpoint("t")
    up(("d", [1, 1], {}))
    assert live(store) == {"a": [2, 0], "c": [0, 3], "d": [1, 1]}
    assert [r["id"] for r in store.open("t").search([1, 0], top_k=2).collect()] == ["a", "d"]
    with pytest.raises(M.NotFound):
        store.delete("t", "b")
    assert store.clean("t") and live(store) == {"a": [2, 0], "c": [0, 3], "d": [1, 1]}


def test_batches_are_whole_and_idempotent(store):
    with pytest.raises(M.InvalidArgument):
        store.upsert("t", [{"id": "a", "vector": [1, 0]}, {"id": "b", "vector": [1, float("nan")]}])
    assert live(store) == {}
    first = store.upsert("t", [{"id": "a", "vector": [1, 0]}], "key-1")
    assert store.upsert("t", [{"id": "a", "vector": [1, 0]}], "key-1") == first
    with pytest.raises(M.Conflict):
        store.upsert("t", [{"id": "a", "vector": [2, 0]}], "key-1")
    assert live(store) == {"a": [1, 0]}


def test_writers_and_crashes(spark, store, monkeypatch):
    """Two writers from one state: one is told; a crash before the manifest leaves the last state, key and all."""
    store.upsert("t", [{"id": "a", "vector": [1, 0]}])
    stale = store._state("t")
    store.upsert("t", [{"id": "b", "vector": [1, 0]}])
    with pytest.raises(M.Conflict):
        store._point("t", stale)
    monkeypatch.setattr(store, "_point", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    for change in (lambda: store.upsert("t", [{"id": "c", "vector": [1, 0]}], "once"), lambda: store.checkpoint("t"), lambda: store.delete("t", "a"), lambda: store.index_text("t")):
        with pytest.raises(OSError):
            change()
        assert live(store) == {"a": [1, 0], "b": [1, 0]}
    monkeypatch.undo()
    first = store.upsert("t", [{"id": "c", "vector": [1, 0]}], "once")
    assert first["version"] == 3 and store.upsert("t", [{"id": "c", "vector": [1, 0]}], "once") == first and store._state("t")["lsn"] == 3
    assert len(store.clean("t")) == 4 and live(store) == {"a": [1, 0], "b": [1, 0], "c": [1, 0]}  # what the crashes left


def test_snapshots_outlive_checkpoints(store):
    store.upsert("t", [{"id": "a", "vector": [1, 0]}])
    kept, held = store.snapshot("t"), store.open("t")
    store.upsert("t", [{"id": "a", "vector": [5, 0]}, {"id": "b", "vector": [2, 0]}])
    store.checkpoint("t")
    assert [r["vector"] for r in held.records.collect()] == [[1, 0]]  # a reader from before
    store.clean("t")
    assert [r["vector"] for r in store.open("t", kept).records.collect()] == [[1, 0]] and live(store) == {"a": [5, 0], "b": [2, 0]}
    store.release("t", kept)
    store.clean("t")
    with pytest.raises(M.NotFound):
        store.open("t", kept)


def test_ledger_pages(store, monkeypatch):
    monkeypatch.setattr("orrery.sources.store.LEDGER_PAGE", 2)
    results = [store.upsert("t", [{"id": str(i), "vector": [i, 0]}], f"k{i}") for i in range(3)]
    assert [store.upsert("t", [{"id": str(i), "vector": [i, 0]}], f"k{i}") for i in range(3)] == results and len(store._state("t")["ledger"]) == 1


def test_text_index(store):
    store.upsert("t", [{"id": str(i), "vector": [1, 0], "text": "tide " * i + "boat"} for i in range(5)])
    plain = sorted(map(tuple, store.open("t").search(text="tide boat", top_k=5).select("id", "score").collect()))
    store.index_text("t")
    view = store.open("t")
    assert view.postings is not None and sorted(map(tuple, view.search(text="tide boat", top_k=5).select("id", "score").collect())) == [(i, pytest.approx(s)) for i, s in plain]
    store.delete("t", "3")
    assert store.open("t").postings is None and "3" not in {r["id"] for r in store.open("t").search(text="tide", top_k=5).collect()}


def test_full_pages_end(spark, store):
    store.load("t", spark.range(M.MAX_PAGE).selectExpr("printf('%05d', id) id", "array(1f, 2f) vector"))
    rows, cursor = store.scroll("t", M.MAX_PAGE)
    assert len(rows) == M.MAX_PAGE and cursor == ""
    assert sorted(r["lsn"] for r in store.log("t").select("lsn").collect()) == list(range(1, M.MAX_PAGE + 1))
    with pytest.raises(M.InvalidArgument, match="several rows"):
        store.load("t", spark.createDataFrame([("x", [1.0, 0.0]), ("x", [2.0, 0.0])], "id string, vector array<float>"))


def test_catalogue_scroll_backup(store, tmp_path):
    with pytest.raises(M.AlreadyExists):
        store.create(M.CollectionConfig("t", 2))
    store.upsert("t", [{"id": "b", "vector": [1, 0]}, {"id": "a", "vector": [1, 0], "metadata": {"n": 1}}, {"id": "c", "vector": [1, 0], "namespace": "tenant"}])
    rows, cursor = store.scroll("t", 2)
    assert [r["id"] for r in rows] == ["a", "b"] and [r["id"] for r in store.scroll("t", 2, cursor=cursor)[0]] == ["c"]
    assert decode_cursor(encode_cursor("n", "k")) == ("n", "k")
    with pytest.raises(M.InvalidArgument):
        store.scroll("t", cursor="bad")
    store.backup("t", str(tmp_path / "backup"))
    assert store.restore(str(tmp_path / "backup"), "u") == "u" and store.list() == ["t", "u"] and store.open("u").count() == 3
    store.drop("u")
    assert store.list() == ["t"]
    with pytest.raises(M.NotFound):
        store.open("u")


def test_bulk_load_and_stored_types(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create(M.CollectionConfig("t", 2, vectors={"half": M.VectorField(1, datatype="float16")}))
    s.load("t", spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>"))
    s.upsert("t", [{"id": "b", "vector": [0, 1], "vectors": {"half": [0.1]}}])
    assert {r["id"]: r["vec_half"] for r in s.records("t").collect()} == {"a": None, "b": [pytest.approx(0.0999755859375, abs=1e-12)]}
    with pytest.raises(Exception, match="overflows"):
        s.upsert("t", [{"id": "c", "vector": [0, 1], "vectors": {"half": [1e6]}}])
    with pytest.raises(M.InvalidArgument):
        s.load("t", spark.createDataFrame([("a", [1.0])], "id string, vector array<float>"))
    x = np.array([1.00390625, 0, -2.5], np.float32)
    assert imports.brain_float(x).tolist() == [1, 0, -2.5] and imports.half_float(np.array([65504, 5.9604645e-08], np.float32)).tolist() == [65504, pytest.approx(5.9604645e-08)]


def test_imports(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('ID,Vector,lang,year,metadata,payload\na,1 0,en,2024,"{""lang"": ""fr"", ""x"": null}","{""k"": 1}"\nb,"[1, 2, 3]",de,,,\n,1 0,en,1,,\nc,1;x,en,1,,\n,,,,,\n')
    good, bad = imports.validated(imports.read_csv(spark, str(csv)), 2)
    row = good.first()
    assert (row["id"], row["vector"], row["metadata"]["lang"]["s"], row["metadata"]["year"]["d"], row["metadata"]["x"]["kind"], row["payload"]) == ("a", [1, 0], "fr", 2024, "n", '{"k": 1}')
    assert sorted(r["reason"] for r in bad.collect()) == ["expected 2 dimensions", "missing id", "vector components must be finite numbers"]
    (tmp_path / "b.csv").write_text("vector\n1 0\n")
    with pytest.raises(M.InvalidArgument):
        imports.read_csv(spark, str(tmp_path / "b.csv"))
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"id": 7, "vector": [1, 0], "metadata": {"a": [1], "b": true}}\n\n{"id": "t", "text": "words"}\n')
    rows = {r["id"]: r for r in imports.read_json_lines(spark, str(lines)).collect()}
    assert rows["7"]["metadata"]["a"]["kind"] == "x" and rows["7"]["metadata"]["b"]["b"] is True and rows["t"]["text"] == "words"
    lines.write_text('{"id": 7}\nnonsense\n')
    with pytest.raises(Exception, match="not a JSON object"):
        imports.read_json_lines(spark, str(lines)).collect()
    for i, text in enumerate(('[{"id": "a", "vector": [1]}]', '{"records": [{"id": "a", "vector": [1]}]}')):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        assert [r["id"] for r in imports.read_json(spark, str(path)).collect()] == ["a"]


def test_fvecs(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in x))
    assert [r["vector"] for r in imports.read_fvecs(spark, str(tmp_path / "x.fvecs")).orderBy("id").collect()] == x.tolist()
    assert imports.synthetic(spark, 10, 8, "uniform").collect() == imports.synthetic(spark, 10, 8, "uniform").repartition(3).orderBy("id").collect()


def test_memory(spark, tmp_path):
    """Recall against the formula; expired memories go in one write."""
    s, now = Store(spark, str(tmp_path / "m")), [2_000_000.0]
    e = memory.CachedEmbedder(memory.HashEmbedder(32))
    s.create(M.CollectionConfig("diary", 32))
    m = memory.Memory(s, "diary", e, lambda: now[0])
    day, said = 86400, {}
    for age, text, ttl in ((20, "tide table for spring", None), (9, "spring tide tonight", None), (3, "paint the boat", 2 * day), (3, "tide", 2 * day), (1, "boat engine", None)):
        now[0] = 2_000_000 + (20 - age) * day
        m.remember("skipper", text, ttl=ttl)
        said[text] = age
    m.remember("mate", "tide and boat")
    now[0] = 2_000_000 + 20 * day
    cosine = lambda a, b: float(np.dot(a, b) / max(1e-12, np.sqrt(np.dot(a, a) * np.dot(b, b))))
    live = [t for t in said if t not in ("paint the boat", "tide")]
    want = {t: 0.8 * cosine(*e.embed(["spring tide", t])) + 0.2 * 2 ** (-said[t] * 24 / 168) for t in live}
    got = [(r["text"], r["score"]) for r in m.recall("skipper", "spring tide").collect()]
    assert [t for t, _ in got] == sorted(live, key=lambda t: -want[t]) and dict(got) == pytest.approx(want)
    before = len(s._state("diary")["batches"])
    assert m.prune() == 2 and s.open("diary").count() == 4 and len(s._state("diary")["batches"]) == before + 1 and m.prune() == 0
    with pytest.raises(M.InvalidArgument):
        m.remember("skipper", "x", {"expires_at": 1})
    assert set(m.tools()) == {"remember", "recall", "forget", "prune"}


def test_namespaces(spark):
    items = spark.createDataFrame([(["users", "alice", "notes"],), (["users", "bob"],), (["teams", "core"],)], "path array<string>")
    names = lambda **k: [tuple(r["path"]) for r in memory.namespaces(items, **k).collect()]
    assert names(matches=[(["users", "*"], False)]) == [("users", "alice", "notes"), ("users", "bob")]
    assert names(max_depth=1) == [("teams",), ("users",)]
    assert names(matches=[(["core"], True)]) == [("teams", "core")]
    values = spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',)], "v string")
    count = lambda c: values.where(memory.value_matches(F.col("v"), c)).count()
    assert (count({"a": 1}), count({"a": {"$ne": 1}}), count({"a": {"$gt": 0}}), count({"b": "x"})) == (1, 1, 1, 1)


def test_placement(spark):
    shards = control.shard_rows(spark.createDataFrame([("c", 64)], "collection string, shard_count int"))
    nodes = lambda *names: spark.createDataFrame([(n, 1) for n in names], "node string, capacity int")
    owners = lambda df: {r["shard"]: r["node"] for r in control.replicas(df, shards).collect()}
    three, four = owners(nodes("a", "b", "c")), owners(nodes("d", "c", "b", "a"))
    assert len(three) == 64 and set(three.values()) == {"a", "b", "c"}
    assert all(four[s] in (three[s], "d") for s in three)
    moves = control.rebalance(control.replicas(nodes("a", "b", "c"), shards, 2), control.replicas(nodes("a", "b", "c", "d"), shards, 2)).collect()
    assert moves and all(m["added"] == ["d"] and len(m["removed"]) == 1 and m["steps"][0] == "copy:d" and m["steps"][-1].startswith("remove:") for m in moves)


def test_compaction():
    mb = 1 << 20
    run, forced = control.compaction([control.Segment(n, s * mb, i) for i, (n, s) in enumerate(zip("abcde", (2, 3, 4, 5, 8)))])
    assert [s.name for s in run] == list("abcd") and not forced and sum(s.size for s in run) == 14 * mb
    assert control.compaction([control.Segment("a", 1, 0)]) == ([], False)
    run, forced = control.compaction([control.Segment(str(i), 6**i, i) for i in range(8)])
    assert forced and len(run) == 4
    with pytest.raises(M.Conflict):
        control.compaction([control.Segment(str(i), 60 * mb, i) for i in range(8)], most_bytes=64 * mb)


def test_logs_and_metrics(spark):
    m = control.parse_metrics(spark.createDataFrame([('up{a="x",b="y"} 1.5',), ("# HELP",), ("plain 2",)], "value string")).collect()
    assert [(r["name"], r["labels"], r["value"]) for r in m] == [("up", {"a": "x", "b": "y"}, 1.5), ("plain", {}, 2.0)]
    r = control.rates(spark.createDataFrame([(0, 10), (10, 30), (20, 5)], "t int, v int"), "t", "v").orderBy("t").collect()
    assert [x["rate"] for x in r] == [None, 2.0, 0.0]
    h = control.histogram(spark.createDataFrame([(1.0,), (5.0,), (None,)], "v double"), "v", [2, 10]).collect()
    assert [(x["le"], x["count"]) for x in h] == [(2.0, 1), (10.0, 2), (None, 2)]
    with pytest.raises(M.Conflict):
        control.recovery_point(spark.createDataFrame([(1, "x", "c", 0), (2, "x", "c", 1)], "epoch int, digest string, collection string, shard int"))


def test_streams(spark, tmp_path):
    schema = "shard int, lsn long, digest string"
    rows = [(0, 1, "a"), (0, 1, "a"), (0, 1, "b"), (0, 2, "c"), (0, 4, "d"), (1, 2, "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = changelog.ordered_apply(log).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["shard"], r["lsn"], r["digest"], r["outcome"]) for r in spark.table("outcomes").collect())
    assert got == [(0, 1, "a", "applied"), (0, 1, "a", "duplicate"), (0, 1, "b", "conflict"), (0, 2, "c", "applied"), (0, 4, "d", "gap"), (1, 2, "x", "gap")]
    changes = [(0, 1, "upsert", "", "a", "1"), (0, 2, "upsert", "", "b", "2"), (0, 3, "delete", "", "a", None)]
    spark.createDataFrame(changes, changelog.LOG).write.parquet(str(tmp_path / "log"))
    for _ in range(2):
        changelog.materialize(changelog.read(spark, str(tmp_path / "log")), str(tmp_path / "view"), str(tmp_path / "cp2")).awaitTermination()
        spark.createDataFrame([(0, 4, "upsert", "", "b", "3"), (0, 2, "upsert", "", "a", "0")], changelog.LOG).write.mode("append").parquet(str(tmp_path / "log"))
    assert {(r["id"], r["payload"]) for r in changelog.live(spark, str(tmp_path / "view"), 1).collect()} == {("b", "3")}


def test_payload_is_json(store):
    store.upsert("t", [{"id": "a", "vector": [1, 0], "payload": {"x": [1, 2]}}])
    assert json.loads(store.open("t").get("a").first()["payload"]) == {"x": [1, 2]}


def test_shards_and_installed_replicas(spark, store):
    assert routing.fnv1a(b"") == 0xCBF29CE484222325 and routing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    keys = [(n, k) for n in ("", "tenant", "é") for k in ("a", "bb", "c" * 40)]
    df = spark.createDataFrame(keys, "namespace string, id string").withColumn("s", routing.shard(F.col("namespace"), F.col("id"), 7))
    assert all(r["s"] == routing.shard_of(r["namespace"], r["id"], 7) for r in df.collect())
    store.upsert("t", [{"id": str(i), "vector": [i, 0]} for i in range(20)])
    pages = [[r["id"] for r in store.open("t").scroll(50, shard=s).collect()] for s in (0, 1)]
    assert sorted(sum(pages, [])) == sorted(map(str, range(20))) and all(routing.shard_of("", i, 2) == s for s, p in enumerate(pages) for i in p)
    store.install("t", store.records("t").where("id = '3'"), 99)
    assert live(store) == {"3": [3, 0]}
    with pytest.raises(M.Compacted):
        store.install("t", store.records("t"), 5)


def test_component_codes(spark):
    df = spark.createDataFrame([([0.0, 5.0],), ([51.0, 5.0],), ([255.0, 5.0],)], "vector array<float>")
    out = quantized.with_component_codes(df, quantized.component_ranges(df))
    assert [list(r["codes"]) for r in out.orderBy(F.col("vector")[0]).collect()] == [[0, 0], [51, 0], [255, 0]]


def test_item_and_text_stores(spark, tmp_path):
    s, now = Store(spark, str(tmp_path / "i")), [1_000_000.0]
    for name in ("items", "texts"):
        s.create(M.CollectionConfig(name, 16))
    items = adapters.ItemStore(s, "items", memory.HashEmbedder(16), lambda: now[0])
    items.put(("users", "alice"), "likes", {"drink": "coffee", "n": 2})
    items.put(("users", "bob"), "likes", {"drink": "tea", "n": 1}, ttl=1)
    now[0] += 5
    items.put(("users", "alice"), "likes", {"drink": "coffee", "n": 3})
    assert items.get(("users", "alice"), "likes")["value"]["n"] == 3
    assert items.get(("users", "alice"), "likes")["created_at"] < items.get(("users", "alice"), "likes")["updated_at"]
    assert [i["value"]["drink"] for i in items.search(("users",), conditions={"n": {"$lt": 3}})] == ["tea"]
    assert items.search(("users", "alice"), "coffee")[0]["key"] == "likes"
    assert items.namespaces(max_depth=1) == [("users",)]
    now[0] += 100
    assert items.get(("users", "bob"), "likes") is None and items.namespaces() == [("users", "alice")]
    items.put(("users", "alice"), "likes", None)
    assert items.search() == []
    texts = adapters.TextStore(s, "texts", memory.HashEmbedder(16))
    a, b = texts.add(["red apples", "green pears"], [{"k": 1}, {"k": 2}])
    assert texts.search("red apples", 1)[0][:3] == (a, "red apples", {"k": 1}) and texts.search("red", 2, {"k": 2})[0][0] == b
    texts.delete([a])
    assert len(texts.search("red", 5)) == 1
