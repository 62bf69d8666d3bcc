"""The registered queries on the small tables, and each pipeline stage against a brute-force version on its own input."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from orrery.llm import oracles
from orrery.llm.common import written

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.execute(oracles.ORACLES[name])
    cols = [d[0] for d in want.description]
    df = __spark_entry__.queries()[name](spark, DATA)
    assert df.columns == cols
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name, table, key, columns", [
    ("op1_langid", "documents", "doc_id", ["doc_id", "lang", "posterior", "text_lang", "host_prior", "accepted"]), ("op2_quality", "documents", "doc_id", ["doc_id", "held_out", "score", "predicted"]),
    ("op4_transducer", "documents", "doc_id", ["doc_id", "n_bytes", "n_tokens", "over_limit"]), ("op10_simhash", "documents", "doc_id", ["doc_id", "fingerprint", "component_id"]), ("langid_pages", "pages", "page_id", None),
])
def test_query_has_a_row_for_each(spark, name, table, key, columns):
    out = __spark_entry__.queries()[name](spark, DATA)
    assert columns is None or out.columns == columns
    ids = lambda df: sorted(r[key] for r in df.select(key).collect())
    assert ids(out) == ids(spark.read.parquet(f"{DATA}/{table}.parquet"))


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    data = DATA.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (len(t.encode()), len(e.ids), len(e.ids) > 2048) for (i, t), e in zip(texts.items(), plain.encode_batch(list(texts.values()), add_special_tokens=False))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in __spark_entry__.queries()["op4_transducer"](spark, data).collect()} == want


def test_names():
    ops = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.findall(r"\d+", n)[0]) for n in ops) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "shared_text", "benchmark_free", "packing"]


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    odd = spark.createDataFrame([(90001, "", "en", "src0", 0), (90002, "0123 456 !!", "de", "src1", 11), (90003, None, None, None, None)], SCHEMA)
    found = written(stage["language"](spark, docs.unionByName(odd), DATA))
    assert rows(found).keys() == rows(docs).keys() and found.columns == corpus_pipeline.COLUMNS

    before, after = rows(found), written(stage["near_copies"](spark, found.unionByName(found.limit(3)), DATA))
    left = rows(after)
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    assert after.count() == len(left)
    for i in before:
        near = [j for j in before if j != i and alike(sets[i], sets[j]) >= 0.8]
        if i not in left:
            assert near  # whoever goes has a near copy
        elif not near:
            continue
        else:
            assert all(j not in left or min(alike(sets[i], sets[j]), 0.85) < 0.85 for j in near)  # clear copies do not both stay

    cut = written(stage["shared_text"](spark, after, DATA))
    got, least = rows(cut), {}
    for i, r in left.items():
        t = r["text"].encode()
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], i), i)
    for i, r in left.items():
        t = r["text"].encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        at, kept = 0, []
        for c in r["text"]:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        want = "".join(kept)
        assert (i in got) == bool(want.strip() or not any(gone))
        if i in got:
            assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["lang"] == r["lang"]

    held = docs.select(*[F.col(c) for c in corpus_pipeline.COLUMNS])
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    planted = spark.createDataFrame([(90010, "So. " + item + " And on it goes.", "en", "src0", 1), (90011, "nothing of the kind " * 10, "en", "src0", 1)], SCHEMA)
    clean = written(stage["benchmark_free"](spark, held.unionByName(planted), DATA))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    bench = [words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    spots = {tuple(w[k : k + 8]) for w in bench for k in range(len(w) - 7)}
    leaky = lambda t: any(tuple(w[k : k + 8]) in spots for w in [words(t)] for k in range(len(w) - 7))
    assert rows(clean).keys() == {r["doc_id"] for r in held.unionByName(planted).collect() if not leaky(r["text"])}

    pieces = stage["packing"](spark, clean, DATA).collect()
    assert {p["doc_id"] for p in pieces} == rows(clean).keys()


def test_run_takes_each_stage_in_turn(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, DATA))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, DATA))
    assert docs.count() == 0


def test_stages_begin_with_collected_heaps(spark):
    def full() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))

    docs = spark.createDataFrame([(1, "some words of a text", "en", "a.org/x", 20)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, DATA)
        assert full() > before
