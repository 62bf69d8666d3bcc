"""Every query of the catalogue against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from orrery.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rounded(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else tuple(map(rounded, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert got
        return
    want = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(rounded(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ordered_apply_takes_all_events(spark):
    """On a table long enough for compaction, against a walk through the log."""
    data = "/root/testdata/sf0.01"
    ids = [r["event_id"] for r in spark.read.parquet(f"{data}/events.parquet").select("event_id").collect()]
    log = sorted((i % 4, i // 4 + 1) for i in ids if (i % 4, i // 4 + 1) != (3, 50))
    last, want = dict.fromkeys(range(4), 0), {}
    for shard, lsn in log + [x for x in log if x[1] % 10 == 0]:
        outcome = "applied" if lsn == last[shard] + 1 else "gap" if lsn > last[shard] else "compacted" if lsn <= last[shard] - 1024 else "duplicate"
        last[shard] += outcome == "applied"
        want[shard, outcome] = want.get((shard, outcome), 0) + 1
    got = {(r["shard"], r["outcome"]): r["n"] for r in catalogue.QUERIES["ordered_apply_stream"](spark, data).collect()}
    assert got == want and {o for _, o in got} == {"applied", "gap", "compacted", "duplicate"}
    assert sum(got.values()) == len(log) + sum(x[1] % 10 == 0 for x in log)
