"""The change log as a stream: last-writer-wins tables, ordered apply with its outcomes, and idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import resolved

LOG = T.StructType([T.StructField(n, k) for n, k in (("shard", T.IntegerType()), ("lsn", T.LongType()), ("op", T.StringType()), ("namespace", T.StringType()), ("id", T.StringType()), ("payload", T.StringType()))])


def read(spark: SparkSession, path: str, schema: T.StructType = LOG) -> DataFrame:
    """A folder of log files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def materialize(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the live view of a log stream: each micro-batch is resolved together with the view before it.

    Deletes stay as rows, so that an older write that comes late does not bring a key back. Versions are folders named by
    the batch; a batch that is redone writes the same folder.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/v{number - 1}").unionByName(batch)
        cells = [c for c in rows.columns if c not in ("namespace", "id")]
        last = rows.groupBy("namespace", "id").agg(F.max_by(F.struct(*cells), "lsn").alias("r"))
        last.select("namespace", "id", *[F.col(f"r.{c}").alias(c) for c in cells]).select(*rows.columns).write.mode("overwrite").parquet(f"{target}/v{number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(spark: SparkSession, target: str, version: int, schema: T.StructType = LOG) -> DataFrame:
    return resolved(spark.read.schema(schema).parquet(f"{target}/v{version}"))


OUTCOMES = "shard int, lsn long, digest string, outcome string"
_STATE = "last long, base long, digests map<long,string>"


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, keep: int) -> Iterator[pd.DataFrame]:
    last, base, known = state.get if state.exists else (0, 0, {})
    known = dict(known)
    rows = pd.concat(list(batches)).sort_values("lsn", kind="stable")
    out = []
    for lsn, digest in zip(rows["lsn"], rows["digest"]):
        lsn = int(lsn)
        if lsn == last + 1:
            last, outcome = lsn, "applied"
            known[lsn] = digest
        elif lsn > last:
            outcome = "gap"
        elif lsn <= base:
            outcome = "compacted"
        else:
            outcome = "duplicate" if known.get(lsn) == digest else "conflict"
        while len(known) > keep:
            base = min(known)
            del known[base]
        out.append((key[0], lsn, digest, outcome))
    state.update((last, base, known))
    yield pd.DataFrame(out, columns=["shard", "lsn", "digest", "outcome"])


def ordered_apply(log: DataFrame, keep: int = 1024) -> DataFrame:
    """Outcome of each log row (shard, lsn, digest): the next in order is applied; one before is a duplicate or, with other
    content, a conflict; one beyond the `keep` last is compacted; one that skips is a gap. State is a shard's last rows."""
    return log.groupBy("shard").applyInPandasWithState(lambda k, b, s: _apply(k, b, s, keep), OUTCOMES, _STATE, "append", GroupStateTimeout.NoTimeout)


def deduplicated(batches: DataFrame, key: str = "idempotency_key", at: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key; with an event time, state older than the delay is dropped."""
    if at is None:
        return batches.dropDuplicates([key])
    return batches.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
