"""What the operators share: the shared folder, text batches, substring hashes and skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_OWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where a local session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext)
    if not path:
        path = _OWN[spark.sparkContext] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, path, True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """df, computed once however often it is read: on the executors' disks, with its lineage, so that what a lost executor
    held is made again. Small files in the shared folder are not worth their cost for tables that one operator reads."""
    df.persist(StorageLevel.DISK_ONLY)
    _KEPT.append(df)
    return df


ROWS_A_FILE = 50_000


def settled(df: DataFrame) -> DataFrame:
    """df, computed once by as many tasks as it has, then written as a file for each ROWS_A_FILE rows and read back. Later
    plans begin at these files, so that they stay small however long the way to df was."""
    held = df.persist(StorageLevel.DISK_ONLY)
    out = written(held.coalesce(1 + held.count() // ROWS_A_FILE))
    held.unpersist()
    return out


def release() -> None:
    """Drop what `kept` holds: once a result that reads it is written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def collected(spark: SparkSession) -> None:
    """Have the executors collect their garbage, once a core. Their heaps grow to their limit over the stages, mostly by what
    is no longer used, and give nothing back before a full collection; workers need that memory beside them."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the operators' own buckets follow the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BUCKET_BYTES = 1 << 20  # of text in a bucket, at least


def buckets(spark: SparkSession, each: int = 3, size: int | None = None) -> int:
    """Buckets that a worker holds whole: several a shuffle partition, as it holds one at a time. Every bucket of keys sends
    a row to every bucket of documents, so with `size`, the bytes of all text, there are no more than have BUCKET_BYTES."""
    most = each * partitions(spark)
    return most if size is None else min(most, 1 + size // BUCKET_BYTES)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column end to end, and n + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, and several share a machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut to about `most` bytes of text each (one row at least), with their bytes and offsets."""
    for batch in batches:
        data, at = column_bytes(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
    trim()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of texts end to end, and how many words lie before each text's start."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # words end where their text ends
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_BITS = 14
_BLOCK = 1 << _BITS


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i modulo 2 ** 64 for i up to n, as low[i % _BLOCK] * high[i // _BLOCK]: a table of n numbers would outweigh a
    worker's batch, and a kept one stays as large as the longest text asked for."""
    low, high = np.full(_BLOCK, base, np.uint64), np.full(n // _BLOCK + 1, pow(base, _BLOCK, 1 << 64), np.uint64)
    low[0] = high[0] = 1
    return np.cumprod(low, dtype=np.uint64), np.cumprod(high, dtype=np.uint64)


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit values in constant time each: equal stretches, equal hashes. With `table`
    the values are table[values]."""

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        low, high = powers(_BASE, n)
        for k, lo in enumerate(range(0, n, _BLOCK)):
            part = values[lo : lo + _BLOCK] if table is None else table[values[lo : lo + _BLOCK]]
            out = self.sums[lo + 1 : lo + 1 + len(part)]
            np.cumsum(part * low[: len(part)], out=out)
            out *= high[k]
            out += self.sums[lo]
        self.low, self.high = powers(pow(_BASE, -1, 1 << 64), n)

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Prefix:
        return cls(data, _BYTE)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= self.low[start & (_BLOCK - 1)]
        out *= self.high[start >> _BITS]
        out += (end - start).astype(np.uint64)
        return mixed(out)


_JOIN = np.uint64(0xA24BAED4963EE407)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name of the pair (a, b). It is mixed at every step, so names of names keep no trace of sums or products."""
    return mixed((a ^ (a >> np.uint64(32))) * _JOIN + b)


class Names:
    """Hashes of stretches of 2 to `most` values, doubled up from neighbours: a stretch is named by its first and its last
    2 ** k values, which cover it. A single value is its own name."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= most and len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(joined(self.levels[-1][:-step], self.levels[-1][step:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.empty(len(start), np.uint64)
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            mine = np.flatnonzero(level == k)
            at = self.levels[k]
            a = at[start[mine]]
            out[mine] = a if k == 0 else joined(joined(a, at[end[mine] - (1 << k)]), size[mine].astype(np.uint64))
        return out


def piece_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each piece data[start:end]: its bytes and their number for up to seven, else 63 bits of XXH3."""
    import xxhash

    size = end - start
    loads = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    key = np.empty(len(start), np.uint64)
    short = size < 8
    bits = size[short].astype(np.uint64) * np.uint64(8)
    key[short] = loads[start[short]] & ((np.uint64(1) << bits) - np.uint64(1)) | size[short].astype(np.uint64) << np.uint64(56)
    if len(long := np.flatnonzero(~short)):
        flat, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        key[long] = [digest(flat[a:b]) | 1 << 63 for a, b in zip(start[long].tolist(), end[long].tolist())]
    return key


def equal_pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each piece, a piece of each group): pieces of a group have the same bytes. Longer pieces of one key are held
    against the group's piece, and those that differ are groups of one."""
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    long = np.flatnonzero(end - start > 7)
    long = long[first[back[long]] != long]
    if len(long):
        flat, lead = data.tobytes(), first[back[long]]
        differ = [i for i, a, b, c, d in zip(long.tolist(), start[long].tolist(), end[long].tolist(), start[lead].tolist(), end[lead].tolist()) if flat[a:b] != flat[c:d]]
        back[differ] = len(first) + np.arange(len(differ))
        first = np.concatenate([first, np.array(differ, np.int64)])
    return back, first


def with_heavy(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """left join right on key, for a right side with one row a key and the key's count of left rows in `weight`.

    Keys that hold more than 1/share of the left rows are fewer than `share`; these alone are broadcast, and the rows
    that they serve get spread keys in the shuffled join that serves the rest.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = right.where(F.col(weight) * share > F.lit(total))
    light = right.where(F.col(weight) * share <= F.lit(total))
    names = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(heavy.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in names])), F.col(key) == F.col("_hk"), "left")
    spread = marked.withColumn("_lk", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.struct(F.lit(0).cast("long").alias("s"), F.col(key).alias("k"))).otherwise(F.struct((F.monotonically_increasing_id() + 1).alias("s"), F.lit(None).cast(right.schema[key].dataType).alias("k"))))
    other = light.select(F.struct(F.lit(0).cast("long").alias("s"), F.col(key).alias("k")).alias("_rk"), *[F.col(c).alias(f"_l_{c}") for c in names])
    joined = spread.join(other, F.col("_lk") == F.col("_rk"), "left")
    return joined.select(*left.columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in names])
