"""Readers of vector files and record imports; rows that can't be records come back with a reason."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M

CELL = M.METADATA_VALUE.simpleString()


def _cell(kind: str, s=None, d=None, b=None, raw=None) -> Column:
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(kind).alias("kind"), none(s, "string").alias("s"), none(d, "double").alias("d"), none(b, "boolean").alias("b"), none(raw, "string").alias("raw"))


def json_cell(raw: Column) -> Column:
    """A JSON value's text as a typed cell."""
    number = raw.try_cast("double")
    return (
        F.when(raw == "null", _cell("n"))
        .when(raw.isin("true", "false"), _cell("b", b=raw == "true"))
        .when(raw.startswith('"'), _cell("s", s=F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")))
        .when(number.isNotNull() & ~F.isnan(number), _cell("d", d=number))
        .otherwise(_cell("x", raw=raw))
    )


def json_metadata(text: Column) -> Column:
    """A JSON object's text as the typed map; null stays null."""
    keys = F.json_object_keys(text)
    pairs = F.transform(keys, lambda k: F.struct(k.alias("k"), json_cell(_raw_at(text, k)).alias("v")))
    return F.when(text.isNotNull(), F.map_from_entries(F.coalesce(pairs, F.array().cast(f"array<struct<k:string,v:{CELL}>>"))))


def _raw_at(text: Column, key: Column) -> Column:
    """The JSON text of a key's value."""
    value = F.element_at(F.from_json(text, "map<string,variant>"), key)
    return F.coalesce(F.to_json(value), F.lit("null"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with quotes doubled; header names in lower case. Needs `id` and `vector` or `text`.

    A vector is a JSON array, or numbers between spaces, `;` or `|`. `metadata` and `payload` hold JSON; any other non-empty
    column is metadata, a number if it reads as a finite one; the metadata column wins.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    low = raw.toDF(*[c.strip().lower() for c in raw.columns])
    names = set(low.columns)
    if "id" not in names or not names & {"vector", "text"}:
        raise M.InvalidArgument("a CSV import needs id, and vector or text")
    blank = low.columns and F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in low.columns]).isNull()
    low = low.where(~blank)
    numbers = lambda c: F.transform(F.filter(F.split(F.translate(F.trim(c), "[],;|", "     "), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("float"))
    vector = numbers(F.col("vector")) if "vector" in names else F.lit(None).cast("array<float>")
    other = [c for c in low.columns if c not in ("id", "vector", "text", "namespace", "metadata", "payload", "sparse_vector")]
    cells = []
    for c in other:
        cell = F.col(f"`{c}`")
        number = F.trim(cell).try_cast("double")
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
        cells.append(F.when(cell.isNotNull() & (cell != ""), F.struct(F.lit(c).alias("k"), F.when(finite, _cell("d", d=number)).otherwise(_cell("s", s=cell)).alias("v"))))
    none = F.array().cast(f"array<struct<k:string,v:{CELL}>>")
    rest = F.map_from_entries(F.filter(F.array(*cells), lambda e: e.isNotNull())) if cells else F.map_from_entries(none)
    own = json_metadata(F.nullif(F.col("metadata"), F.lit(""))) if "metadata" in names else F.lit(None).cast(M.METADATA)
    kept = F.map_filter(rest, lambda k, v: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    column = lambda n: F.col(n) if n in names else F.lit(None).cast("string")
    return low.select(
        F.coalesce(column("namespace"), F.lit("")).alias("namespace"), F.col("id"), F.when(F.coalesce(column("vector"), F.lit("")) != "", vector).alias("vector"), column("text").alias("text"),
        F.map_concat(kept, F.coalesce(own, F.map_from_entries(none))).alias("metadata"), F.nullif(column("payload"), F.lit("")).alias("payload"),
    )


def _from_json(lines: DataFrame, column: str) -> DataFrame:
    v = F.from_json(F.col(column), "id string, namespace string, vector array<float>, text string, sparse_vector map<string,float>", {"mode": "PERMISSIVE"})
    parsed = lines.withColumn("v", v)
    part = lambda k: F.get_json_object(column, f"$.{k}")
    return parsed.select(F.coalesce(F.col("v.namespace"), F.lit("")).alias("namespace"), F.col("v.id").alias("id"), F.col("v.vector").alias("vector"), F.col("v.text").alias("text"), F.col("v.sparse_vector").alias("sparse_vector"), json_metadata(part("metadata")).alias("metadata"), part("payload").alias("payload"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record a line; blank lines are skipped, and a line that is no object fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = lines.withColumn("value", F.when(F.json_object_keys("value").isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).otherwise(F.col("value")))
    return _from_json(checked, "value")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or an object with a `records` array."""
    whole = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<variant>"), F.from_json(F.get_json_object("value", "$.records"), "array<variant>"))
    return _from_json(whole.select(F.explode(items).alias("v")).select(F.to_json("v").alias("value")), "value")


def validated(rows: DataFrame, dimension: int, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected with `reason`). A record has an id and a finite vector of the dimension, or text that is not blank."""
    if namespace is not None:
        rows = rows.withColumn("namespace", F.lit(namespace))
    vector, text = F.col("vector"), F.coalesce(F.trim(F.col("text")), F.lit(""))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id")
        .when(vector.isNull() & (text == ""), "neither vector nor text")
        .when(vector.isNotNull() & (F.size(vector) != dimension), f"expected {dimension} dimensions")
        .when(vector.isNotNull() & bad, "vector components must be finite numbers")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of files of little-endian rows [int32 dimension][float32 ...]; ids count from 0 in each file."""

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                words = np.frombuffer(content, "<i4")
                if not len(words):
                    continue
                width = int(words[0]) + 1
                if width < 2 or len(words) % width:
                    raise ValueError(f"{name} is no fvecs file")
                table = words.reshape(-1, width)
                if (table[:, 0] != width - 1).any():
                    raise ValueError(f"{name} mixes dimensions")
                x = table[:, 1:].view("<f4")
                yield pd.DataFrame({"id": np.arange(len(x)), "vector": list(x)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "id long, vector array<float>")


def synthetic(spark: SparkSession, count: int, dimension: int, kind: str = "clustered", clusters: int = 64, seed: int = 42) -> DataFrame:
    """(id, vector): clustered, low_rank or uniform test vectors, the same for a seed however they are dealt out."""
    if kind not in ("clustered", "low_rank", "uniform"):
        raise M.InvalidArgument(f"unknown kind {kind!r}")
    shared = np.random.default_rng(seed)
    centers = shared.standard_normal((clusters, dimension))
    basis = shared.standard_normal((max(1, dimension // 8), dimension))

    def draw(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                own = np.random.default_rng([seed, int(i)])
                if kind == "uniform":
                    x = own.uniform(-1, 1, dimension)
                elif kind == "low_rank":
                    x = own.standard_normal(len(basis)) @ basis
                else:
                    x = centers[own.integers(clusters)] + 0.25 * own.standard_normal(dimension)
                out.append(x.astype(np.float32))
            yield pd.DataFrame({"id": pdf["id"], "vector": out})

    return spark.range(count).mapInPandas(draw, "id long, vector array<float>")


def half_float(x: np.ndarray) -> np.ndarray:
    """Float32 rounded to 16 bits and back, to even."""
    with np.errstate(over="ignore"):
        return x.astype(np.float16).astype(np.float32)


def brain_float(x: np.ndarray) -> np.ndarray:
    """Float32 rounded to its upper 16 bits, to even; a NaN stays one."""
    bits = x.view(np.uint32)
    rounded = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(x), np.uint32(0x7FC00000), rounded).astype(np.uint32).view(np.float32)


def stored_as(column: Column, datatype: str) -> Column:
    """A vector rounded to a storage type; a component that would overflow fails the write."""
    if datatype == "float32":
        return column
    rounded = half_float if datatype == "float16" else brain_float

    @F.pandas_udf("array<float>")
    def store(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else rounded(np.asarray(v, np.float32)))

    out = store(column)
    over = F.exists(out, lambda x: F.abs(x) == float("inf"))
    return F.when(over, F.raise_error(F.lit(f"a component overflows {datatype}")).cast("array<float>")).otherwise(out)
