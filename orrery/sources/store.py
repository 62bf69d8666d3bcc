"""Collections on disk: a catalogue, a change log per collection and versioned checkpoints.

Everything lies under one root that all executors share. A collection's state is a series of numbered manifests: a change
writes its files first and then publishes the next number, which only one writer can; a crash before that leaves the last
state, and the loser of a race is told of a conflict. A batch is one write job of log rows, validated before; a checkpoint
writes the live records to a new folder. Old files stay for open readers until `clean`. The live view is the base with the
log's later rows on top, the last writer of a key winning.
"""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model as M
from ..operators import lexical
from ..operators.filters import metadata_of
from ..plans.planner import Collection
from . import imports

LEDGER_PAGE = 1000  # idempotency keys in a manifest before they get a file of their own
KEY_NAME = re.compile(r"[A-Za-z0-9._:-]{1,128}")


def resolved(log: DataFrame, order: Sequence[str] = ("lsn",)) -> DataFrame:
    """The last row of each key that is no delete: one hash aggregate, which keeps a struct per key."""
    cells = [c for c in log.columns if c not in ("namespace", "id")]
    last = log.groupBy("namespace", "id").agg(F.max_by(F.struct(*cells), F.struct(*order)).alias("r"))
    return last.where("r.op <> 'delete'").select("namespace", "id", *[F.col(f"r.{c}").alias(c) for c in cells])


def shadowed(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The base without keys that the delta replaces or deletes, plus the delta's live rows."""
    keys = delta.select("namespace", "id").distinct()
    live = delta.where("op <> 'delete'").select(*base.columns)
    return base.join(keys, ["namespace", "id"], "left_anti").unionByName(live)


def encode_cursor(namespace: str, key: str) -> str:
    return base64.urlsafe_b64encode(f"{namespace}\0{key}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode()
        namespace, key = raw.split("\0")
    except ValueError as e:
        raise M.InvalidArgument("bad cursor") from e
    if not key:
        raise M.InvalidArgument("bad cursor")
    return namespace, key


class Files:
    """Small files beside the tables, through the file system that Spark uses for the root."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = path.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all, and never over another file: written aside, then moved to a name that must be free."""
        temporary, final = self.path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"), self.path(name)
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.conf)
        try:
            none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
            context.rename(temporary, final, none)
        except Exception as e:
            self.fs.delete(temporary, False)
            if self.exists(name):
                raise M.Conflict(name) from e
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # ---- catalogue

    def create(self, config: M.CollectionConfig) -> None:
        config.validate()
        if self.files.exists(f"{config.name}/config.json"):
            raise M.AlreadyExists(config.name)
        self.files.write(f"{config.name}/config.json", json.dumps(dataclasses.asdict(config)))
        self._point(config.name, {"base": None, "lsn": 0, "batches": [], "versions": 0})

    def describe(self, name: str) -> M.CollectionConfig:
        text = self.files.read(f"{name}/config.json")
        if text is None:
            raise M.NotFound(name)
        spec = json.loads(text)
        fields = {n: M.VectorField(**(f | {"index": M.IndexConfig(**f["index"])})) for n, f in spec.pop("vectors").items()}
        return M.CollectionConfig(**(spec | {"index": M.IndexConfig(**spec["index"]), "vectors": fields}))

    def list(self, prefix: str = "", after: str = "", limit: int = M.MAX_PAGE) -> list[str]:
        M.between("limit", limit, 1, M.MAX_PAGE)
        return [n for n in self.files.names("") if n > after and n.startswith(prefix) and self.files.exists(f"{n}/config.json")][:limit]

    def drop(self, name: str) -> None:
        self.describe(name)
        self.files.remove(name)

    # ---- writes

    def _manifests(self, name: str) -> list[str]:
        return [n for n in self.files.names(f"{name}/manifests") if not n.startswith(".")]

    def _state(self, name: str, number: int | None = None) -> dict:
        """The last state, or that of a number; `number` in it tells which it is."""
        known = self._manifests(name)
        if number is not None:
            known = [n for n in known if n == f"{number:012d}.json"]
        if not known:
            raise M.NotFound(name)
        return json.loads(self.files.read(f"{name}/manifests/{known[-1]}"))

    def _point(self, name: str, state: dict) -> None:
        """Publish the state after the one that it was made from; a conflict if another writer did."""
        state["number"] = state.get("number", -1) + 1
        self.files.write(f"{name}/manifests/{state['number']:012d}.json", json.dumps(state))

    def _log_schema(self, config: M.CollectionConfig) -> T.StructType:
        return T.StructType([T.StructField("lsn", T.LongType()), T.StructField("op", T.StringType()), *[T.StructField(f.name, f.dataType, True) for f in config.record_schema()]])

    def _append(self, name: str, rows: DataFrame, count: int, state: dict) -> None:
        """One batch: its rows, then the manifest that names it (and whatever else is new in the state)."""
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}/log/{batch}")
        state["batches"].append([batch, state["lsn"] + 1, state["lsn"] + count])
        state["lsn"] += count
        self._point(name, state)

    def _prepared(self, config: M.CollectionConfig, record: Mapping, lsn: int, now: int) -> tuple:
        if not record.get("id"):
            raise M.InvalidArgument("a record needs an id")
        sparse, text = record.get("sparse_vector"), record.get("text")
        cells = {"namespace": record.get("namespace", ""), "id": record["id"], "vector": M.check_vector(record["vector"], config.dimension), "sparse_vector": None if sparse is None else M.check_sparse(sparse), "text": None if text is None else M.check_text(text)}
        given = record.get("vectors", {})
        if unknown := set(given) - set(config.vectors):
            raise M.InvalidArgument(f"unknown vector fields {sorted(unknown)}")
        for field, spec in config.vectors.items():
            value = given.get(field)
            check = M.check_multi_vector if spec.multi_vector else M.check_vector
            cells[M.column_of(field, spec.multi_vector)] = None if value is None else check(value, spec.dimension)
        payload = record.get("payload")
        cells |= {"metadata": metadata_of(record.get("metadata")), "payload": None if payload is None else json.dumps(payload), "timestamp": now, "version": lsn}
        return (lsn, "upsert", *[cells[f.name] for f in config.record_schema()])

    def upsert(self, name: str, records: Sequence[Mapping], idempotency_key: str | None = None) -> dict:
        """Insert or replace records by key, all or none; of one key in a batch the last wins.

        A repeated idempotency key returns the first result for the same records and is a conflict for others.
        """
        config, state = self.describe(name), self._state(name)
        M.between("records in a batch", len(records), 1, M.MAX_BATCH)
        digest = hashlib.sha256(json.dumps(list(records), sort_keys=True, default=list).encode()).hexdigest()
        if idempotency_key is not None:
            if not KEY_NAME.fullmatch(idempotency_key):
                raise M.InvalidArgument("bad idempotency key")
            if before := self._ledger(name, state).get(idempotency_key):
                if before["digest"] != digest:
                    raise M.Conflict(f"{idempotency_key} was used for another request")
                return before["result"]
        now = time.time_ns()
        rows = [self._prepared(config, r, state["lsn"] + 1 + i, now) for i, r in enumerate(records)]
        frame = self.spark.createDataFrame(rows, self._log_schema(config))
        for field, spec in config.vectors.items():
            if spec.datatype != "float32" and not spec.multi_vector:
                column = M.column_of(field, False)
                frame = frame.withColumn(column, imports.stored_as(F.col(column), spec.datatype))
        result = {"count": len(rows), "version": state["lsn"] + len(rows), "timestamp": now}
        if idempotency_key is not None:  # published with the batch: both are there or neither
            state["keys"] = {**state.get("keys", {}), idempotency_key: {"digest": digest, "result": result}}
            if len(state["keys"]) >= LEDGER_PAGE:
                page = f"{name}/ledger/{uuid.uuid4().hex}.json"
                self.files.write(page, json.dumps(state.pop("keys")))
                state["ledger"] = [*state.get("ledger", []), page]
        self._append(name, frame, len(rows), state)
        return result

    def _ledger(self, name: str, state: dict) -> dict:
        """Idempotency keys used so far: those of the manifest and of the full pages that it names."""
        found = dict(state.get("keys", {}))
        for page in state.get("ledger", []):
            found |= json.loads(self.files.read(page))
        return found

    def load(self, name: str, records: DataFrame) -> None:
        """Bulk upsert of a frame of records: validated with one aggregate, then one write job. Every row has a number of its
        own; a key that two rows hold has no last one in a frame, and is an error."""
        config, state = self.describe(name), self._state(name)
        schema = self._log_schema(config)
        given = set(records.columns)
        if "namespace" not in given:
            records = records.withColumn("namespace", F.lit(""))
        bad = records.where((F.coalesce(F.col("id"), F.lit("")) == "") | F.col("vector").isNull() | (F.size("vector") != config.dimension) | F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
        if not bad.isEmpty():
            raise M.InvalidArgument("records without an id or a sound vector")
        if not records.groupBy("namespace", "id").count().where("count > 1").isEmpty():
            raise M.InvalidArgument("a key stands in several rows")
        # numbers without a sort: partition after partition, as the counts of partitions tell
        numbered = records.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).persist(StorageLevel.DISK_ONLY)
        try:
            sizes = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}  # a row a partition
            begin, at = {}, state["lsn"] + 1
            for part in sorted(sizes):
                begin[part], at = at, at + sizes[part]
            lsn = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in begin.items() for x in kv]), F.col("_part")).cast("long") + F.col("_row"), F.lit(0)) if begin else F.lit(0)
            cells = {"lsn": lsn, "op": F.lit("upsert"), "timestamp": F.lit(time.time_ns()), "version": lsn}
            names = {*given, "namespace"}
            rows = numbered.select(*[cells.get(f.name, F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
            self._append(name, rows, at - state["lsn"] - 1, state)
        finally:
            numbered.unpersist()

    def delete(self, name: str, id: str, namespace: str = "") -> None:
        config, state = self.describe(name), self._state(name)
        self.open(name).get(id, namespace)
        lsn = state["lsn"] + 1
        cells = {"lsn": lsn, "op": "delete", "namespace": namespace, "id": id, "timestamp": time.time_ns(), "version": lsn}
        schema = self._log_schema(config)
        self._append(name, self.spark.createDataFrame([tuple(cells.get(f.name) for f in schema)], schema), 1, state)

    def delete_keys(self, name: str, keys: DataFrame) -> int:
        """Deletes all keys (namespace, id) of a frame in one batch; how many there are."""
        config, state = self.describe(name), self._state(name)
        lsn, cells = state["lsn"] + 1, {}
        rows = keys.select("namespace", "id").distinct().persist(StorageLevel.DISK_ONLY)
        try:
            if count := rows.count():
                cells = {"lsn": F.lit(lsn), "op": F.lit("delete"), "namespace": F.col("namespace"), "id": F.col("id"), "timestamp": F.lit(time.time_ns()), "version": F.lit(lsn)}
                self._append(name, rows.select(*[cells.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self._log_schema(config)]), 1, state)
        finally:
            rows.unpersist()
        return count

    # ---- reads

    def log(self, name: str, after: int = 0, state: dict | None = None) -> DataFrame:
        """The change log's rows with lsn > after."""
        config, state = self.describe(name), state or self._state(name)
        paths = [f"{self.root}/{name}/log/{b}" for b, _, last in state["batches"] if last > after]
        schema = self._log_schema(config)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).where(F.col("lsn") > after)

    def records(self, name: str, state: dict | None = None) -> DataFrame:
        """The live view: base and later log rows."""
        config, state = self.describe(name), state or self._state(name)
        schema = config.record_schema()
        delta = self.log(name, state.get("checkpoint", 0), state)
        columns = schema.names
        if state["base"] is None:
            return resolved(delta).select(*columns)
        base = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/base/{state['base']}")
        later = [b for b in state["batches"] if b[2] > state.get("checkpoint", 0)]
        if not later:
            return base
        latest = delta.withColumn("_n", F.row_number().over(Window.partitionBy("namespace", "id").orderBy(F.desc("lsn")))).where("_n = 1").drop("_n")
        return shadowed(base, latest)

    def open(self, name: str, number: int | None = None, **more) -> Collection:
        """The collection as it is, or as the manifest of a number has it; with its inverted index if that is up to date."""
        state = self._state(name, number)
        index = state.get("text") or {}
        if index.get("lsn") == state["lsn"] and "postings" not in more:
            folder = f"{self.root}/{name}/text/{index['version']}"
            more |= {"postings": self.spark.read.parquet(f"{folder}/postings"), "text_totals": self.spark.read.parquet(f"{folder}/totals")}
        return Collection(self.describe(name), self.records(name, state), **more)

    def index_text(self, name: str, buckets: int = 64) -> None:
        """Write the inverted index of the live records and its totals, and publish it. Postings are sorted by token within
        buckets of tokens, so that a query reads few row groups. Any later write makes the index stale, and unused."""
        state, version = self._state(name), uuid.uuid4().hex
        folder = f"{self.root}/{name}/text/{version}"
        records = self.records(name, state)
        lexical.postings(records).repartition(buckets, "token").sortWithinPartitions("token").write.parquet(f"{folder}/postings")
        lexical.statistics(lexical.tokenized(records)).write.parquet(f"{folder}/totals")
        self._point(name, state | {"text": {"version": version, "lsn": state["lsn"]}})

    def scroll(self, name: str, limit: int = M.DEFAULT_PAGE, namespace: str = "", cursor: str = "", include_vector: bool = False) -> tuple[list, str]:
        """(rows, next cursor or '')."""
        after = decode_cursor(cursor) if cursor else None
        view = self.open(name)
        M.between("limit", limit, 1, M.MAX_PAGE)
        rows = view.page(limit + 1, namespace, after, include_vector).collect()
        more = len(rows) > limit
        rows = rows[:limit]
        return rows, encode_cursor(rows[-1]["namespace"], rows[-1]["id"]) if more and rows else ""

    # ---- maintenance

    def checkpoint(self, name: str) -> str:
        """Write the live records as a new base and publish it; a crash before that leaves the old state. Files that are no
        longer named stay for open readers and snapshots until `clean`."""
        state, version = self._state(name), uuid.uuid4().hex
        self.records(name, state).repartition("namespace", "id").sortWithinPartitions("namespace", "id").write.parquet(f"{self.root}/{name}/base/{version}")
        self._point(name, state | {"base": version, "checkpoint": state["lsn"], "versions": state["versions"] + 1, "batches": []})
        return version

    def clean(self, name: str) -> list[str]:
        """Remove bases, batches and indexes that neither the last manifest nor a snapshot names, and manifests before."""
        known = [self._state(name, int(n.split(".")[0])) for n in self._manifests(name)]
        pinned = known[-1].get("pins", [])
        live, gone = [s for s in known if s["number"] in pinned or s is known[-1]], []
        named = {("base", s["base"]) for s in live} | {("log", b) for s in live for b, _, _ in s["batches"]} | {("text", s["text"]["version"]) for s in live if s.get("text")}
        for s in known:
            if s not in live:
                self.files.remove(f"{name}/manifests/{s['number']:012d}.json")
        for folder in ("base", "log", "text"):
            for n in self.files.names(f"{name}/{folder}"):
                if (folder, n) not in named:
                    self.files.remove(f"{name}/{folder}/{n}")
                    gone.append(f"{folder}/{n}")
        return gone

    def snapshot(self, name: str) -> int:
        """Keep the present state: the number that `open` takes, whatever is written, checkpointed or cleaned later."""
        state = self._state(name)
        number = state["number"]
        self._point(name, state | {"pins": sorted({*state.get("pins", []), number})})
        return number

    def release(self, name: str, number: int) -> None:
        """Give a snapshot's files back to `clean`."""
        state = self._state(name)
        self._point(name, state | {"pins": [n for n in state.get("pins", []) if n != number]})

    def backup(self, name: str, target: str) -> dict:
        """The live records and a manifest of their count and hash under a new folder."""
        records = self.records(name)
        records.write.mode("errorifexists").parquet(f"{target}/records")
        manifest = {"config": self.files.read(f"{name}/config.json"), **self._sums(self.spark.read.parquet(f"{target}/records"))}
        Files(self.spark, target).write("manifest.json", json.dumps(manifest))
        return manifest

    def restore(self, source: str, name: str | None = None) -> str:
        """A backup as a new collection; its rows must match the manifest."""
        text = Files(self.spark, source).read("manifest.json")
        if text is None:
            raise M.NotFound(source)
        manifest = json.loads(text)
        records = self.spark.read.parquet(f"{source}/records")
        if self._sums(records) != {k: manifest[k] for k in ("rows", "hash")}:
            raise M.Conflict("the backup does not match its manifest")
        spec = json.loads(manifest["config"])
        name = name or spec["name"]
        if self.files.exists(f"{name}/config.json"):
            raise M.AlreadyExists(name)
        self.files.write(f"{name}/config.json", json.dumps(spec | {"name": name}))
        version = uuid.uuid4().hex
        records.write.parquet(f"{self.root}/{name}/base/{version}")
        top = records.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        self._point(name, {"base": version, "lsn": top, "checkpoint": top, "batches": [], "versions": 1})
        return name

    def install(self, name: str, records: DataFrame, lsn: int) -> None:
        """Replace a collection's records by another replica's, taken at a sequence number."""
        state, schema, version = self._state(name), self.describe(name).record_schema(), uuid.uuid4().hex
        if lsn < state["lsn"]:
            raise M.Compacted(f"{name} is at {state['lsn']}")
        records.select(*schema.names).write.parquet(f"{self.root}/{name}/base/{version}")
        self._point(name, state | {"base": version, "lsn": lsn, "checkpoint": lsn, "batches": [], "versions": state["versions"] + 1})

    @staticmethod
    def _sums(records: DataFrame) -> dict:
        cells = [F.to_json(F.struct(F.col(f.name).alias("v"))) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in records.schema]
        row = records.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash")).first()
        return row.asDict()
