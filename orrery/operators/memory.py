"""Agent memory over a collection: remember, recall with recency, forget, prune, and namespaced items."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M

NEVER = (1 << 53) - 1
HALF_LIFE = 168.0
WEIGHT = 0.2
RESERVED = ("created_at", "expires_at")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors from word hashes, for tests and offline use."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            x = np.zeros(self.dimension)
            for word in text.lower().split():
                h = hashlib.sha256(word.encode()).digest()
                x[int.from_bytes(h[:4], "little") % self.dimension] += 1 if h[4] & 1 else -1
            size = np.sqrt((x * x).sum())
            out.append((x / size if size else x).tolist())
        return out


class CachedEmbedder:
    """Embeds distinct texts once, `batch` at a time, and keeps the last `most`."""

    def __init__(self, inner: Embedder, batch: int = 64, most: int = 10_000):
        self.inner, self.batch, self.most, self.dimension = inner, batch, most, inner.dimension
        self.kept: dict[str, list[float]] = {}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        found = {t: self.kept.pop(t) for t in dict.fromkeys(texts) if t in self.kept}
        new = [t for t in dict.fromkeys(texts) if t not in found]
        for i in range(0, len(new), self.batch):
            part = new[i : i + self.batch]
            found |= zip(part, self.inner.embed(part))
        self.kept |= found
        while len(self.kept) > self.most:
            del self.kept[next(iter(self.kept))]
        return [found[t] for t in texts]


def embedded(records: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector") -> DataFrame:
    """Fills null vectors of rows with text, in batches on the executors."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def fill(texts: pd.Series) -> pd.Series:
        known = texts.dropna().unique().tolist()
        of = dict(zip(known, embedder.embed(known))) if known else {}
        return texts.map(lambda t: of.get(t) if t is not None else None)

    needs = F.col(vector).isNull() & F.col(text).isNotNull() & (F.trim(text) != "")
    return records.withColumn(vector, F.when(needs, fill(F.when(needs, F.col(text)))).otherwise(F.col(vector)))


def recency(created: Column, now: float, half_life: float = HALF_LIFE) -> Column:
    """Halves each `half_life` hours."""
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), (F.lit(float(now)) - created) / 3600) / half_life)


def unexpired(expires: Column, now: float) -> Column:
    return expires > F.lit(now)


def ranked(hits: DataFrame, now: float, top_k: int, weight: float = WEIGHT, half_life: float = HALF_LIFE, created: str = "created_at") -> DataFrame:
    """Hits with `score` as similarity, by (1 - weight) similarity + weight recency; equal ones as first ranked."""
    M.between("top_k", top_k, 1, 50)
    M.between("recency_weight", weight, 0, 1)
    if not half_life > 0:
        raise M.InvalidArgument("half_life_hours must be positive")
    mixed = (1 - weight) * F.col("similarity") + weight * recency(F.col(created), now, half_life)
    return hits.withColumnRenamed("score", "similarity").withColumn("score", mixed).orderBy(F.desc("score"), F.desc("similarity"), "id").limit(top_k)


class Memory:
    """Texts of users in a collection; a user is a namespace."""

    def __init__(self, store, collection: str, embedder: Embedder, clock: Callable[[], float]):
        self.store, self.collection, self.embedder, self.clock = store, collection, embedder, clock

    def remember(self, user: str, text: str, metadata: Mapping | None = None, ttl: int | None = None, id: str | None = None) -> str:
        if not user or not text:
            raise M.InvalidArgument("user and text are needed")
        if metadata and set(metadata) & set(RESERVED):
            raise M.InvalidArgument(f"{RESERVED} are reserved")
        now = int(self.clock())
        id = id or hashlib.sha256(f"{user}\0{text}\0{now}".encode()).hexdigest()[:32]
        times = {"created_at": now, "expires_at": NEVER if ttl is None else now + ttl}
        self.store.upsert(self.collection, [{"id": id, "namespace": user, "vector": self.embedder.embed([text])[0], "metadata": dict(metadata or {}) | times, "payload": {"text": text}}])
        return id

    def recall(self, user: str, query: str, top_k: int = 5, weight: float = WEIGHT, half_life: float = HALF_LIFE, filter: Mapping | None = None) -> DataFrame:
        """id, text, similarity, score, created_at of the user's best memories that have not expired."""
        now = int(self.clock())
        live = {"expires_at": {"$gt": now}}
        hits = self.store.open(self.collection).dense(self.embedder.embed([query])[0], min(4 * top_k, 200), user, {"$and": [live, dict(filter)]} if filter else live)
        hits = hits.withColumn("created_at", F.col("metadata")["created_at"]["d"]).withColumn("text", F.get_json_object("payload", "$.text"))
        return ranked(hits, now, top_k, weight, half_life).select("id", "text", "similarity", "score", "created_at")

    def forget(self, user: str, id: str) -> None:
        self.store.delete(self.collection, id, user)

    def prune(self, user: str | None = None) -> int:
        """Deletes expired memories, all in one batch of the log, and tells how many."""
        rows = self.store.records(self.collection).where(F.col("metadata")["expires_at"]["d"] <= int(self.clock()))
        return self.store.delete_keys(self.collection, rows if user is None else rows.where(F.col("namespace") == user))

    def tools(self) -> dict[str, Callable]:
        return {"remember": self.remember, "recall": self.recall, "forget": self.forget, "prune": self.prune}


def item_id(namespace: Sequence[str], key: str) -> str:
    return hashlib.sha256(json.dumps([list(namespace), key]).encode()).hexdigest()


def path_matches(path: Column, pattern: Sequence[str], suffix: bool = False) -> Column:
    """Whether an array of names begins (or ends) with a pattern; `*` stands for any name."""
    n = len(pattern)
    at = lambda i: F.get(path, (F.size(path) - n + i) if suffix else F.lit(i))
    out = F.size(path) >= n
    for i, name in enumerate(pattern):
        if name != "*":
            out = out & F.coalesce(at(i) == name, F.lit(False))
    return out


def namespaces(items: DataFrame, column: str = "path", matches: Sequence[tuple[Sequence[str], bool]] = (), max_depth: int | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Distinct name paths that fit all patterns, cut to a depth, in order."""
    for pattern, suffix in matches:
        items = items.where(path_matches(F.col(column), pattern, suffix))
    path = F.slice(column, 1, max_depth) if max_depth else F.col(column)
    return items.select(path.alias(column)).distinct().orderBy(column).offset(offset).limit(limit)


def value_matches(value: Column, conditions: Mapping) -> Column:
    """The items' own dialect on a JSON value: equality, or operators; here `$ne` holds for a missing key too."""
    out = F.lit(True)
    for key, want in conditions.items():
        cell = F.get_json_object(value, f"$.{key}")
        for op, x in (want if isinstance(want, Mapping) else {"$eq": want}).items():
            number = isinstance(x, (int, float)) and not isinstance(x, bool)
            own, to = (cell.try_cast("double"), F.lit(float(x))) if number else (cell, F.lit(json.dumps(x) if isinstance(x, bool) else x))
            tests = {"$eq": own.eqNullSafe(to), "$ne": ~own.eqNullSafe(to)}
            if op not in tests:
                compare = {"$gt": own > to, "$gte": own >= to, "$lt": own < to, "$lte": own <= to}
                if op not in compare:
                    raise M.InvalidArgument(f"unknown operator {op!r}")
                tests[op] = F.coalesce(compare[op], F.lit(False))
            out = out & tests[op]
    return out


class SemanticStore:
    """Texts in, nearest texts out, over a store and an embedder."""

    def __init__(self, store, collection: str, embedder: Embedder):
        self.store, self.collection, self.embedder = store, collection, embedder

    def upsert_documents(self, documents: Sequence[Mapping]) -> int:
        """Documents with id and text, and perhaps metadata and namespace."""
        vectors = self.embedder.embed([d["text"] for d in documents])
        self.store.upsert(self.collection, [{**d, "vector": v, "payload": {"text": d["text"]}} for d, v in zip(documents, vectors)])
        return len(documents)

    def search(self, query: str, top_k: int = 10, **options) -> DataFrame:
        return self.store.open(self.collection).search(self.embedder.embed([query])[0], top_k=top_k, **options)
