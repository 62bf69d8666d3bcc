"""Adapters to agent frameworks, made where their packages are installed; and the plain stores behind them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import functions as F

from .. import model as M
from ..operators import memory
from .store import Store


class TextStore:
    """Texts with metadata: add, search with scores, delete."""

    def __init__(self, store: Store, collection: str, embedder: memory.Embedder):
        self.store, self.collection, self.embedder = store, collection, embedder

    def add(self, texts: Sequence[str], metadatas: Sequence[Mapping] | None = None, ids: Sequence[str] | None = None) -> list[str]:
        ids = list(ids) if ids else [memory.item_id((), t) for t in texts]
        metadatas = metadatas or [{}] * len(texts)
        if not len(texts) == len(ids) == len(metadatas):
            raise M.InvalidArgument("texts, metadatas and ids differ in number")
        vectors = self.embedder.embed(list(texts))
        self.store.upsert(self.collection, [{"id": i, "vector": v, "text": t, "metadata": dict(m), "payload": {"text": t, "metadata": dict(m)}} for i, v, t, m in zip(ids, vectors, texts, metadatas)])
        return ids

    def search(self, query: str, k: int = 4, filter: Mapping | None = None) -> list[tuple[str, str, dict, float]]:
        """(id, text, metadata, score), best first."""
        rows = self.store.open(self.collection).search(self.embedder.embed([query])[0], top_k=k, filter=filter).collect()
        payloads = [json.loads(r["payload"]) for r in rows]
        return [(r["id"], p["text"], p["metadata"], r["score"]) for r, p in zip(rows, payloads)]

    def delete(self, ids: Iterable[str]) -> None:
        for i in ids:
            self.store.delete(self.collection, i)


def langchain_store(store: Store, collection: str, embedder: memory.Embedder):
    """A LangChain VectorStore over a collection."""
    from langchain_core.documents import Document
    from langchain_core.vectorstores import VectorStore

    plain = TextStore(store, collection, embedder)

    class Adapter(VectorStore):
        def add_texts(self, texts, metadatas=None, *, ids=None, **_):
            return plain.add(list(texts), metadatas, ids)

        def similarity_search_with_score(self, query, k=4, filter=None, **_):
            return [(Document(page_content=t, metadata=m, id=i), s) for i, t, m, s in plain.search(query, k, filter)]

        def similarity_search(self, query, k=4, **more):
            return [d for d, _ in self.similarity_search_with_score(query, k, **more)]

        def delete(self, ids=None, **_):
            plain.delete(ids or ())
            return True

        @classmethod
        def from_texts(cls, texts, embedding=None, metadatas=None, **_):
            out = cls()
            out.add_texts(texts, metadatas)
            return out

    return Adapter()


class ItemStore:
    """Values under (namespace path, key): put, get, search, list; a time to live in minutes."""

    def __init__(self, store: Store, collection: str, embedder: memory.Embedder, clock: Callable[[], float], fields: Sequence[str] = ("$",)):
        self.store, self.collection, self.embedder, self.clock, self.fields = store, collection, embedder, clock, fields

    def _text(self, value: Mapping, fields: Sequence[str]) -> str:
        return "\n".join(json.dumps(value, sort_keys=True) if f == "$" else str(value.get(f, "")) for f in fields)

    def _live(self):
        rows = self.store.records(self.collection)
        return rows.where(memory.unexpired(F.col("metadata")["expires_at"]["d"], int(self.clock())))

    def get(self, namespace: Sequence[str], key: str) -> dict | None:
        row = self._live().where((F.col("namespace") == "") & (F.col("id") == memory.item_id(namespace, key))).first()
        return None if row is None else json.loads(row["payload"])

    def put(self, namespace: Sequence[str], key: str, value: Mapping | None, ttl: float | None = None, index: Sequence[str] | None = None) -> None:
        """A null value deletes."""
        own = memory.item_id(namespace, key)
        if value is None:
            try:
                self.store.delete(self.collection, own)
            except M.NotFound:
                pass
            return
        now = self.clock()
        stamp = datetime.fromtimestamp(now, timezone.utc).isoformat()
        before = self.get(namespace, key)
        metadata = {f"ns_{i}": part for i, part in enumerate(namespace)} | {"ns_depth": len(namespace), "expires_at": memory.NEVER if ttl is None else int(now + 60 * ttl)}
        payload = {"namespace": list(namespace), "key": key, "value": dict(value), "created_at": (before or {}).get("created_at", stamp), "updated_at": stamp}
        self.store.upsert(self.collection, [{"id": own, "vector": self.embedder.embed([self._text(value, index or self.fields)])[0], "metadata": metadata, "payload": payload}])

    def search(self, prefix: Sequence[str] = (), query: str | None = None, conditions: Mapping | None = None, limit: int = 10, offset: int = 0) -> list[dict]:
        """Items below a namespace prefix: nearest to a query, or newest first."""
        value = F.get_json_object("payload", "$.value")
        if query is not None:
            wanted = offset + limit
            live = [{"expires_at": {"$gt": int(self.clock())}}, *({f"ns_{i}": part} for i, part in enumerate(prefix))]
            hits = self.store.open(self.collection).dense(self.embedder.embed([query])[0], min(wanted * (4 if conditions else 1), 1000), "", {"$and": live})
            order = [F.desc("score"), F.asc("id")]
        else:
            path = F.from_json(F.get_json_object("payload", "$.namespace"), "array<string>")
            hits = self._live().where(memory.path_matches(path, list(prefix)))
            order = [F.desc(F.get_json_object("payload", "$.updated_at")), F.asc("id")]
        rows = hits.where(memory.value_matches(value, conditions or {})).orderBy(*order).offset(offset).limit(limit).collect()
        return [json.loads(r["payload"]) | ({"score": r["score"]} if query is not None else {}) for r in rows]

    def namespaces(self, matches: Sequence[tuple[Sequence[str], bool]] = (), max_depth: int | None = None, limit: int = 100, offset: int = 0) -> list[tuple[str, ...]]:
        path = F.from_json(F.get_json_object("payload", "$.namespace"), "array<string>").alias("path")
        return [tuple(r["path"]) for r in memory.namespaces(self._live().select(path), "path", matches, max_depth, offset, limit).collect()]
