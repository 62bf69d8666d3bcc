"""Moving texts and spans between executors as few large rows.

Texts travel compressed, many to a row, to the bucket of their document; spans travel to the same buckets as packed arrays.
A document is told apart by its id and a hash of its text, so rows that share an id keep their own spans. A null id is
carried as the largest number and comes last in any order of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, slices

NO_ID = np.iinfo(np.int64).max
SPAN = np.dtype([("doc", "<i8"), ("var", "<u4"), ("first", "<u4"), ("last", "<u4")])


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<u8").tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = len(kinds)
    sizes = np.frombuffer(blob, "<u8", n, 8).astype(int)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def variants(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of each text's hash."""
    import xxhash

    raw, cut = memoryview(data.tobytes()), at.tolist()
    return np.fromiter((xxhash.xxh32_intdigest(raw[a:b]) for a, b in zip(cut, cut[1:])), np.uint32, len(cut) - 1)


def bucket_of(doc: np.ndarray, var: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64) + mixed(var.astype(np.uint64))) % np.uint64(buckets)).astype(np.int32)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indexes) of each bucket present; indexes keep their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def merged(doc: np.ndarray, var: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places in order of document and place -> spans of neighbouring ones."""
    if not len(place):
        return np.zeros(0, SPAN)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] > place[:-1] + 1) | (place[1:] < place[:-1]) | (doc[1:] != doc[:-1]) | (var[1:] != var[:-1])
    at = np.flatnonzero(new)
    out = np.zeros(len(at), SPAN)
    out["doc"], out["var"], out["first"], out["last"] = doc[at], var[at], place[at], place[np.concatenate([at[1:], [len(place)]]) - 1]
    return out


def span_rows(spans: np.ndarray, buckets: int, **fixed) -> Iterator[dict]:
    for bucket, rows in by_bucket(bucket_of(spans["doc"], spans["var"], buckets)):
        yield {**fixed, "bucket": bucket, "blob": spans[rows].tobytes()}


def texts_in_buckets(df: DataFrame, id_col: str, text_col: str, buckets: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, blob): compressed texts with their ids and the columns `carry`, a row for each bucket of a batch."""

    def send(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, data, at in slices(batches, "text", 1 << 22):
            doc, var, size = doc_ids(batch.column("id")), variants(data, at), np.diff(at)
            raw = data.tobytes()
            other = batch.select([f"c{i}" for i in range(len(carry))])
            out_bucket, out_blob = [], []
            for bucket, rows in by_bucket(bucket_of(doc, var, buckets)):
                body = b"".join(raw[at[i] : at[i + 1]] for i in rows.tolist())
                more = _ipc(other.take(pa.array(rows))) if carry else b""
                out_bucket.append(bucket)
                out_blob.append(squeeze.compress(pack(doc[rows], var[rows], size[rows], np.frombuffer(body, np.uint8), np.frombuffer(more, np.uint8))))
            yield pa.record_batch({"bucket": pa.array(out_bucket, pa.int32()), "blob": pa.array(out_blob, pa.binary())})

    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *columns).mapInArrow(send, "bucket int, blob binary")


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_texts(table: pa.Table, carried: list | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(doc, var, text) of each text in a bucket's rows; tables of carried columns, in the same order, go to `carried`."""
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    for blob in table.column("blob"):
        doc, var, size, body, more = unpack(open_.decompress(blob.as_py()), "<i8", "<u4", "<i8", "u1", "u1")
        if carried is not None and len(more):
            carried.append(pa.ipc.open_stream(more.tobytes()).read_all())
        raw, at = body.tobytes(), np.concatenate([[0], np.cumsum(size)]).tolist()
        for i, (d, v) in enumerate(zip(doc.tolist(), var.tolist())):
            yield d, v, raw[at[i] : at[i + 1]]


def read_spans(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """(doc, var) -> its spans in order."""
    blobs = table.column("blob").to_pylist()
    if not blobs:
        return {}
    spans = np.sort(np.concatenate([np.frombuffer(b, SPAN) for b in blobs]), order=["doc", "var", "first"])
    cut = np.flatnonzero((np.diff(spans["doc"]) != 0) | (np.diff(spans["var"].astype(np.int64)) != 0)) + 1
    return {(int(s["doc"][0]), int(s["var"][0])): s for s in np.split(spans, cut) if len(s)}


def covered(spans: np.ndarray | None, size: int, reach: int) -> np.ndarray | None:
    """Which of `size` places the spans cover, if each of a span's places covers `reach` from itself on."""
    if spans is None:
        return None
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, spans["first"].astype(np.int64), 1)
    np.add.at(edge, np.minimum(spans["last"].astype(np.int64) + reach, size), -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(texts: DataFrame, known: DataFrame, df: DataFrame, units: Callable, width: int, fold: Callable, fields: dict[str, pa.DataType], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts in buckets (`texts_in_buckets` of df) meet what is known of their spans, (kind, bucket, blob): spans, and answers
    to claims. fold(units of a text, spans or None) gives the columns `fields` of each text, which come after doc_id and
    before the columns `carry` of its row."""
    from .repeats import ANSWERS, SPANS, Answers

    def meet(texts: pa.Table, marks: pa.Table) -> pa.Table:
        kind = marks.column("kind").to_numpy()
        found = read_spans(marks.filter(pa.array(kind == SPANS)))
        answers = Answers(marks.filter(pa.array(kind == ANSWERS)).column("blob").to_pylist(), units)
        ids, rows, others = [], [], []
        for doc, var, text in read_texts(texts, others):
            ids.append(None if doc == NO_ID else doc)
            own, spans = units(text), found.get((doc, var))
            if len(more := answers.spans(doc, var, own, width)):
                spans = more if spans is None else np.concatenate([spans, more])
            rows.append(fold(own, spans))
        cols = list(zip(*rows)) or [[]] * len(fields)
        out = pa.table({"doc_id": pa.array(ids, pa.int64()), **{n: pa.array(c, k) for (n, k), c in zip(fields.items(), cols)}})
        if carry and others:
            joined = pa.concat_tables(others)
            for i, name in enumerate(carry):
                out = out.append_column(name, joined.column(f"c{i}"))
        elif carry:
            kinds = pa.schema([pa.field(c, k) for c, k in carried_types])
            for name in carry:
                out = out.append_column(name, pa.array([], kinds.field(name).type))
        return out

    from pyspark.sql.pandas.types import to_arrow_type

    carried_types = [(c, to_arrow_type(df.schema[c].dataType)) for c in carry]
    more = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return texts.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(meet, f"doc_id long, {schema}{more}")
