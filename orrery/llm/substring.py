"""Removal of repeated word windows: keys by recompression; claims and windows of a key are held against the words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Names, buckets, equal_pieces, mixed, piece_keys, slices, words
from .recompression import keys
from .repeats import ANSWERS, FOUND, LOOK, MARK, ROW, SPANS, TOLD, fetched, numbers, opened, passed, rows, sent, spans_of, told_apart
from .spans import covered, doc_ids, merged, span_rows, texts_in_buckets, variants, with_spans

WIDTH = 20
ROUNDS = 4


def _same(ids: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ids[a:a+size] and ids[b:b+size] are equal, for each of many (of size 1 at least)."""
    at = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(at, size)
    return np.logical_and.reduceat(ids[np.repeat(a, size) + inner] == ids[np.repeat(b, size) + inner], at)


def _keyed(batch, data: np.ndarray, at: np.ndarray, width: int, rounds: int, parts: int):
    """Stretches for the buckets of keys, and spans of those that repeat one of the batch."""
    doc, var = doc_ids(batch.column("id")), variants(data, at)
    starts, ends, before = words(data, at)
    if not len(starts):
        return
    key_of = piece_keys(data, starts, ends)
    ids, _ = equal_pieces(data, starts, ends, key_of)
    value = mixed(key_of)
    text = np.repeat(np.arange(len(doc)), np.diff(before))
    first, many, low, high = keys(value, text, before, width, rounds)
    if not len(first):
        return
    owner = text[first]
    sort = np.lexsort((first - before[owner], doc[owner]))
    first, many, low, high, owner = (x[sort] for x in (first, many, low, high, owner))
    stretch = Names(value, 2 * width)
    key, size = stretch(low, high), many - 1 + width
    name = stretch(first, first + size)
    place = first - before[owner]
    # equal stretches of one batch: the ids of their words tell, and only the first travels
    _, head, back = np.unique(name, return_index=True, return_inverse=True)
    lead = head[back]
    again = (doc[owner] != doc[owner[lead]]) | (place != place[lead])
    if len(rest := np.flatnonzero(again)):
        same = size[rest] == size[lead[rest]]
        rest = rest[same]
        again[:] = False
        if len(rest):
            again[rest[_same(ids, first[rest], first[lead[rest]], size[rest])]] = True
    out = []
    if again.any():
        o = owner[again]
        out += [{**r, "part": r["bucket"]} for r in spans_of(doc[o], var[o], place[again], many[again], parts)]
    keep = np.flatnonzero(~again)
    out += sent(doc, var, owner[keep], place[keep], many[keep], (low - first)[keep], key[keep], name[keep], parts)
    yield pa.record_batch(rows(out, ("part", "kind", "bucket", "blob")))


def _compared(table: pa.Table, parts: int, width: int) -> pa.Table:
    """The stretches of a bucket of keys as text: windows that are equal to one that starts earlier. Spans and answers pass
    through."""
    out = passed(table, ANSWERS, "bucket")
    got = [opened(b, "u1", "<u4", "u1") for b in table.filter(pa.array(table.column("kind").to_numpy() == LOOK)).column("blob").to_pylist()]
    if not got:
        return pa.table(rows(out, ("kind", "bucket", "blob")))
    marks = np.concatenate([numbers(m, MARK) for m, _, _ in got])
    size = np.concatenate([n for _, n, _ in got]).astype(np.int64)
    at = np.cumsum(size) - size
    raw = b"".join(b.tobytes() for _, _, b in got)
    del got
    order = np.lexsort((marks["place"], marks["doc"], marks["key"]))
    marks, at, size = marks[order], at[order].tolist(), size[order].tolist()
    hits, last, seen = [], None, {}
    for i, (key, doc, place, many) in enumerate(zip(marks["key"].tolist(), marks["doc"].tolist(), marks["place"].tolist(), marks["many"].tolist())):
        if key != last:
            last, seen = key, {}
        own = raw[at[i] : at[i] + size[i]].split(b" ")
        for j in range(many):
            here = (doc, place + j)
            if seen.setdefault(b" ".join(own[j : j + width]), here) != here:
                hits.append((i, place + j))
    if hits:
        i, place = (np.array(x, np.int64) for x in zip(*hits))
        doc, var = marks["doc"][i], marks["var"][i]
        sort = np.lexsort((place, var, doc))
        out += span_rows(merged(doc[sort], var[sort], place[sort]), parts, kind=SPANS)
    return pa.table(rows(out, ("kind", "bucket", "blob")))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept: the words that stay, one space between them, as UTF-8 bytes.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A word goes if it lies in a window of `width` words that also starts
    earlier: in a document with a smaller id, or earlier in the same. Null and blank texts have no words; a null id counts
    as the largest. Rows that share an id are judged alike and each come back, and none is a repeat of the other at the
    same place. Other columns are not read; an empty table gives an empty result. `rounds` of recompression trade key size
    against windows without a symbol of their own, which are their own key: the result is the same. No word goes on the
    word of a hash: repeats are compared word by word.
    """
    parts = buckets(df.sparkSession)

    def emit(batches):
        for batch, data, at in slices(batches, "text"):
            yield from _keyed(batch, data, at, width, rounds, parts)

    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, ROW)
    told = keyed.groupBy("part").applyInArrow(lambda t: told_apart(t, parts, True), TOLD)
    texts = texts_in_buckets(df, id_col, text_col, parts)
    found = texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lambda t, m: fetched(t, m, width, parts, bytes.split, b" ".join), FOUND)
    known = found.groupBy("part").applyInArrow(lambda t: _compared(t, parts, width), TOLD)

    def fold(own: list[bytes], spans: np.ndarray | None) -> tuple[int, int, bytes]:
        gone = covered(spans, len(own), width)
        if gone is None:
            return len(own), 0, b" ".join(own)
        return len(own), int(gone.sum()), b" ".join([own[i] for i in np.flatnonzero(~gone).tolist()])

    fields = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.binary()}
    return with_spans(texts, known, df, bytes.split, width, fold, fields, "n_words long, n_removed long, kept binary")
