"""Removal of byte strings that a document with a smaller id holds, by sorting sampled suffixes.

Sampling. Of each `width`-byte string the `gram` bytes with the least hash are its key, so equal strings have one key at one
offset. Neighbouring strings with the same key make a stretch. Only (key, name of the stretch, place) travel, to the key's
bucket. Stretches that a smaller document repeats whole end there: they are claims, compared byte by byte (`repeats.py`).

Sorting. The others whose key stands in several documents, at the ends of repeats, come back as text: per bucket the
stretches, each with its key as one symbol, make a string whose suffixes linear grouping construction sorts. Suffixes that
share a whole window stand side by side; the smallest document among them keeps its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Prefix, buckets, joined, mixed, slices, trim
from .gsaca import suffix_array
from .repeats import ANSWERS, FOUND, LOOK, MARK, ROW, SPANS, TOLD, fetched, numbers, opened, passed, rows, sent, spans_of, told_apart
from .spans import covered, doc_ids, merged, span_rows, texts_in_buckets, variants, with_spans

WIDTH, GRAM = 50, 20
SYMBOLS = 200_000
PIECE = 1 << 22
STEP = 2  # windows of a core


def stretches(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """(first window, windows, key's place) of each stretch of texts end to end, and the hash of any substring."""
    stretch, found = Prefix.of_bytes(data), [(np.zeros(0, np.int64),) * 3]
    for lo in range(0, max(len(data) - width + 1, 0), PIECE):  # windows that start in a piece; their keys' places fit 24 bits
        inner = np.clip(at - lo, 0, min(PIECE + width - 1, len(data) - lo))
        first, many, key = _stretches_of(inner, width, gram, lambda a, b, lo=lo: stretch(a + lo, b + lo))
        found.append((first + lo, many, key + lo))
    return (*(np.concatenate(x) for x in zip(*found)), stretch)


def _stretches_of(at: np.ndarray, width: int, gram: int, stretch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, span = int(at[-1]), width - gram + 1
    low = np.uint64((1 << 24) - 1)
    ranked = np.full(-(-(n - gram + 1) // span) * span, ~np.uint64(0))
    place = np.arange(n - gram + 1)
    ranked[: len(place)] = (stretch(place, place + gram) & ~low) | (place.astype(np.uint64) & low)  # ties to the left
    blocks = ranked.reshape(-1, span)
    ahead, behind = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - width + 1
    key = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & low
    many = np.maximum(np.diff(at) - width + 1, 0)
    window = np.repeat(at[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    key = key[window].astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1)
    cut = np.flatnonzero(new)
    return window[cut], np.diff(np.concatenate([cut, [len(window)]])), key[cut]


def _named(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of stretches of eight bytes or more: their bytes by eights, the last eight where fewer are left."""
    loads = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    last = end - 8
    name = mixed((end - start).astype(np.uint64))
    for j in range(0, int((end - start).max()), 8):
        name = joined(name, loads[np.minimum(start + j, last)])
    return name


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes data[a:a+size] and data[b:b+size] are equal, for each of many."""
    raw = data.tobytes()
    return np.fromiter((raw[x : x + n] == raw[y : y + n] for x, y, n in zip(a.tolist(), b.tolist(), size.tolist())), bool, len(a))


def _keyed(batch, data: np.ndarray, at: np.ndarray, width: int, gram: int, parts: int):
    """Stretches for the buckets of keys, and spans of those that a smaller document of the batch holds."""
    doc, var = doc_ids(batch.column("id")), variants(data, at)
    first, many, place, stretch = stretches(data, at, width, gram)
    if not len(first):
        return
    owner = np.searchsorted(at, first, "right") - 1
    sort = np.lexsort((first - at[owner], doc[owner]))
    first, many, place, owner = (x[sort] for x in (first, many, place, owner))
    key, off, size = stretch(place, place + gram), place - first, many - 1 + width
    name = _named(data, first, first + size)
    _, head, back = np.unique(name, return_index=True, return_inverse=True)
    lead = head[back]
    again = doc[owner] > doc[owner[lead]]
    if len(rest := np.flatnonzero(again)):
        again[rest] = (size[rest] == size[lead[rest]]) & _same(data, first[rest], first[lead[rest]], size[rest])
    own, out = first - at[owner], []
    if again.any():
        o = owner[again]
        out += [{**r, "part": r["bucket"]} for r in spans_of(doc[o], var[o], own[again], many[again], parts)]
    keep = np.flatnonzero(~again)
    out += sent(doc, var, owner[keep], own[keep], many[keep], off[keep], key[keep], name[keep], parts)
    yield pa.record_batch(rows(out, ("part", "kind", "bucket", "blob")))


def _repeated(marks: np.ndarray, body: np.ndarray, at: np.ndarray, keys: np.ndarray, width: int, gram: int, seen: set | None) -> tuple[np.ndarray, np.ndarray]:
    """(mark, window) of windows that a smaller document's stretch holds. `seen` has digests of the windows of smaller documents
    that an earlier string of the same key held, or is None where no string of the key comes before or after."""
    span, n = width - gram + 1, len(marks)  # a window is `span` symbols, its key being one
    size = np.diff(at)
    to = np.concatenate([[0], np.cumsum(size + 2)])  # with the key and an end
    symbols = np.zeros(to[-1], np.int64)
    off = marks["off"].astype(np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(at[:-1] - at[0], size)
    symbols[np.repeat(to[:-1], size) + inner + (inner >= np.repeat(off, size))] = body[at[0] : at[-1]].astype(np.int64) + 1
    symbols[to[:-1] + off] = 257 + np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
    many = marks["many"].astype(np.int64)
    mark = np.repeat(np.arange(n), many)
    window = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    owner = np.full(len(symbols), -1, np.int64)
    owner[to[mark] + window] = np.arange(len(mark))
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    starts = order[owner[order] >= 0]
    same = np.ones(max(len(starts) - 1, 0), bool)
    for j in range(span):
        same &= symbols[starts[1:] + j] == symbols[starts[:-1] + j]
    own = owner[starts]
    docs = marks["doc"][mark[own]]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.repeat(np.minimum.reduceat(docs, head), np.diff(np.concatenate([head, [len(docs)]])))
    hit = own[docs > least]
    if seen is not None:
        raw = symbols.astype("<u4").tobytes()  # the key's symbol is the same in every string of its own
        digest = [hashlib.blake2b(raw[4 * p : 4 * (p + span)], digest_size=16).digest() for p in starts.tolist()]
        hit = np.union1d(hit, own[np.fromiter((d in seen for d in digest), bool, len(digest))])
        seen.update(digest)
    return mark[hit], window[hit]


def _sorted(table: pa.Table, parts: int, width: int, gram: int, most: int = SYMBOLS) -> pa.Table:
    """A bucket's stretches: spans of the windows that a smaller document holds. Spans and answers pass through."""
    done = passed(table, ANSWERS, "bucket")
    got = [opened(b, "u1", "<u4", "u1") for b in table.filter(pa.array(table.column("kind").to_numpy() == LOOK)).column("blob").to_pylist()]
    if not got:
        return pa.table(rows(done, ("kind", "bucket", "blob")))
    marks = np.concatenate([numbers(m, MARK) for m, _, _ in got])
    body = np.concatenate([b for _, _, b in got])
    del got
    size = marks["many"].astype(np.int64) + (width - 1)
    begin = np.cumsum(size) - size + marks["off"]
    # the keys' own bytes tell keys apart; the rest of a stretch is what is left of them
    grams = np.empty((len(begin), gram), np.uint8)
    for j in range(gram):
        grams[:, j] = body[begin + j]
    _, head, back = np.unique(grams.view(f"V{gram}").ravel(), return_index=True, return_inverse=True)
    rank = np.empty(len(head), np.uint32)
    rank[np.lexsort((np.arange(len(head)), marks["key"][head]))] = np.arange(len(head))  # neighbours by hash have little in common
    marks["key"] = rank[back]
    del grams
    edge = np.zeros(len(body) + 1, np.int8)
    edge[begin] += 1
    edge[begin + gram] -= 1
    body = body[np.cumsum(edge[:-1], dtype=np.int8) == 0]
    at = np.concatenate([[0], np.cumsum(size - gram)])
    # neighbouring windows of a stretch share a core around the key; only those whose core stands in another document too
    # need be sorted
    beside = width - gram
    off, many, docs = marks["off"].astype(np.int64), marks["many"].astype(np.int64), marks["doc"]
    hashes, place = Prefix.of_bytes(body), at[:-1] + off
    skip, last = many.copy(), np.zeros(len(marks), np.int64)
    for l in range(0, beside + 1, STEP):  # windows with l to r bytes before the key
        r = min(l + STEP - 1, beside)
        able = np.flatnonzero((off >= l) & (off - many < r))
        core = mixed(hashes(place[able] - l, place[able] + beside - r) + mixed(marks["key"][able].astype(np.uint64)))
        by = np.argsort(core, kind="stable")
        if not len(by):
            continue
        head = np.flatnonzero(np.concatenate([[True], core[by[1:]] != core[by[:-1]]]))
        own = docs[able[by]]
        shared = np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head)
        met = able[by[np.repeat(shared, np.diff(np.append(head, len(by))))]]
        skip[met] = np.minimum(skip[met], np.maximum(off[met] - r, 0))
        last[met] = np.maximum(last[met], np.minimum(off[met] - l + 1, many[met]))
    order = np.flatnonzero(last > skip)
    order = order[np.lexsort((marks["place"][order], marks["doc"][order], marks["key"][order]))]
    if not len(order):
        return pa.table(rows(done, ("kind", "bucket", "blob")))
    marks_ = marks[order]
    marks_["place"] += skip[order].astype(np.uint32)
    marks_["off"] -= skip[order].astype(np.uint8)
    marks_["many"] = last[order] - skip[order]
    size = marks_["many"].astype(np.int64) + (beside - 1)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    body_ = body[np.repeat(at[order] + skip[order], size) + inner]
    at_ = np.concatenate([[0], np.cumsum(size)])
    out, lo, seen, seen_key = [], 0, None, None
    while lo < len(marks_):
        hi = max(lo + 1, int(np.searchsorted(at_, at_[lo] + most, "right")) - 1)
        key = marks_["key"][lo:hi]
        if hi < len(marks_):  # whole keys, and of a key too large for one string whole documents
            same = key == marks_["key"][hi]
            back = int(np.argmax(same)) if same[-1] else hi - lo
            if back:
                hi = lo + back
            else:
                last = marks_["doc"][hi - 1]
                while hi < len(marks_) and marks_["key"][hi] == key[0] and marks_["doc"][hi] == last:
                    hi += 1
            key = marks_["key"][lo:hi]
        goes_on = hi < len(marks_) and marks_["key"][hi] == key[0]
        if seen_key != key[0]:
            seen, seen_key = (set() if goes_on else None), key[0]
        part = marks_[lo:hi]
        m, w = _repeated(part, body_, at_[lo : hi + 1], key, width, gram, seen)
        out.append((part["doc"][m], part["var"][m], part["place"][m].astype(np.int64) + w))
        lo = hi
    doc, var, place = (np.concatenate(x) for x in zip(*out))
    sort = np.lexsort((place, var, doc))
    done += span_rows(merged(doc[sort], var[sort], place[sort]), parts, kind=SPANS)
    trim()
    return pa.table(rows(done, ("kind", "bucket", "blob")))


def without_shared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay), and the columns
    `carry`.

    A byte of a whole UTF-8 text goes if it lies in a `width`-byte string that also starts in a document with a smaller
    id; strings do not cross documents and are judged on the input. Null texts are empty; a null id counts as the
    largest. Rows that share an id are one document: none takes from the other. Repeated rows each come back; other
    columns are not read; an empty table gives an empty result. Kept bytes may cut characters; with `characters` those that
    are covered in part stay whole, and `kept` is valid UTF-8. No byte goes on the word of a hash: whole stretches are
    compared with their lead, windows by their place in the suffix order. `width` is 8 at least.
    """
    if width < 8 or gram >= width:
        raise ValueError("strings of 8 bytes or more, and a shorter gram")
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0]
    parts = buckets(df.sparkSession, size=size or 0)

    def emit(batches):
        for batch, data, at in slices(batches, "text"):
            yield from _keyed(batch, data, at, width, gram, parts)

    keyed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, ROW)
    told = keyed.groupBy("part").applyInArrow(lambda t: told_apart(t, parts, False), TOLD)
    texts = texts_in_buckets(df, id_col, text_col, parts, carry)
    found = texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(lambda t, m: fetched(t, m, width, parts, bytes, bytes), FOUND)
    known = found.groupBy("part").applyInArrow(lambda t: _sorted(t, parts, width, gram), TOLD)

    def fold(text: bytes, known: np.ndarray | None) -> tuple[int, int, int, bytes]:
        gone = covered(known, len(text), width)
        if gone is None:
            return len(text), 0, 0, text
        if characters:
            lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
            gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
        runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        return len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()

    fields = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    return with_spans(texts, known, df, bytes, width, fold, fields, "n_bytes long, n_removed long, n_spans long, kept binary", carry)
