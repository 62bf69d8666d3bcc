"""Stretches of windows that repeat: revealed by key and name, held against the text itself before anything is removed.

A stretch is a run of neighbouring windows with one key. (key, name of the whole stretch, place) travel to the key's bucket.
There a stretch with the name of an earlier one becomes a claim on that one, its lead; the others of a key that several
names share must be looked at as text. Both go to the buckets of the documents. The lead's bucket answers a claim with the
lead's text, which the bucket of the claiming document compares unit by unit: names only find repeats, text decides.

A unit is a word or a byte. `units` cuts a text into them, `whole` puts them together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import trim
from .spans import SPAN, by_bucket, bucket_of, merged, pack, read_texts, span_rows, unpack

ROW = "part int, kind int, bucket int, blob binary"
TOLD = "kind int, bucket int, blob binary"
FOUND = "kind int, part int, blob binary"
STRETCHES, SPANS, LOOK, CLAIMS, ANSWERS = range(5)
MARK = np.dtype([("doc", "<i8"), ("var", "<u4"), ("place", "<u4"), ("part", "<i4"), ("key", "<u4"), ("many", "u1"), ("off", "u1")])
CLAIM = np.dtype([("doc", "<i8"), ("var", "<u4"), ("place", "<u4"), ("many", "u1"), ("lead", "<i8"), ("lead_var", "<u4"), ("lead_place", "<u4")])


def rows(out: list[dict], names: tuple[str, ...]) -> dict[str, pa.Array]:
    kinds = {"part": pa.int32(), "kind": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}
    return {n: pa.array([r[n] for r in out], kinds[n]) for n in names}


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first bytes first: they compress better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T)


def numbers(planes: np.ndarray, kind) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeezed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pack(*arrays))


def opened(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    return unpack(zstandard.ZstdDecompressor().decompress(blob), *kinds)


def structs(blob: bytes, kind: np.dtype) -> np.ndarray:
    """Records written by `squeezed(planes(records))`."""
    return numbers(opened(blob, "u1")[0], kind)


def passed(table: pa.Table, least: int, to: str) -> list[dict]:
    """The rows of spans, and of answers if `least` is theirs, for the bucket that they are meant for."""
    kind, blobs = table.column("kind").to_numpy(), table.column("blob")
    at = table.column("bucket" if "bucket" in table.column_names else "part").to_numpy()
    return [{"kind": int(kind[i]), to: int(at[i]), "blob": blobs[int(i)].as_py()} for i in np.flatnonzero((kind == SPANS) | (kind == least))]


def spans_of(doc: np.ndarray, var: np.ndarray, place: np.ndarray, many: np.ndarray, parts: int):
    """Rows for the buckets of documents: every window of stretches in order of document and place."""
    n = many.astype(np.int64)
    windows = np.repeat(place.astype(np.int64), n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return span_rows(merged(np.repeat(doc, n), np.repeat(var, n), windows), parts, kind=SPANS)


def sent(doc: np.ndarray, var: np.ndarray, owner: np.ndarray, place: np.ndarray, many: np.ndarray, off: np.ndarray, key: np.ndarray, name: np.ndarray, parts: int) -> list[dict]:
    """Stretches in order of document for the buckets of their keys; `owner` is their text's index in `doc` and `var`."""
    out = []
    for part, mine in by_bucket(((key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32)):
        o = owner[mine]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1])
        counts = np.diff(np.concatenate([cut, [len(o)]])).astype("<u4")
        small = squeezed(planes(doc[o[cut]].astype("<i8")), var[o[cut]], planes(counts), planes(place[mine].astype("<u4")), many[mine].astype("u1"), off[mine].astype("u1"))
        blob = pack(np.frombuffer(small, np.uint8), (key[mine] >> np.uint64(32)).astype("<u4"), name[mine].astype("<u8"))
        out.append({"part": part, "kind": STRETCHES, "bucket": -1, "blob": blob})
    return out


def _received(blob: bytes) -> tuple[np.ndarray, ...]:
    small, key, name = unpack(blob, "u1", "<u4", "<u8")
    doc, var, counts, place, many, off = opened(small.tobytes(), "u1", "<u4", "u1", "u1", "u1", "u1")
    counts = numbers(counts, "<u4")
    return np.repeat(numbers(doc, "<i8"), counts), np.repeat(var, counts), numbers(place, "<u4"), many, off, key, name


def told_apart(table: pa.Table, parts: int, within: bool) -> pa.Table:
    """A bucket of keys: claims of stretches that have the name of an earlier one, for the bucket of that one's document, and
    marks of those that must be looked at as text. Spans known before pass through. `within`: a stretch of the same document
    counts as earlier too, if it starts before."""
    kind, blobs = table.column("kind").to_numpy(), table.column("blob")
    out = passed(table, SPANS, "bucket")
    mine = [_received(blobs[int(i)].as_py()) for i in np.flatnonzero(kind == STRETCHES)]
    if mine:
        doc, var, place, many, off, key, name = (np.concatenate(x) for x in zip(*mine))
        del mine
        order = np.lexsort((place, doc, name, key) if within else (doc, name, key))
        doc, var, place, many, off, key, name = (x[order] for x in (doc, var, place, many, off, key, name))
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_name = new_key.copy()
        new_name[1:] |= name[1:] != name[:-1]
        keys = np.flatnonzero(new_key)
        lead = np.flatnonzero(new_name)[np.cumsum(new_name) - 1]
        again = doc > doc[lead]
        if within:
            again |= place != place[lead]
        several = np.add.reduceat(new_name.astype(np.int64), keys) > 1
        if not within:
            several &= np.maximum.reduceat(doc, keys) > np.minimum.reduceat(doc, keys)
        look = np.flatnonzero(~again & several[np.cumsum(new_key) - 1])
        hit = np.flatnonzero(again)
        claims = np.zeros(len(hit), CLAIM)
        for n, x in (("doc", doc), ("var", var), ("place", place), ("many", many)):
            claims[n] = x[hit]
        for n, x in (("lead", doc), ("lead_var", var), ("lead_place", place)):
            claims[n] = x[lead[hit]]
        for bucket, some in by_bucket(bucket_of(claims["lead"], claims["lead_var"], parts)):
            some = some[np.lexsort((claims["lead_place"][some], claims["doc"][some], claims["lead"][some]))]
            out.append({"kind": CLAIMS, "bucket": bucket, "blob": squeezed(planes(claims[some]))})
        marks = np.zeros(len(look), MARK)
        for n, x in (("doc", doc), ("var", var), ("place", place), ("key", key), ("many", many), ("off", off)):
            marks[n] = x[look]
        marks["part"] = table.column("part")[0].as_py()
        for bucket, some in by_bucket(bucket_of(marks["doc"], marks["var"], parts)):
            out.append({"kind": LOOK, "bucket": bucket, "blob": squeezed(planes(marks[some]))})
        del doc, var, place, many, off, key, name, order, claims, marks
    trim()
    return pa.table(rows(out, ("kind", "bucket", "blob")))


def _runs(claims: np.ndarray, width: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Claims sorted by where the answer goes and by lead; the run of neighbouring stretches of a lead that each is part of;
    (first unit, end) of the runs."""
    to = bucket_of(claims["doc"], claims["var"], parts)
    claims = claims[order := np.lexsort((claims["lead_place"], claims["lead_var"], claims["lead"], to))]
    to = to[order]
    group = np.ones(len(claims), bool)
    group[1:] = (to[1:] != to[:-1]) | (claims["lead"][1:] != claims["lead"][:-1]) | (claims["lead_var"][1:] != claims["lead_var"][:-1])
    base = np.cumsum(group) << 34
    first = claims["lead_place"].astype(np.int64)
    end = np.maximum.accumulate(base + first + claims["many"] - 1 + width)
    new = group.copy()
    new[1:] |= (base + first)[1:] > end[:-1]
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(claims)]]) - 1
    return claims, np.cumsum(new) - 1, np.stack([first[heads], (end - base)[tails]], 1)


def fetched(texts: pa.Table, marks: pa.Table, width: int, parts: int, units: Callable, whole: Callable) -> pa.Table:
    """A bucket of documents: the text of marked stretches for the buckets of their keys, and the text of claimed leads for
    the buckets of the documents that claim them. Spans pass through."""
    kind, blobs = marks.column("kind").to_numpy(), marks.column("blob")
    out = passed(marks, SPANS, "part")
    look = [structs(blobs[int(i)].as_py(), MARK) for i in np.flatnonzero(kind == LOOK)]
    look = np.sort(np.concatenate(look), order=["doc", "var", "place"]) if look else np.zeros(0, MARK)
    claims = [structs(blobs[int(i)].as_py(), CLAIM) for i in np.flatnonzero(kind == CLAIMS)]
    claims, run, reach = _runs(np.concatenate(claims), width, parts) if claims else (np.zeros(0, CLAIM), np.zeros(0, np.int64), np.zeros((0, 2), np.int64))
    heads = np.searchsorted(run, np.arange(len(reach)))
    wanted: dict[tuple[int, int], tuple[list, list]] = {}
    cut = np.flatnonzero((np.diff(look["doc"]) != 0) | (np.diff(look["var"].astype(np.int64)) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(look)]):
        if b > a:
            wanted.setdefault((int(look["doc"][a]), int(look["var"][a])), ([], []))[0].append((a, b))
    for r, (d, v) in enumerate(zip(claims["lead"][heads].tolist(), claims["lead_var"][heads].tolist())):
        wanted.setdefault((d, v), ([], []))[1].append(r)
    bodies: list[bytes] = [b""] * len(look)
    leads: list[bytes] = [b""] * len(reach)
    spots, sizes, bounds = look["place"].tolist(), look["many"].tolist(), reach.tolist()
    for doc, var, text in read_texts(texts):
        if (asked := wanted.pop((doc, var), None)) is None:  # repeated rows are looked at once
            continue
        own = units(text)
        for a, b in asked[0]:
            for i in range(a, b):
                bodies[i] = whole(own[spots[i] : spots[i] + sizes[i] - 1 + width])
        for r in asked[1]:
            leads[r] = whole(own[bounds[r][0] : bounds[r][1]])
    for part, mine in by_bucket(look["part"]):
        own = [bodies[i] for i in mine.tolist()]
        out.append({"kind": LOOK, "part": part, "blob": squeezed(planes(look[mine]), np.array([len(x) for x in own], "<u4"), np.frombuffer(b"".join(own), np.uint8))})
    if len(claims):
        to = bucket_of(claims["doc"], claims["var"], parts)
        for bucket, mine in by_bucket(to):
            lo, hi = int(run[mine[0]]), int(run[mine[-1]]) + 1  # runs of one bucket are neighbours
            own = leads[lo:hi]
            cells = (planes(claims[mine]), (run[mine] - lo).astype("<u4"), reach[lo:hi, 0].astype("<i8"), np.array([len(x) for x in own], "<u4"), np.frombuffer(b"".join(own), np.uint8))
            out.append({"kind": ANSWERS, "part": bucket, "blob": squeezed(*cells)})
    del bodies, leads
    trim()
    return pa.table(rows(out, ("kind", "part", "blob")))


class Answers:
    """What a bucket of documents got for its claims: spans of windows that the leads' text bears out."""

    def __init__(self, blobs: list[bytes], units: Callable):
        self.leads: list = []
        self.units = units
        self.of: dict[tuple[int, int], list] = {}
        self.cut: dict[int, object] = {}
        if not blobs:
            return
        starts, claims, run = [], [], []
        for blob in blobs:
            c, r, first, size, body = opened(blob, "u1", "<u4", "<i8", "<u4", "u1")
            claims.append(numbers(c, CLAIM))
            run.append(r.astype(np.int64) + len(self.leads))
            starts.append(first)
            raw, at = body.tobytes(), np.concatenate([[0], np.cumsum(size.astype(np.int64))]).tolist()
            self.leads += [raw[a:b] for a, b in zip(at, at[1:])]
        claims, run, starts = np.concatenate(claims), np.concatenate(run), np.concatenate(starts)
        shift = claims["lead_place"].astype(np.int64) - starts[run]
        order = np.lexsort((claims["place"], claims["var"], claims["doc"]))
        claims, run, shift = claims[order], run[order], shift[order]
        first, end = claims["place"].astype(np.int64), claims["place"].astype(np.int64) + claims["many"]
        new = np.ones(len(claims), bool)  # neighbours on neighbours of one lead are compared at once
        new[1:] = (claims["doc"][1:] != claims["doc"][:-1]) | (claims["var"][1:] != claims["var"][:-1]) | (run[1:] != run[:-1]) | (first[1:] != end[:-1]) | ((shift - first)[1:] != (shift - first)[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(claims)]]).astype(np.int64) - 1
        for d, v, a, b, r, s in zip(claims["doc"][head].tolist(), claims["var"][head].tolist(), first[head].tolist(), end[tail].tolist(), run[head].tolist(), shift[head].tolist()):
            self.of.setdefault((d, v), []).append((a, b, r, s))

    def spans(self, doc: int, var: int, own, width: int) -> np.ndarray:
        found = self.of.get((doc, var), ())
        out = np.zeros(len(found), SPAN)
        for i, (a, b, r, s) in enumerate(found):
            if (lead := self.cut.get(r)) is None:
                lead = self.cut[r] = self.units(self.leads[r])
            n = b - a - 1 + width
            if own[a : a + n] != lead[s : s + n]:
                raise ValueError("two stretches of one name and key differ: 96 bits of hash have met")
            out[i] = doc, var, a, b - 1
        return out
