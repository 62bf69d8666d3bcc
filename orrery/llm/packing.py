"""Sequence packing by best-fit decreasing.

Each text is tokenized once, where it is read, and cut: full windows first, then the rest. Only piece lengths travel: a
piece is a row of a few numbers. Pieces are dealt into groups by hash; within a group the rests are placed longest first
into the open window with the least sufficient room, which a segment tree indexed by remaining capacity finds.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

GROUP = 50_000  # texts whose pieces are packed together


@lru_cache(maxsize=2)
def encoder(name: str):
    """text -> ids as the tokenizers library gives them for a byte-level vocabulary.

    `name.tiktoken` beside `name.json` holds the same vocabulary as ranks; ids are equal, several times faster. Texts
    that hold the special token's string go through the JSON file's own handling.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    plain = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))

    def encode(text: str) -> list[int]:
        if any(t in text for t in special):
            return plain().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class BestFit:
    """Open windows by remaining capacity; a segment tree over 1..size finds the tightest that fits."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def _add(self, room: int, change: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += change
            i >>= 1

    def _tightest(self, least: int) -> int:
        """Smallest capacity >= least that an open window has; -1 if none."""
        i, count = least + self.leaves, self.count
        if count[i]:
            return least
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece."""
        room = self._tightest(length)
        if room < 0:
            window, room = self.windows, self.size
            self.windows += 1
        else:
            window = self.open[room].pop()
            self._add(room, -1)
        if left := room - length:
            self.open[left].append(window)
            self._add(left, 1)
        return window, self.size - room


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int, end_id: int | None) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens: full windows, then the rest of each text."""

    def cut(batches):
        encode = encoder(vocabulary)
        for batch, data, at in slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "")
                if end_id is not None:
                    ids.append(end_id)
                raw, n = np.array(ids, "<u4"), len(ids)
                out += [(doc, s, min(size, n - s), zlib.crc32(raw[s : s + size].tobytes()), n) for s in range(0, n, size)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch({k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), cols)})

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", size: int = 1024, end_id: int | None = 0, groups: int | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are those of the whole text, then `end_id` (None: nothing). A null or empty text is its end id alone (no piece
    where there is none). Full windows are sequences of their own; the rests share sequences within a group. A sequence's
    pieces lie gapless from offset 0. `groups` bounds what one task packs: one for each GROUP rows if None, whatever the
    session's settings are, so that few sequences stay open.
    Repeated rows and rows with a null id are packed like any others; other columns are not read; an empty table gives an
    empty result. The same table gives the same packing.
    """
    groups = groups or 1 + df.count() // GROUP
    cut = pieces(df, id_col, text_col, vocabulary, size, end_id).withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        base = table.column("grp")[0].as_py() << 40
        fit = BestFit(size)
        spots = [fit.place(n) for n in table.column("length").to_pylist()]
        windows, offsets = zip(*spots)
        out = table.drop_columns(["grp"])
        out = out.append_column("sequence_id", pa.array([base + w for w in windows], pa.int64()))
        return out.append_column("offset", pa.array(offsets, pa.int64()))

    return cut.groupBy("grp").applyInArrow(place, schema)
