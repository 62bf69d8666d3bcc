"""Quality scores of whole texts from document statistics and boosted trees.

Statistics are counted over every byte, word and line of a text, in numpy over many texts at once. The trees are fitted on
a bounded sample of labelled rows; every row is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, train
from .common import Prefix, kept, slices, words

MAX_TRAIN = 20_000
_MARKS = b"!#$%&*|.,;:?\"'()[]{}<>=_/\\@^~+-"
FEATURES = 14 + 12


def _class_table() -> np.ndarray:
    """Byte -> class: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 high, 7 sentence mark, 8 symbol, 9 bar, 10 bang, 11 control."""
    of = np.zeros(256, np.int64)
    of[:32] = 11
    of[97:123], of[65:91], of[48:58], of[32], of[9], of[10], of[128:] = 1, 2, 3, 4, 4, 5, 6
    of[list(_MARKS)] = 8
    of[list(b".,;:?")] = 7
    of[ord("|")], of[ord("!")] = 9, 10
    return of


_CLASS = _class_table()


def _per_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[before[1:]] - total[before[:-1]]).astype(float)


def _repeats(keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many distinct keys, and how often the most frequent one occurs."""
    n = len(before) - 1
    owner = np.repeat(np.arange(n), np.diff(before))
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(k)]]))
    distinct, most = np.bincount(o[at], minlength=n).astype(float), np.zeros(n)
    np.maximum.at(most, o[at], runs)
    return distinct, most


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """FEATURES numbers for each text; an empty text has zeros."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * 12 + _CLASS[data], minlength=12 * n).reshape(n, 12).astype(float)
    starts, ends, before = words(data, at)
    many = np.diff(before).astype(float)
    length = (ends - starts).astype(float)
    hashes = Prefix.of_bytes(data)
    keys = hashes(starts, ends)
    distinct, most = _repeats(keys, before)
    again = np.zeros(len(keys))
    again[1:] = keys[1:] == keys[:-1]
    again[before[:-1][before[:-1] < len(keys)]] = 0
    firsts, lasts = _CLASS[data[starts]], _CLASS[data[ends - 1]]
    seconds = _CLASS[data[np.minimum(starts + 1, ends - 1)]]
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1][size > 0], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    text_of = np.searchsorted(at, line_start, "right") - 1
    line_end = np.concatenate([line_start[1:], [len(data)]])[: len(line_start)]
    lines_before = np.searchsorted(line_start, at)
    line_kinds, line_most = _repeats(hashes(line_start, line_end), lines_before)
    lines = np.bincount(text_of, minlength=n).astype(float)
    mean = _per_text(length, before) / np.maximum(many, 1)
    spread = np.sqrt(np.maximum(_per_text(length**2, before) / np.maximum(many, 1) - mean**2, 0))
    out = [
        np.log1p(size), np.log1p(many), mean, spread, distinct / np.maximum(many, 1), most / np.maximum(many, 1),
        _per_text(again, before) / np.maximum(many, 1), _per_text(firsts == 2, before) / np.maximum(many, 1),
        _per_text((firsts == 2) & (seconds == 2), before) / np.maximum(many, 1), _per_text(lasts == 8, before) / np.maximum(many, 1),
        _per_text(lasts == 10, before) / np.maximum(many, 1), lines / np.maximum(many, 1), line_kinds / np.maximum(lines, 1), line_most / np.maximum(lines, 1),
    ]
    return np.column_stack([*out, kinds / np.maximum(size, 1)[:, None]]).astype(np.float32)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: str = "pmod(crc32(cast(id as string)), 5) = 0", threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: doc_id, held_out, score in 0..1 (higher: label 1 likelier), predicted (1 if score >= threshold).

    Only labelled rows that `held_out` (SQL over `id`) spares are learnt from, the `max_train` with the smallest hash of
    the id; a null id is never held out nor learnt from. Nothing but the text enters a score; a null text counts as
    empty. Null labels are skipped; without labels, or with one kind, every score is that share. Repeated rows each come
    back; other columns are not read; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def count(batches):
        for batch, data, at in slices(batches, "text"):
            x = statistics(data, at)
            yield pa.record_batch({"id": batch.column("id").cast(pa.int64()), "x": pa.array(list(x), pa.list_(pa.float32()))})

    found = kept(docs.mapInArrow(count, "id long, x array<float>").withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False))))
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null and id is not null")
    usable = marked.where(~F.coalesce(F.expr(held_out), F.lit(False)))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "y").limit(max_train)  # bounded
    sample = found.where("not held_out").join(F.broadcast(chosen), "id").select("x", "y").limit(2 * max_train).toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float32).reshape(-1, FEATURES)
    forest: Forest = train(x, sample.column("y").to_numpy().astype(float))
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                s = shared.value.score(x)
                yield pa.record_batch({"doc_id": batch.column("id"), "held_out": batch.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return found.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
