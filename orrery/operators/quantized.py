"""Search over compressed vectors: candidates by codes, then exact scores.

Sign codes are expressions. Product quantization trains its codebooks on a bounded sample and scores by table look-up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

CENTROIDS = 256
ROUNDS = 12
SAMPLE = 16_384
LEAST_ROWS = 1024


def with_sign_codes(records: DataFrame, dimension: int, column: str = "vector", codes: str = "codes") -> DataFrame:
    return records.withColumn(codes, V.sign_words(F.col(column), dimension))


def sign_candidates(records: DataFrame, query: Sequence[float], count: int, column: str = "vector", codes: Column | None = None) -> DataFrame:
    """The `count` records nearest by Hamming distance of sign codes; ties by key."""
    asked = V.sign_words(V.literal(query), len(query))
    own = V.sign_words(F.col(column), len(query)) if codes is None else codes
    return records.withColumn("_near", V.hamming(own, asked)).orderBy("_near", "namespace", "id").limit(count).drop("_near")


def int8_scores(records: DataFrame, query: Sequence[float], column: str = "vector") -> DataFrame:
    """Adds `score`, the dot product of symmetric 8-bit codes."""
    scale = V.int8_scale(F.col(column))
    q = V.literal(query)
    q_scale = V.int8_scale(q)
    return records.withColumn("score", V.int8_dot(V.int8_codes(F.col(column), scale), scale, V.int8_codes(q, q_scale), q_scale))


@dataclass(frozen=True)
class Codebook:
    """[subspace, centroid, component]; `cosine` books hold unit vectors."""

    centroids: np.ndarray
    cosine: bool

    @property
    def width(self) -> int:
        return self.centroids.shape[2]

    def prepared(self, x: np.ndarray) -> np.ndarray:
        if not self.cosine:
            return x
        norm = np.sqrt((x * x).sum(-1, keepdims=True))
        return x / np.where(norm == 0, 1, norm)

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = self.prepared(x).reshape(len(x), len(self.centroids), self.width)
        out = np.empty(parts.shape[:2], np.uint8)
        for s, book in enumerate(self.centroids):
            out[:, s] = ((book * book).sum(1)[None] - 2 * parts[:, s] @ book.T).argmin(1)
        return out

    def table(self, query: Sequence[float], metric: str) -> np.ndarray:
        """[subspace, centroid]: what a code adds to the score."""
        q = self.prepared(np.asarray(query, float)[None])[0].reshape(len(self.centroids), self.width)
        if metric == "l2":
            return -((self.centroids - q[:, None]) ** 2).sum(2)
        return (self.centroids * q[:, None]).sum(2)


def train_codebook(records: DataFrame, subspaces: int, metric: str, column: str = "vector", sample: int = SAMPLE, seed: int = 42) -> Codebook:
    """Lloyd's rounds on the `sample` records with the smallest key hash; a bounded sample reaches the driver."""
    rows = records.where(F.col(column).isNotNull()).orderBy(F.xxhash64("namespace", "id"), "namespace", "id").select(column).limit(sample).collect()
    x = np.array([r[0] for r in rows], float)
    book = Codebook(np.zeros((subspaces, 0, x.shape[1] // subspaces)), metric == "cosine")
    parts = book.prepared(x).reshape(len(x), subspaces, -1)
    draw = np.random.default_rng(seed)
    out = []
    for s in range(subspaces):
        p = parts[:, s]
        c = p[draw.choice(len(p), min(CENTROIDS, len(p)), replace=False)]
        for _ in range(ROUNDS):
            own = ((c * c).sum(1)[None] - 2 * p @ c.T).argmin(1)
            n = np.bincount(own, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, own, p)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return Codebook(np.stack(out), metric == "cosine")


def with_pq_codes(records: DataFrame, book: Codebook, column: str = "vector", codes: str = "codes") -> DataFrame:
    """Adds a binary column with a byte per subspace."""
    shared = records.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series([c.tobytes() for c in shared.value.encode(np.stack(vectors.to_numpy()).astype(float))])

    return records.withColumn(codes, encode(F.col(column)))


def pq_candidates(coded: DataFrame, book: Codebook, query: Sequence[float], metric: str, count: int, codes: str = "codes") -> DataFrame:
    """The `count` records best by table look-up; ties by key."""
    shared = coded.sparkSession.sparkContext.broadcast(book.table(query, metric))

    @F.pandas_udf("double")
    def score(codes: pd.Series) -> pd.Series:
        if not len(codes):
            return pd.Series([], dtype=float)
        own = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        return pd.Series(shared.value[np.arange(own.shape[1])[None], own].sum(1))

    return coded.withColumn("_near", score(F.col(codes))).orderBy(F.desc("_near"), "namespace", "id").limit(count).drop("_near")


def component_ranges(records: DataFrame, column: str = "vector") -> DataFrame:
    """(at, low, step): the least value of each component and the width of its 255 steps; a row a component."""
    each = records.where(F.col(column).isNotNull()).select(F.posexplode(F.col(column).cast("array<double>")).alias("at", "x"))
    return each.groupBy("at").agg(F.min("x").alias("low"), ((F.max("x") - F.min("x")) / 255).alias("step"))


def with_component_codes(records: DataFrame, ranges: DataFrame, column: str = "vector", codes: str = "codes") -> DataFrame:
    """Adds 0..255 for each component by its range; components that do not vary are 0."""
    rows = ranges.orderBy("at").collect()  # one a dimension
    low, step = F.array(*[F.lit(r["low"]) for r in rows]), F.array(*[F.lit(r["step"]) for r in rows])
    code = F.transform(F.arrays_zip(F.col(column).cast("array<double>").alias("x"), low.alias("l"), step.alias("s")), lambda c: F.when(c["s"] == 0, 0).otherwise(F.round((c["x"] - c["l"]) / c["s"]).cast("int")).cast("smallint"))
    return records.withColumn(codes, code)
