"""Vector scalar functions as Columns; scores grow with nearness.

Float inputs are scored in double precision. Queries are literals whose norms are worked out once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(doubles(a), lambda x: x * x))


def l2(a: Column, b: Column) -> Column:
    """Minus the squared distance."""
    return -total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Zero if either norm is zero; squared norms may be given."""
    norms = (squared_norm(a) if norm_a is None else norm_a) * (squared_norm(b) if norm_b is None else norm_b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(norms))


def similarity(metric: str, a: Column, b: Column, norm_b: float | None = None) -> Column:
    if metric == "dot":
        return dot(a, b)
    if metric == "l2":
        return l2(a, b)
    return cosine(a, b, norm_b=None if norm_b is None else F.lit(norm_b))


def to_query(metric: str, column: Column, query: Sequence[float]) -> Column:
    """A column's similarity to a literal query."""
    return similarity(metric, column, literal(query), math.fsum(float(x) ** 2 for x in query))


def normalized_score(metric: str, score: Column) -> Column:
    """A similarity in 0..1 for fusion."""
    if metric == "l2":
        return 1 / (1 - score)
    if metric == "dot":
        return 1 / (1 + F.exp(-score))
    return (score + 1) / 2


def sparse_norm(weights: Column) -> Column:
    return F.sqrt(squared_norm(F.map_values(weights)))


def sparse_cosine(weights: Column, query: dict[str, float]) -> Column:
    """Cosine of a term-weight map and a query; zero without common terms or norms."""
    own = sparse_norm(weights)
    size = math.sqrt(math.fsum(w * w for w in query.values()))
    meet = F.lit(0.0)
    for term, weight in sorted(query.items()):
        meet = meet + F.coalesce(weights[term].cast("double"), F.lit(0.0)) * float(weight)
    if size == 0:
        return F.lit(0.0)
    return F.when(weights.isNull() | (own == 0), F.lit(0.0)).otherwise(meet / (own * size))


def mean_pool(vectors: Column, dimension: int) -> Column:
    """Element-wise mean of a list of vectors; null for none."""
    zero = F.array_repeat(F.lit(0.0), dimension)
    summed = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, doubles(v), lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(summed, lambda x: x / F.size(vectors)))


def max_sim(metric: str, query: Sequence[Sequence[float]], vectors: Column) -> Column:
    """Sum over query vectors of the best similarity among a row's vectors; none contributes zero."""
    out = F.lit(0.0)
    for q in query:
        out = out + F.coalesce(F.array_max(F.transform(vectors, lambda v: to_query(metric, v, q))), F.lit(0.0))
    return out


def sign_words(vector: Column, dimension: int) -> Column:
    """Bits x > 0, lowest first, in 64-bit words."""
    words = []
    for lo in range(0, dimension, 64):
        part = F.slice(vector, lo + 1, min(64, dimension - lo))
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def int8_scale(vector: Column) -> Column:
    """Largest magnitude over 127; zero for a zero vector."""
    return F.coalesce(F.array_max(F.transform(doubles(vector), lambda x: F.abs(x))), F.lit(0.0)) / 127


def int8_codes(vector: Column, scale: Column) -> Column:
    """Symmetric codes, rounded half away from zero and held to -127..127."""
    code = lambda x: F.when(scale == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.signum(x) * F.floor(F.abs(x / scale) + 0.5))))
    return F.transform(doubles(vector), lambda x: code(x).cast("tinyint"))


def int8_dot(codes_a: Column, scale_a: Column, codes_b: Column, scale_b: Column) -> Column:
    whole = F.aggregate(F.zip_with(codes_a, codes_b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return whole.cast("double") * scale_a * scale_b


def unit(vector: Column) -> Column:
    """Scaled to norm one; a zero vector stays."""
    norm = F.sqrt(squared_norm(vector))
    return F.when(norm == 0, doubles(vector)).otherwise(F.transform(doubles(vector), lambda x: x / norm))


def finite(vector: Column) -> Column:
    return F.forall(doubles(vector), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def bm25_saturated(score: Column) -> Column:
    return score / (score + 2.0)
