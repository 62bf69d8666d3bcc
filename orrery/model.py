"""Collections, records, limits and errors."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

METRICS = ("cosine", "dot", "l2")
DATATYPES = ("float32", "float16", "bfloat16")
FIELD_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_-]{0,63}")
COLLECTION_NAME = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9_.-]{0,127}")
#: Limits, as fixed values.
MAX_VECTOR_FIELDS = 16
MAX_FIELD_DIMENSION = 65536
MAX_MULTI_VECTORS = 1024
MAX_SPARSE_TERMS = 10_000
MAX_TEXT_BYTES = 1 << 20
MAX_BATCH = 10_000
MAX_BATCH_QUERIES = 256
MAX_WINDOW = 10_000
MAX_GROUP_SIZE = 100
GROUP_OVERSAMPLE = 4
MAX_RERANK = 1000
DEFAULT_RERANK = 50
MAX_PAGE = 200
DEFAULT_PAGE = 50
MAX_RERANK_BYTES = 8192
RRF_CONSTANT = 60


class OrreryError(Exception):
    """Base of the engine's errors."""


class InvalidArgument(OrreryError, ValueError):
    pass


class DimensionMismatch(InvalidArgument):
    pass


class NotFound(OrreryError, KeyError):
    pass


class AlreadyExists(OrreryError):
    pass


class Conflict(OrreryError):
    pass


class SequenceGap(OrreryError):
    pass


class Compacted(OrreryError):
    pass


METADATA_VALUE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("raw", T.StringType())])
METADATA = T.MapType(T.StringType(), METADATA_VALUE)
VECTOR = T.ArrayType(T.FloatType())


def between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise InvalidArgument(f"{name} must be between {low} and {high}")


@dataclass(frozen=True)
class IndexConfig:
    """How a vector field is searched. Unset numbers take the type's defaults."""

    type: str = "flat"
    m: int = 0
    ef_construction: int = 0
    ef_search: int = 0
    max_degree: int = 0
    alpha: float = 0.0
    quantization: str = ""
    oversampling: int = 0
    pq_subspaces: int = 0

    def normalized(self, dimension: int = 0) -> IndexConfig:
        out = self
        if out.type == "hnsw":
            out = replace(out, m=out.m or 16, ef_construction=out.ef_construction or 100, ef_search=out.ef_search or 64)
        elif out.type == "diskann":
            out = replace(out, max_degree=out.max_degree or 64, alpha=out.alpha or 1.2, ef_construction=out.ef_construction or 128, ef_search=out.ef_search or 100)
        if out.quantization == "binary":
            out = replace(out, oversampling=out.oversampling or 4)
        elif out.quantization == "pq":
            widest = next((w for w in (8, 4, 2, 1) if dimension % w == 0), 1)
            out = replace(out, oversampling=out.oversampling or 8, pq_subspaces=out.pq_subspaces or max(1, dimension // widest))
        return out

    def validate(self, dimension: int) -> None:
        c = self.normalized(dimension)
        if c.type not in ("flat", "hnsw", "diskann"):
            raise InvalidArgument(f"unknown index type {c.type!r}")
        if c.quantization not in ("", "binary", "pq"):
            raise InvalidArgument(f"unknown quantization {c.quantization!r}")
        if c.type == "hnsw":
            between("m", c.m, 2, 128)
            between("ef_construction", c.ef_construction, c.m, 10_000)
            between("ef_search", c.ef_search, 1, 10_000)
        elif c.type == "diskann":
            if c.m:
                raise InvalidArgument("a diskann index takes max_degree, not m")
            between("max_degree", c.max_degree, 4, 256)
            between("alpha", c.alpha, 1, 2)
            between("ef_construction", c.ef_construction, c.max_degree, 10_000)
            between("ef_search", c.ef_search, 1, 10_000)
        if c.type != "diskann" and (c.max_degree or c.alpha):
            raise InvalidArgument("max_degree and alpha belong to a diskann index")
        if c.quantization and c.type != "flat":
            raise InvalidArgument("quantization needs a flat index")
        if c.quantization:
            between("oversampling", c.oversampling, 1, 100)
        elif c.oversampling:
            raise InvalidArgument("oversampling needs quantization")
        if c.quantization == "pq":
            if not 1 <= c.pq_subspaces <= dimension or dimension % c.pq_subspaces:
                raise InvalidArgument("pq_subspaces must divide the dimension")
        elif c.pq_subspaces:
            raise InvalidArgument("pq_subspaces needs pq quantization")


@dataclass(frozen=True)
class VectorField:
    """A named vector field beside the default vector."""

    dimension: int
    metric: str = "cosine"
    index: IndexConfig = field(default_factory=IndexConfig)
    datatype: str = "float32"
    multi_vector: bool = False

    def validate(self, name: str) -> None:
        if not FIELD_NAME.fullmatch(name):
            raise InvalidArgument(f"bad vector field name {name!r}")
        between(f"dimension of {name}", self.dimension, 1, MAX_FIELD_DIMENSION)
        if self.metric not in METRICS or self.datatype not in DATATYPES:
            raise InvalidArgument(f"{name}: unknown metric or datatype")
        if self.index.quantization:
            raise InvalidArgument(f"{name}: only the default vector can be quantized")
        self.index.validate(self.dimension)


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: str = "cosine"
    shard_count: int = 1
    index: IndexConfig = field(default_factory=IndexConfig)
    vectorizer: str = ""
    vectors: dict[str, VectorField] = field(default_factory=dict)

    def validate(self) -> CollectionConfig:
        if not COLLECTION_NAME.fullmatch(self.name or ""):
            raise InvalidArgument(f"bad collection name {self.name!r}")
        if self.dimension <= 0 or self.shard_count <= 0:
            raise InvalidArgument("dimension and shard_count must be positive")
        if self.metric not in METRICS:
            raise InvalidArgument(f"unknown metric {self.metric!r}")
        self.index.validate(self.dimension)
        if len(self.vectors) > MAX_VECTOR_FIELDS:
            raise InvalidArgument(f"at most {MAX_VECTOR_FIELDS} vector fields")
        for name, spec in self.vectors.items():
            spec.validate(name)
        return self

    def vector_field(self, name: str) -> VectorField:
        if name not in self.vectors:
            raise InvalidArgument(f"unknown vector field {name!r}")
        return self.vectors[name]

    def record_schema(self) -> T.StructType:
        """Records of this collection: one column a vector field, so that scans read only the one they need."""
        s = T.StringType()
        fields = [T.StructField("namespace", s, False), T.StructField("id", s, False), T.StructField("vector", VECTOR), T.StructField("sparse_vector", T.MapType(s, T.FloatType())), T.StructField("text", s)]
        for name in sorted(self.vectors):
            kind = T.ArrayType(VECTOR) if self.vectors[name].multi_vector else VECTOR
            fields.append(T.StructField(column_of(name, self.vectors[name].multi_vector), kind))
        fields += [T.StructField("metadata", METADATA), T.StructField("payload", s), T.StructField("timestamp", T.LongType()), T.StructField("version", T.LongType())]
        return T.StructType(fields)


def column_of(name: str, multi: bool) -> str:
    return f"{'mvec' if multi else 'vec'}_{name}"


def check_vector(vector, dimension: int) -> list[float]:
    out = [float(x) for x in vector]
    if len(out) != dimension:
        raise DimensionMismatch(f"expected {dimension} dimensions, got {len(out)}")
    if not all(map(math.isfinite, out)):
        raise InvalidArgument("vector components must be finite")
    return out


def check_multi_vector(vectors, dimension: int) -> list[list[float]]:
    if not 1 <= len(vectors) <= MAX_MULTI_VECTORS:
        raise InvalidArgument(f"a multi-vector holds 1 to {MAX_MULTI_VECTORS} vectors")
    return [check_vector(v, dimension) for v in vectors]


def check_sparse(sparse: dict) -> dict[str, float]:
    if not 1 <= len(sparse) <= MAX_SPARSE_TERMS or any(not k for k in sparse):
        raise InvalidArgument(f"a sparse vector holds 1 to {MAX_SPARSE_TERMS} named terms")
    out = {k: float(v) for k, v in sparse.items()}
    if not all(map(math.isfinite, out.values())):
        raise InvalidArgument("sparse weights must be finite")
    return out


def check_text(text: str) -> str:
    if len(text.encode()) > MAX_TEXT_BYTES:
        raise InvalidArgument(f"text is over {MAX_TEXT_BYTES} bytes")
    return text
