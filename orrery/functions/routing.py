"""Which logical shard holds a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 64 bits, as fixed values.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def shard_of(namespace: str, key: str, shards: int) -> int:
    return fnv1a(f"{namespace}\0{key}".encode()) % shards


def _fnv1a_many(keys: list[bytes]) -> np.ndarray:
    """The same for many keys, a byte position at a time over all of them."""
    size = np.array([len(k) for k in keys])
    wide = np.zeros((len(keys), size.max(initial=0)), np.uint64)
    for i, k in enumerate(keys):
        wide[i, : len(k)] = np.frombuffer(k, np.uint8)
    h = np.full(len(keys), OFFSET, np.uint64)
    for j in range(wide.shape[1]):
        h = np.where(j < size, (h ^ wide[:, j]) * np.uint64(PRIME), h)
    return h


def shard(namespace: Column, key: Column, shards: int) -> Column:
    """The shard of each row's key; needed only where shard numbers must be these, else let Spark hash."""

    @F.pandas_udf("int")
    def route(ns: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(_fnv1a_many([f"{a}\0{b}".encode() for a, b in zip(ns, key)]) % np.uint64(shards)).astype("int32")

    return route(namespace, key)
