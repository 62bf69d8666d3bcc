"""Connected components of a table of links, by alternating large and small stars.

Up to a checked number of links one task labels them, which saves the rounds. Each round is two grouped minima and two equi-joins over the links; the links of a round are a table in the shared
folder, so that a lost executor costs one round at most. Nothing but row counts and sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


ONE_TASK = 1_000_000  # links that one task labels


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n indexes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = forest(len(nodes), at[: len(a)], at[len(a) :])
        rest = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.record_batch({"node": pa.array(nodes[rest], pa.int64()), "component": pa.array(nodes[label[rest]], pa.int64())})


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether each node has one link, and that to a node without any: then links lead to the smallest of a component."""
    many = links.groupBy("a").count().where("count > 1").select("a")
    inner = links.select("a").join(links.select(F.col("b").alias("a")), "a", "left_semi")
    return many.unionAll(inner).isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component): for every linked node but a component's smallest, that smallest node.

    Nulls and self-links are no links. An empty table gives an empty result.
    """
    links = settled(links.select("a", "b").where("a is not null and b is not null and a <> b"))
    if links.count() <= ONE_TASK:
        return settled(links.coalesce(1).mapInArrow(_labelled, "node long, component long"))
    now = settled(_small(links))
    for _ in range(rounds):
        if _stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = settled(_small(_large(now)))
    raise RuntimeError("links did not settle")
