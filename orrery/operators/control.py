"""Control-plane relations: placement, replicas, rebalancing, compaction, logs, histograms and rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M


def _ticket(collection: Column, shard: Column, node: Column, number: Column) -> Column:
    """Hash of a node's bid for a shard; the bids after the first carry their number."""
    word = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    head = F.concat(F.encode(collection, "UTF-8"), F.unhex(F.lit("00")), word(shard), F.encode(node, "UTF-8"))
    return F.sha2(F.when(number == 0, head).otherwise(F.concat(head, word(number))), 256)


def bids(nodes: DataFrame, shards: DataFrame) -> DataFrame:
    """(collection, shard, node, score): each node's best ticket for each shard; capacity is its number of tickets."""
    capacity = F.greatest(F.coalesce(F.col("capacity"), F.lit(1)), F.lit(1))
    tickets = nodes.select("node", F.explode(F.sequence(F.lit(0), capacity - 1)).alias("ticket"))
    pairs = shards.crossJoin(F.broadcast(tickets))  # cluster nodes: tens of rows
    scored = pairs.select("collection", "shard", "node", _ticket(F.col("collection"), F.col("shard"), F.col("node"), F.col("ticket")).alias("score"))
    return scored.groupBy("collection", "shard", "node").agg(F.max("score").alias("score"))


def replicas(nodes: DataFrame, shards: DataFrame, factor: int = 1) -> DataFrame:
    """(collection, shard, rank, node): the `factor` highest bids; rank 1 leads. Health does not matter."""
    order = Window.partitionBy("collection", "shard").orderBy(F.desc("score"), "node")
    return bids(nodes, shards).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= factor).select("collection", "shard", "rank", "node")


def shard_rows(collections: DataFrame) -> DataFrame:
    """(collection, shard) of (collection, shard_count)."""
    return collections.select("collection", F.explode(F.sequence(F.lit(0), F.col("shard_count") - 1)).alias("shard"))


def rebalance(current: DataFrame, target: DataFrame) -> DataFrame:
    """Shards whose replicas change: leaders, replicas to add and to remove, and the steps in order.

    New replicas are copied and caught up before leadership moves; removals come last.
    """
    rolled = lambda df, name: df.groupBy("collection", "shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda r: r["node"]).alias(name))
    both = rolled(current, "source").join(rolled(target, "target"), ["collection", "shard"], "full")
    none = F.array().cast("array<string>")
    both = both.withColumn("source", F.coalesce("source", none)).withColumn("target", F.coalesce("target", none)).where(F.col("source") != F.col("target"))
    add, drop = F.array_except("target", "source"), F.array_except("source", "target")
    steps = F.concat(
        F.transform(add, lambda n: F.concat(F.lit("copy:"), n)), F.transform(add, lambda n: F.concat(F.lit("catch_up:"), n)),
        F.when(F.get("source", F.lit(0)).eqNullSafe(F.get("target", F.lit(0))), none).otherwise(F.array(F.concat(F.lit("lead:"), F.get("target", F.lit(0))))),
        F.transform(drop, lambda n: F.concat(F.lit("remove:"), n)),
    )
    return both.select("collection", "shard", F.get("source", F.lit(0)).alias("source_leader"), F.get("target", F.lit(0)).alias("target_leader"), F.array_sort(add).alias("added"), F.array_sort(drop).alias("removed"), steps.alias("steps"))


def newest_replica(manifests: DataFrame) -> DataFrame:
    """(collection, shard, node) of the replica with the highest sequence; ties to the smaller node."""
    order = Window.partitionBy("collection", "shard").orderBy(F.desc("sequence"), "node")
    return manifests.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("collection", "shard", "node", "sequence")


def recovery_point(manifests: DataFrame) -> DataFrame:
    """Node manifests as one: all must agree on epoch and digest, and no shard may stand twice."""
    seen = manifests.agg(F.countDistinct("epoch", "digest").alias("kinds"), F.count("*").alias("rows"), F.countDistinct("collection", "shard").alias("shards")).first()
    if seen["kinds"] > 1 or seen["rows"] != seen["shards"]:
        raise M.Conflict("the manifests do not belong together")
    return manifests.orderBy("collection", "shard")


@dataclass(frozen=True)
class Segment:
    name: str
    size: int
    last: int


def compaction(segments: Sequence[Segment], fan_in: int = 4, ratio: float = 4, most_bytes: int = 64 << 20, most_segments: int = 8) -> tuple[list[Segment], bool]:
    """(segments to merge, whether forced): the oldest `fan_in` neighbours of like size that fit; at the segment limit the
    oldest that fit, and an error if fewer than two do."""
    if fan_in < 2 or ratio < 1 or most_bytes <= 0 or most_segments < fan_in:
        raise M.InvalidArgument("bad compaction policy")
    old = sorted(segments, key=lambda s: s.last)
    for i in range(len(old) - fan_in + 1):
        run = old[i : i + fan_in]
        if all(s.size <= ratio * max(1, run[0].size) for s in run) and sum(s.size for s in run) <= most_bytes:
            return run, False
    if len(old) < most_segments:
        return [], False
    taken, total = [], 0
    for s in old[:fan_in]:
        if total + s.size > most_bytes:
            break
        taken.append(s)
        total += s.size
    if len(taken) < 2:
        raise M.Conflict("too many segments and none can be merged within the limit")
    return taken, True


def recent_events(events: DataFrame, level: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first by sequence."""
    M.between("limit", limit, 1, M.MAX_PAGE)
    kept = events if level is None else events.where(F.col("level") == level)
    return kept.orderBy(F.desc("sequence")).limit(limit)


def merged_events(logs: Sequence[DataFrame], limit: int = 100) -> DataFrame:
    """The newest of several nodes' logs: by time, then node, then sequence."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.orderBy(F.desc("ts"), "node", F.desc("sequence")).limit(limit)


def retained(events: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` events."""
    return events.orderBy(F.desc("sequence")).limit(keep)


def histogram(values: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """(le, count): cumulative counts at each bound; null `le` holds all values."""
    edges = [float(b) for b in sorted(bounds)]
    counts = values.where(F.col(column).isNotNull()).agg(*[F.sum(F.when(F.col(column) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(edges)], F.count("*").alias("all"))
    cells = [F.struct(F.lit(b).alias("le"), F.coalesce(F.col(f"b{i}"), F.lit(0)).cast("long").alias("count")) for i, b in enumerate(edges)]
    return counts.select(F.explode(F.array(*cells, F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("count")))).alias("r")).select("r.le", "r.count")


def rates(samples: DataFrame, at: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds `rate`: a counter's growth per second since the sample before; zero after a reset, null at first."""
    w = Window.partitionBy(*by).orderBy(at)
    grown, passed = F.col(value) - F.lag(value).over(w), F.col(at) - F.lag(at).over(w)
    return samples.withColumn("rate", F.when(grown < 0, 0.0).when(passed > 0, grown / passed))


def lag_of(leader: Column, follower: Column) -> Column:
    return F.greatest(F.lit(0), leader - follower)


def parse_metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) of text-format metric lines."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)"
    part = lambda i: F.regexp_extract(column, pattern, i)
    pairs = F.transform(F.regexp_extract_all(part(2), F.lit(r'([A-Za-z0-9_]+="[^"]*")'), 1), lambda p: F.struct(F.regexp_extract(p, "^([^=]+)=", 1).alias("k"), F.regexp_extract(p, '="([^"]*)"$', 1).alias("v")))
    return lines.where(F.col(column).rlike(pattern)).select(part(1).alias("name"), F.map_from_entries(pairs).alias("labels"), part(3).try_cast("double").alias("value"))
