"""What several operators share: documents, written intermediate tables, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

__all__ = ["components", "documents", "key_filter", "may_hold", "ranked", "saved", "saved_parts", "saved_with", "unused"]


def unused(name: str, columns: list[str]) -> str:
    """name, or a longer one that isn't among columns (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved_parts(df: DataFrame, column: str, compression: str = "snappy") -> DataFrame:
    """saved(df), in a folder for each value of a column of few values, so that readers of some values skip the others."""
    return saved(df, compression, column)


def saved_with(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """saved(df), and aggregates over its rows from the same job."""
    seen = Observation()
    out = saved(df.observe(seen, *[x.alias(k) for k, x in metrics.items()]))
    return out, seen.get


def ranked(df: DataFrame, group: str, order: list[str], rank: str, size: str) -> DataFrame:
    """df with each row's number in its group, from 0 in the order of the columns, and the group's number of rows.

    Rows are dealt by ranges of group and order, so a large group is spread over
    many tasks; what a group's window orders is one row for each range it has.
    group and order must be a total order, and group has no nulls.
    """
    span, at, first, n = (unused(x, [*df.columns, rank, size]) for x in ("_range", "_at", "_first", "_n"))
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = saved(dealt.withColumn(span, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    parts = dealt.groupBy(group, span).agg(F.min(at).alias(first), F.count("*").alias(n))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum(n).over(own.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, span, (before - F.col(first)).alias(rank), F.sum(n).over(own).alias(size))
    return dealt.join(parts, [group, span]).withColumn(rank, F.col(rank) + F.col(at)).drop(span, at)


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits that says of a 64-bit key whether it may be among keys (a column key); its size is fixed."""
    bit = F.pmod(F.col("key"), F.lit(bits))
    words = keys.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(key, {bits}), 64) as int))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys % (64 * len(held))
    return (held[bit // 64] >> (bit % 64)) & 1 == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the least node reachable.

    Alternates the large-star and small-star steps until every edge points at
    its component's least node. Each step is a grouped minimum and a join on the
    node, so a node with very many edges never becomes one group's list. Nodes
    without an edge to another node aren't returned; null ends are ignored.
    """

    def least(pairs: DataFrame) -> DataFrame:
        # written, so that both sides of the join are dealt anew and a hub's rows can be split
        return pairs.join(saved(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "u")

    state = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))}
    # an edge is kept as (larger, smaller)
    now = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = saved_with(now, **state)
    while before["n"]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least(large.where("u <> v"))
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now, after = saved_with(small.where("u <> v").distinct(), **state)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
