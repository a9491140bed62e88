"""Windows over a whole ordered series without one partition for all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Consecutive rows that a window's partition has, at least.
BLOCK_ROWS = 1 << 16
#: Blocks whose totals are gathered before they are put in order.
GATHERED = 1 << 12


def blocked(df: DataFrame, before: int, after: int, rows: int | None = None, place: str = "rid") -> DataFrame:
    """df with _block and _halo: each row in its own block of consecutive places, and as context in the blocks that reach it."""
    rows = max(rows or BLOCK_ROWS, before + after + 1)
    own = F.floor(F.col(place) / rows)
    reach = F.sequence(F.floor((F.col(place) - after) / rows), F.floor((F.col(place) + before) / rows))
    dealt = df.withColumn("_block", F.explode(reach) if before or after else own)
    return dealt.withColumn("_halo", F.col("_block") != own)


def block_window() -> WindowSpec:
    return Window.partitionBy("_block").orderBy("rid")


def before_block(totals: DataFrame, fns: dict[str, tuple[Callable, Callable]], by: list[str]) -> DataFrame:
    """totals (by, _block and columns, one row a block) with each column's aggregate over all earlier blocks of its group instead.

    fns: {column: (aggregate, function of two columns that joins two aggregates)}. Blocks
    are gathered GATHERED at a time first, so that no task orders all of them.
    """
    wide = totals.withColumn("_wide", F.floor(F.col("_block") / GATHERED))
    outer = wide.groupBy(*by, "_wide").agg(*[fn(k).alias(k) for k, (fn, _) in fns.items()])
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select(*by, "_wide", *[fn(k).over(earlier(by, "_wide")).alias(f"_o_{k}") for k, (fn, _) in fns.items()])
    inner = wide.select(*by, "_wide", "_block", *[fn(k).over(earlier([*by, "_wide"], "_block")).alias(f"_i_{k}") for k, (fn, _) in fns.items()])
    known = lambda join, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join(a, b))
    return inner.join(outer, [*by, "_wide"]).select(*by, "_block", *[known(join, F.col(f"_o_{k}"), F.col(f"_i_{k}")).alias(k) for k, (_, join) in fns.items()])


ADD = (F.sum, lambda a, b: a + b)
TOP = (F.max, F.greatest)
LOW = (F.min, F.least)


def numbered(df: DataFrame, keep: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """The rows of df that keep chooses, numbered from 0 in the order of rid (in each group of by); a block's rows meet, never all."""
    by = by or []
    kept = df.where(keep).withColumn("_block", F.floor(F.col("rid") / BLOCK_ROWS))
    counts = kept.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by, "_block").orderBy("rid"))
    return kept.join(before_block(counts, {"_n": ADD}, by), [*by, "_block"]).withColumn(name, F.coalesce("_n", F.lit(0)) + place - 1).drop("_block", "_n")


def over_windows(df: DataFrame, parts: dict[str, tuple[Column, Callable, tuple]], window: int, piece: int, by: list[str]) -> DataFrame:
    """(by, rid, each part's aggregate over the last window rows of its group), for windows of more rows than a piece.

    parts: {name: (value, aggregate, ADD, TOP or LOW)}. A window is the end of one piece,
    whole pieces, and the beginning of the row's own piece: aggregates from each row to
    both ends of its piece, and of runs of pieces, are enough, whatever the window. Two
    equality joins put them together; no task has more than a piece's rows, or the totals of
    a window's pieces.
    """
    placed = numbered(df.select(*by, "rid", *[x.alias(k) for k, (x, _, _) in parts.items()]), F.lit(True), "_q", by).withColumn("_g", F.floor(F.col("_q") / piece))
    # to the end of a piece: in reverse order, as frames without an upper end are aggregated anew for each row
    inside = lambda order: Window.partitionBy(*by, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.select(*by, "rid", "_q", "_g", *[fn(k).over(inside(F.col("_q"))).alias(f"_a_{k}") for k, (_, fn, _) in parts.items()], *[fn(k).over(inside(F.col("_q").desc())).alias(f"_z_{k}") for k, (_, fn, _) in parts.items()])
    whole, rest = divmod(window - 1, piece)
    totals = blocked(placed.groupBy(*by, "_g").agg(*[fn(k).alias(k) for k, (_, fn, _) in parts.items()]), whole, 0, GATHERED, "_g")
    run = Window.partitionBy(*by, "_block").orderBy("_g")
    less = lambda merge, k: merge(k).over(run.rowsBetween(1 - whole, -1)) if whole > 1 else F.lit(None)
    runs = totals.select(*by, "_g", "_halo", *[merge(k).over(run.rowsBetween(-whole, -1)).alias(f"_m_{k}") for k, (_, _, (merge, _)) in parts.items()], *[less(merge, k).alias(f"_l_{k}") for k, (_, _, (merge, _)) in parts.items()]).where("NOT _halo").drop("_halo")
    first = ends.select(*by, (F.col("_q") + (window - 1)).alias("_q"), *[f"_z_{k}" for k in parts])
    out = ends.drop(*[f"_z_{k}" for k in parts]).join(first, [*by, "_q"], "left").join(runs, [*by, "_g"], "left")
    known = lambda join, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join(a, b))
    middle = lambda k: F.when(F.col("_q") % piece >= rest, F.col(f"_l_{k}")).otherwise(F.col(f"_m_{k}"))
    return out.select(*by, "rid", *[known(join, known(join, F.col(f"_z_{k}"), middle(k)), F.col(f"_a_{k}")).alias(k) for k, (_, _, (_, join)) in parts.items()])
