"""Events: which rows count, what label lies ahead of them, and how much they weigh.

Windows over the whole series would be one partition. Rows are therefore dealt
into blocks of consecutive rids, each with the few rows before and after it that
its windows reach; what must see everything is an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rows as rows_of
from ..functions.rows import TOP, before_block, block_window, blocked
from ..functions.windows import absolute_max_weight, forward

EVENT_COLUMNS = ("event_start", "event_end", "event_label", "event_raw", "event_sample_weights", "event_test_sample_weights")


@dataclass(frozen=True)
class NoFilter:
    def keep(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class FilterZero:
    """Rows whose y isn't 0; an unknown y isn't."""

    def keep(self) -> Column:
        return ~F.col("y").eqNullSafe(F.lit(0.0))


@dataclass(frozen=True)
class EveryNth:
    n: int

    def keep(self) -> Column:
        return F.col("rid") % self.n == 0


def binarize_sign(x: Column) -> Column:
    """1 from 0 on, 0 under it, null where unknown."""
    return F.when(x >= 0, 1.0).when(x < 0, 0.0)


def no_label(x: Column) -> Column:
    return x


def flip(label: Column, classes: int) -> Column:
    """Labels of two classes swapped (1 - label), of three negated; others stay."""
    return {2: 1 - label, 3: -label}.get(classes, label)


@dataclass(frozen=True)
class NoWeighting:
    memory = 0

    def weigh(self, df: DataFrame, value: str, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.lit(1.0))


@dataclass(frozen=True)
class WeightByMax:
    """|value| by the greatest |value| of the last rows (a number over 1, a fraction of all rows, or None: of all so far)."""

    window_size: int | float | None = None

    def rows(self, n: int) -> int | None:
        w = self.window_size
        return None if w is None else int(w) if w > 1 else int(n * w)

    def weigh(self, df: DataFrame, value: str, name: str, n: int) -> DataFrame:
        rows = self.rows(n)
        if rows is not None and rows > rows_of.BLOCK_ROWS:
            return self._wide(df, value, name, rows)
        if rows is not None:
            dealt = blocked(df, rows - 1, 0)
            return dealt.withColumn(name, absolute_max_weight(F.col(value), block_window(), rows)).where("NOT _halo").drop("_block", "_halo")
        # the greatest so far is the greatest of the blocks before, or of the block so far
        dealt = blocked(df, 0, 0).drop("_halo")
        tops = dealt.groupBy("_block").agg(F.max(F.abs(value)).alias("_top"))
        earlier = before_block(tops, {"_top": TOP}, []).withColumnRenamed("_top", "_before")
        so_far = F.max(F.abs(value)).over(block_window().rowsBetween(Window.unboundedPreceding, 0))
        out = dealt.join(earlier, "_block")
        return out.withColumn(name, F.abs(value) / F.nullif(F.greatest(so_far, "_before"), F.lit(0.0))).drop("_block", "_before")


    def _wide(self, df: DataFrame, value: str, name: str, rows: int) -> DataFrame:
        """For windows of several blocks: the greatest of the own block so far, of whole blocks, and of the end of the window's first block.

        df has every rid from its first to its last.
        """
        size, q, x = rows_of.BLOCK_ROWS, rows // rows_of.BLOCK_ROWS, F.abs(value)
        whole = block_window()
        dealt = df.withColumn("_block", F.floor(F.col("rid") / size))
        # in reverse order, as a frame without an upper end is aggregated anew for each row
        back = Window.partitionBy("_block").orderBy(F.col("rid").desc())
        dealt = dealt.withColumns({"_so_far": F.max(x).over(whole.rowsBetween(Window.unboundedPreceding, 0)), "_to_end": F.max(x).over(back.rowsBetween(Window.unboundedPreceding, 0))})
        order = Window.orderBy("_block")  # a row a block
        over = lambda k: F.max("_top").over(order.rangeBetween(-k, -1)) if k else F.lit(None).cast("double")
        middle = dealt.groupBy("_block").agg(F.max(x).alias("_top")).select("_block", over(q).alias("_more"), over(q - 1).alias("_less"))
        ends = dealt.select((F.col("rid") + rows - 1).alias("rid"), F.col("_to_end").alias("_rest"))
        between = F.col("_block") - F.floor((F.col("rid") - rows + 1) / size) - 1
        out = dealt.join(middle, "_block").join(ends, "rid", "left")
        top = F.greatest("_so_far", F.when(between >= q, F.col("_more")).otherwise(F.col("_less")), "_rest")
        return out.withColumn(name, x / F.nullif(top, F.lit(0.0))).drop("_block", "_so_far", "_to_end", "_more", "_less", "_rest")


@dataclass(frozen=True)
class WeightByMaxWithLookahead:
    """|value| by the greatest value of all rows; 0 where unknown."""

    def weigh(self, df: DataFrame, value: str, name: str, n: int) -> DataFrame:
        top = df.agg(F.max(value).alias("_top"))  # one row
        return df.crossJoin(F.broadcast(top)).withColumn(name, F.coalesce(F.abs(value) / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0))).drop("_top")


@dataclass(frozen=True)
class FixedForwardHorizon:
    """Labels by an aggregate of y over the next rows; rows too near the end have no event."""

    time_horizon: int
    labeling_strategy: Callable[[Column], Column] = no_label
    weighting_strategy: object = NoWeighting()
    weighting_strategy_test: object = WeightByMaxWithLookahead()
    transformation_function: Callable[[Column], Column] | None = None
    post_aggregation_function: Callable[[Column], Column] | None = None
    aggregate_function: object = "sum"
    truncate: bool = True
    flip_sign: bool = False
    shift_by: int = 0

    def label(self, df: DataFrame, n: int) -> DataFrame:
        h = self.time_horizon
        last = df.agg(F.max_by("ts", "rid").alias("_last"))  # one row
        dealt = blocked(df, 0, h + self.shift_by)
        x = self.transformation_function(F.col("y")) if self.transformation_function else F.col("y")
        value = forward(self.aggregate_function, x, block_window(), h, self.shift_by)
        value = self.post_aggregation_function(value) if self.post_aggregation_function else value
        out = dealt.select("*", value.alias("_forward"), F.lead("ts", h).over(block_window()).alias("_end")).where("NOT _halo").drop("_block", "_halo")
        if self.truncate:
            out = out.where(F.col("rid") < n - h)
        out = out.crossJoin(F.broadcast(last)).withColumn("event_end", F.coalesce("_end", "_last")).withColumn("event_start", F.col("ts"))
        out = out.withColumn("event_label", self.labeling_strategy(F.col("_forward"))).withColumn("event_raw", F.col("y"))
        if self.flip_sign:
            kinds = out.agg(F.countDistinct("event_label").alias("_kinds"))
            label = F.col("event_label")
            out = out.crossJoin(F.broadcast(kinds)).withColumn("event_label", F.when(F.col("_kinds") == 2, flip(label, 2)).when(F.col("_kinds") == 3, flip(label, 3)).otherwise(label)).drop("_kinds")
        out = self.weighting_strategy.weigh(out, "_forward", "event_sample_weights", n)
        return self.weighting_strategy_test.weigh(out, "_forward", "event_test_sample_weights", n).drop("_forward", "_end", "_last")


@dataclass(frozen=True)
class IdentityLabeler:
    """Labels by y itself; an event ends with the next row."""

    labeling_strategy: Callable[[Column], Column] = no_label
    weighting_strategy: object = NoWeighting()

    def label(self, df: DataFrame, n: int) -> DataFrame:
        last = df.agg(F.max_by("ts", "rid").alias("_last"))  # one row
        dealt = blocked(df, 0, 1)
        out = dealt.withColumn("_end", F.lead("ts", 1).over(block_window())).where("NOT _halo").drop("_block", "_halo").crossJoin(F.broadcast(last))
        out = out.withColumns({"event_start": F.col("ts"), "event_end": F.coalesce("_end", "_last"), "event_label": self.labeling_strategy(F.col("y")), "event_raw": F.col("y")})
        out = self.weighting_strategy.weigh(out, "y", "event_sample_weights", n)
        return self.weighting_strategy.weigh(out, "y", "event_test_sample_weights", n).drop("_end", "_last")


def create_events(df: DataFrame, n: int, labeler, event_filter=None) -> DataFrame:
    """df with event columns, null in rows that the filter leaves out, that are too near the end, or that lack any of them."""
    labelled = labeler.label(df, n)
    kept = labelled.where((event_filter or NoFilter()).keep()).dropna(subset=list(EVENT_COLUMNS))
    return df.join(kept.select("rid", *EVENT_COLUMNS), "rid", "left")

