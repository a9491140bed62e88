"""Many series in one table (unique_id, ds, y and features): each has its own splits, windows and states, all in one plan.

Rows are numbered over the whole table in the order of unique_id and ds, by ranges; a
series' rows are numbered from its first. A series' split is known by the number of its
first row plus the split's own, so that the blocks of a pipeline see a table of splits
like any other. Small series share tasks, as their splits are hashed together; a long
one is cut into blocks of rows. Nothing of a series reaches the driver: states, as many
as series and splits, are written and joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import c
from ..functions.rows import block_window, blocked
from ..operators import arrays, features, models, scaling
from ..sources.series import with_rid
from ..sources.tables import saved
from . import segments
from .blocks import Frame, Run, Sequence, as_block, cut, memory_of, traverse
from .engine import check_types_multi_series
from .splits import ExpandingWindowSplitter, SlidingWindowSplitter

#: Blocks that learn by one grouped aggregate, whose result is joined and used nowhere else.
_LEARNERS = (scaling.StandardScaler, scaling.MinMaxScaler, models.LinearRegression, models.DummyRegressor)


class PanelRun(Run):
    """States that are tables of a row a series and split."""

    def state(self, path, fit):
        if self.fitting:
            self.states[path] = saved(fit())
        return self.states[path]

    def joined(self, path, frame, fit):
        return frame.df.join(self.state(path, fit), "split_id", "left")


def check(pipeline) -> None:
    """ValueError for blocks that can't be fitted by series in one plan."""
    for b in traverse(as_block(pipeline)):
        extremes = isinstance(b, features.AddWindowFeatures) and not any(isinstance(fn, str) and any(p.startswith("p") for p in features.SO_FAR.get(fn, ())) for _, w, fn in b._triples() if w is None or b._is_wide(w, fn))
        if not (isinstance(b, (*_LEARNERS, Sequence, arrays.ApplyArrays, arrays.RollingArrays)) or segments.is_local(b) or extremes):
            raise ValueError(f"{b.name or type(b).__name__} isn't fitted by series")


def with_next(df: DataFrame, value: str, name: str = "y", order: tuple = ("ds",)) -> DataFrame:
    """df with the series' next value; rows without one go. Neighbours meet in blocks of rows, never a whole series."""
    dealt = blocked(with_rid(df, ["unique_id", *order]), 0, 1)
    dealt = dealt.withColumns({"_id": F.lead("unique_id").over(block_window()), name: F.lead(value).over(block_window())})
    return dealt.where("NOT _halo").where(F.col("_id").eqNullSafe(F.col("unique_id")) & c(name).isNotNull()).drop("_block", "_halo", "_id", "rid")


def _rows(size, n: Column) -> Column:
    """A window's size, whole or a fraction, in rows of a series."""
    return F.floor(F.lit(size) * n) if isinstance(size, float) else F.lit(size).cast("long")


def tagged(df: DataFrame, splitter, memory: int, is_train: bool) -> DataFrame:
    """Rows (of numbered series: _first, n, rid) once for each split that trains on them, or once in their test window and as context of those after."""
    sliding = hasattr(splitter, "train_window")
    first, step = _rows(splitter.train_window if sliding else splitter.initial_train_window, F.col("n")), _rows(splitter.step, F.col("n"))
    df = df.withColumns({"_w": first, "_step": F.greatest(step, F.lit(1))}).where("n > _w")
    df = df.withColumn("_k", F.ceil((F.col("n") - F.col("_w")) / F.col("_step")))
    left = F.col("n") - F.col("_w") - (F.col("_k") - 1) * F.col("_step")
    # a last test window of at most a tenth of the rows belongs to the one before
    df = df.withColumn("_k", F.when((F.col("_k") > 1) & (left <= F.floor(F.lit(0.1) * F.col("n"))), F.col("_k") - 1).otherwise(F.col("_k")))
    at = lambda rid: F.floor((rid - F.col("_w")) / F.col("_step"))
    if is_train:
        low = F.greatest(at(F.col("rid")) + 1, F.lit(0))
        high = F.least(F.col("_k") - 1, at(F.col("rid") + F.col("_w"))) if sliding else F.col("_k") - 1
        high = F.when(high > F.col("_k") - 1, F.col("_k") - 1).otherwise(high)
    else:
        low = F.greatest(F.least(at(F.col("rid")), F.col("_k") - 1), F.lit(0))
        high = F.least(at(F.col("rid") + memory), F.col("_k") - 1)
    out = df.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("split", F.explode(F.sequence("_low", "_high")))
    halo = F.lit(False) if is_train else F.col("rid") < F.col("_w") + F.col("split") * F.col("_step")
    out = out.withColumns({"split_id": F.col("_first") + F.col("split"), "_role": F.lit(is_train), "halo": halo})
    return out.drop("_w", "_step", "_k", "_low", "_high", "n")


def backtest(pipeline, df: DataFrame, splitter, features: tuple = (), order: tuple = ("ds",)) -> DataFrame:
    """(unique_id, split, rid, ds, y, what the pipeline makes) of all test rows of all series.

    df: unique_id, ds, y, features, and the columns of order, which order a series' rows;
    rows that are equal in these are taken in any order. splitter: an expanding or a sliding one without further options
    (ValueError), whose sizes are taken of each series' own rows, a step as one row at
    least; series that have no more rows than a train window give no results, and a
    row is repeated for each split that trains on it. Null ids are one series.
    """
    check_types_multi_series(df)
    check(pipeline)
    sizes_only = ExpandingWindowSplitter(splitter.initial_train_window, splitter.step) if isinstance(splitter, ExpandingWindowSplitter) else SlidingWindowSplitter(splitter.train_window, splitter.step) if isinstance(splitter, SlidingWindowSplitter) else None
    if splitter != sizes_only:
        raise ValueError("a splitter by series is an expanding or sliding one of two sizes")
    block, extra = as_block(pipeline), ("unique_id", "ds", "split", "_first")
    numbered = with_rid(df.select(*[c(x) for x in dict.fromkeys(("unique_id", "ds", "y", *order, *features))]), ["unique_id", *order])
    sizes = numbered.groupBy("unique_id").agg(F.min("rid").alias("_first"), F.count("*").alias("n")).withColumnRenamed("unique_id", "_id")
    own = numbered.join(sizes, F.col("unique_id").eqNullSafe(F.col("_id"))).drop("_id").withColumns({"rid": F.col("rid") - F.col("_first"), "raw_y": F.col("y"), "ts": F.col("ds")})
    own = saved(own)

    def framed(is_train: bool) -> Frame:
        dealt = cut(tagged(own, splitter, memory_of(block), is_train), block)
        dealt = dealt.withColumns({"train": F.col("_role") & ~F.col("_halo"), "halo": F.col("halo") | F.col("_halo")})
        return Frame(dealt, tuple(features), extra, ("split_id", "_role", "_block"))

    run = PanelRun()
    if block.learns:
        block.process(framed(True), run, "main")
    out = block.process(framed(False), PanelRun(run.states), "main")
    return out.df.where("NOT halo").select("unique_id", F.col("split").cast("long").alias("split"), "rid", "ds", F.col("raw_y").alias("y"), *[c(f) for f in out.features])
