"""Blocks that fit statistics: scalers, positive shift, and feature selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import c
from ..plans.blocks import Block, Frame


def _per_split(frame: Frame, aggregates: dict) -> DataFrame:
    """One row a split of aggregates over train rows; partial sums, so no split's rows meet in one task."""
    return frame.train_rows().groupBy("split_id").agg(*[x.alias(name) for name, x in aggregates.items()])


@dataclass(frozen=True)
class StandardScaler(Block):
    """By mean and population deviation; a deviation of 0 counts as 1."""

    name: str = "standard scaler"
    needs_target = False

    def state_from(self, m) -> tuple:
        known = m.n > 0
        deviation = np.sqrt(m.spread / np.maximum(m.n, 1))
        return tuple(float(x) if ok else None for a, b, ok in zip(m.mean, deviation, known, strict=True) for x in (a, b))

    def state_schema(self, k: int) -> str:
        return ", ".join(f"_m_{i} double, _d_{i} double" for i in range(k))

    by_deviation = True

    def affine(self, state: tuple, i: int):
        """(factor, shift) of column i by a split's state; None where it is null throughout, False where it isn't affine."""
        mean, deviation = state[2 * i : 2 * i + 2]
        return None if mean is None else (1 / (deviation or 1.0), -mean / (deviation or 1.0))

    def process(self, frame, run, path):
        fit = lambda: _per_split(frame, {f"_{s}_{i}": fn(c(f)) for i, f in enumerate(frame.features) for s, fn in (("m", F.avg), ("d", F.stddev_pop))})
        df = run.joined(path, frame, fit)
        scale = lambda i: F.when(F.col(f"_d_{i}") == 0, 1.0).otherwise(F.col(f"_d_{i}"))
        return frame.on(df).add({f: (c(f) - F.col(f"_m_{i}")) / scale(i) for i, f in enumerate(frame.features)})

    def inverse(self, frame, run, path, names):
        df = frame.df.join(F.broadcast(run.states[path]), "split_id", "left")
        return frame.on(df).add({n: c(n) * F.when(F.col("_d_0") == 0, 1.0).otherwise(F.col("_d_0")) + F.col("_m_0") for n in names})


@dataclass(frozen=True)
class MinMaxScaler(Block):
    """Onto a range; a column that doesn't vary goes to its start; clip keeps test values inside."""

    feature_range: tuple = (0.0, 1.0)
    clip: bool = False
    name: str = "min-max scaler"
    needs_target = False

    def state_from(self, m) -> tuple:
        return tuple(None if np.isnan(x) else float(x) for pair in zip(m.low, m.high, strict=True) for x in pair)

    def state_schema(self, k: int) -> str:
        return ", ".join(f"_l_{i} double, _h_{i} double" for i in range(k))

    by_deviation = False

    def affine(self, state: tuple, i: int):
        a, z = state[2 * i : 2 * i + 2]
        if self.clip or a is None:
            return False if self.clip else None
        low, high = map(float, self.feature_range)
        factor = (high - low) / ((z - a) or 1.0)
        return factor, low - a * factor

    def process(self, frame, run, path):
        low, high = map(float, self.feature_range)
        fit = lambda: _per_split(frame, {f"_{s}_{i}": fn(c(f)) for i, f in enumerate(frame.features) for s, fn in (("l", F.min), ("h", F.max))})
        df, made = run.joined(path, frame, fit), {}
        for i, f in enumerate(frame.features):
            span = F.col(f"_h_{i}") - F.col(f"_l_{i}")
            x = (c(f) - F.col(f"_l_{i}")) / F.when(span == 0, 1.0).otherwise(span) * (high - low) + low
            made[f] = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low))) if self.clip else x
        return frame.on(df).add(made)

    def inverse(self, frame, run, path, names):
        low, high = map(float, self.feature_range)
        df = frame.df.join(F.broadcast(run.states[path]), "split_id", "left")
        span = F.col("_h_0") - F.col("_l_0")
        return frame.on(df).add({n: (c(n) - low) / (high - low) * F.when(span == 0, 1.0).otherwise(span) + F.col("_l_0") for n in names})


@dataclass(frozen=True)
class TurnPositive(Block):
    """Adds |minimum| + 1 of the train rows to columns whose minimum isn't positive."""

    name: str = "turn positive"
    needs_target = False

    def state_from(self, m) -> tuple:
        return tuple(None if np.isnan(x) else float(x) for x in m.low)

    def state_schema(self, k: int) -> str:
        return ", ".join(f"_low_{i} double" for i in range(k))

    by_deviation = False

    def affine(self, state: tuple, i: int):
        return None if state[i] is None else (1.0, abs(state[i]) + 1 if state[i] <= 0 else 0.0)

    def process(self, frame, run, path):
        fit = lambda: _per_split(frame, {f"_low_{i}": F.min(c(f)) for i, f in enumerate(frame.features)})
        df = run.joined(path, frame, fit)
        shift = lambda i: F.when(F.col(f"_low_{i}") <= 0, F.abs(F.col(f"_low_{i}")) + 1).otherwise(0.0)
        return frame.on(df).add({f: c(f) + shift(i) for i, f in enumerate(frame.features)})

    def inverse(self, frame, run, path, names):
        df = frame.df.join(F.broadcast(run.states[path]), "split_id", "left")
        return frame.on(df).add({n: c(n) - F.when(F.col("_low_0") <= 0, F.abs(F.col("_low_0")) + 1).otherwise(0.0) for n in names})


@dataclass(frozen=True)
class RemoveLowVariance(Block):
    """Columns whose population variance in a split isn't over the threshold are null there; columns kept nowhere go.

    Which columns stay is looked up on the driver (a row a split). With
    threshold 0 a column must vary at all.
    """

    threshold: float = 1e-5
    name: str = "low variance"

    def selected(self, frame, run, path) -> DataFrame:
        spread = lambda f: F.least(F.var_pop(c(f)), F.max(c(f)) - F.min(c(f))) if self.threshold == 0 else F.var_pop(c(f))
        names = lambda: F.array_compact(F.array(*[F.when(spread(f) > self.threshold, F.lit(f)) for f in frame.features]))
        run.labels[path] = f"selected_features_{self.name}"
        return run.state(path, lambda: _per_split(frame, {"selected": names()}))

    def process(self, frame, run, path):
        return keep_selected(frame, self.selected(frame, run, path))


@dataclass(frozen=True)
class SelectKBest(Block):
    """The k columns of greatest squared correlation with the target in each split's train rows."""

    k: int
    name: str = "k best"

    def selected(self, frame, run, path) -> DataFrame:
        def squared(f):
            known = c(f).isNotNull() & F.col("y").isNotNull()
            x, y = F.when(known, c(f)), F.when(known, F.col("y"))
            return F.pow(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), 2)

        ranked = lambda: F.slice(F.sort_array(F.array(*[F.struct(F.coalesce(squared(f), F.lit(-1.0)).alias("score"), F.lit(-i).alias("place"), F.lit(f).alias("name")) for i, f in enumerate(frame.features)]), False), 1, self.k)
        run.labels[path] = f"selected_features_{self.name}"
        return run.state(path, lambda: _per_split(frame, {"selected": F.transform(ranked(), lambda s: s["name"])}))

    def process(self, frame, run, path):
        return keep_selected(frame, self.selected(frame, run, path))


def keep_selected(frame: Frame, selected: DataFrame) -> Frame:
    """Columns selected in some split; where a split didn't select one, it is null."""
    some = {x for row in selected.collect() for x in row["selected"]}
    if not some:
        raise ValueError("no column has enough variance")
    kept = [f for f in frame.features if f in some]
    df = frame.df.join(F.broadcast(selected.select("split_id", F.col("selected").alias("_selected"))), "split_id", "left")
    return frame.on(df).add({f: F.when(F.array_contains("_selected", f), c(f)) for f in kept}, [])
