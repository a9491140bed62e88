"""Functions of numpy arrays, for what no Column expression states: of blocks of rows in order, or of each row's window."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import c
from ..plans.blocks import Block, Frame, chosen

#: Numbers in the windows that a function is given at once.
_CELLS = 1 << 22


def _by_block(frame: Frame, names: list[str], outputs: list[str], compute: Callable) -> Frame:
    """The frame with float columns outputs, of compute(values, context): rows x columns in order, nulls as NaN, and which rows are context.

    A task holds a block's rows and their context, whatever the length of the series. NaN comes back as null.
    """
    kept = [f for f in frame.df.columns if f not in outputs]
    schema = T.StructType([*[frame.df.schema[k] for k in kept], *[T.StructField(k, T.DoubleType()) for k in outputs]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        values = np.column_stack([table[n].cast(pa.float64()).to_numpy() for n in names])
        context = table["_halo"].to_numpy() if "_halo" in table.column_names else np.zeros(len(values), bool)
        made = compute(values, context)
        table = table.select(kept)
        for i, k in enumerate(outputs):
            table = table.append_column(k, pa.array(made[:, i], pa.float64(), from_pandas=True))
        return table

    df = frame.df.groupBy(*frame.by).applyInArrow(run, schema)
    return replace(frame, df=df, features=(*[f for f in frame.features if f not in outputs], *outputs))


def _finished(frame: Frame, outputs: list[str], fillna: bool, kind: str | None, keep: list[str]) -> Frame:
    def one(x):
        value = c(x)
        if fillna:
            value = F.when(value.isNull() | (F.abs(value) == float("inf")), 0.0).otherwise(value)
        return value.cast(kind) if kind else value

    return frame.add({k: one(k) for k in outputs}, keep)


@dataclass(frozen=True)
class ApplyArrays(Block):
    """A function from an array of rows x columns, in order, to one of as many rows.

    It is called for each block of rows, with past_window_size rows of context before
    it, so a row's result may depend on that many rows before it and on none behind.
    outputs: names of what comes back (the columns' own if None, which it then replaces).
    batch_columns: how many columns a call is given; each call then gives back as many.
    Nulls are NaN, and NaN comes back as null; fillna puts 0 for nulls and infinities.
    ValueError in the job where the result has another shape.
    """

    fn: Callable[[np.ndarray], np.ndarray]
    past_window_size: int = 0
    columns: object = "all"
    outputs: tuple | None = None
    batch_columns: int | None = None
    fillna: bool = False
    output_dtype: str | None = None
    name: str = "arrays"
    learns = False
    windowed = True

    def __post_init__(self):
        if self.batch_columns is not None and (self.outputs is not None or self.batch_columns < 1):
            raise ValueError("batches give back their own columns, at least one at a time")

    @property
    def memory(self):
        return self.past_window_size

    def process(self, frame, run, path):
        names = chosen(frame, self.columns)
        outputs = list(self.outputs or names)
        fn, step = self.fn, self.batch_columns or len(names)

        def compute(values, context):
            made = [np.asarray(fn(values[:, i : i + step]), float).reshape(len(values), -1) for i in range(0, len(names), step)]
            made = np.hstack(made)
            if made.shape[1] != len(outputs):
                raise ValueError(f"{made.shape[1]} columns for {len(outputs)} names")
            return made

        # a column that comes back under its own name is read before it is replaced
        return _finished(_by_block(frame, names, outputs, compute), outputs, self.fillna, self.output_dtype, list(frame.features))


@dataclass(frozen=True)
class RollingArrays(Block):
    """A function of each row's last window rows of a column, as column~label_window: from an array of windows x rows to a number for each window.

    The first rows of a series have shorter windows. Windows are views of a block's
    values and reach the function some millions of numbers at a time. Nulls are NaN, and NaN comes back as null.
    """

    fn: Callable[[np.ndarray], np.ndarray]
    window: int
    columns: object = "all"
    label: str = "transformed"
    fillna: bool = False
    keep_original: bool = True
    output_dtype: str | None = None
    name: str = "rolling arrays"
    learns = False
    windowed = True

    @property
    def memory(self):
        return self.window

    def process(self, frame, run, path):
        names, fn, w = chosen(frame, self.columns), self.fn, self.window
        outputs = [f"{x}~{self.label}_{w}" for x in names]

        def of_column(x, context):
            out = np.full(len(x), np.nan)
            for i in np.flatnonzero(~context[: w - 1]):
                out[i] = np.asarray(fn(x[None, : i + 1]), float)[0]
            if len(x) >= w:
                windows = np.lib.stride_tricks.sliding_window_view(x, w)
                step = max(1, _CELLS // w)
                for i in range(0, len(windows), step):
                    out[w - 1 + i : w - 1 + i + step] = np.asarray(fn(windows[i : i + step]), float)
            return out

        def compute(values, context):
            return np.column_stack([of_column(values[:, i], context) for i in range(len(names))])

        return _finished(_by_block(frame, names, outputs, compute), outputs, self.fillna, self.output_dtype, list(frame.features) if self.keep_original else [])
