"""How an ordered series is cut into train and test windows.

Windows are half-open ranges of row numbers and are planned on the driver from
the number of rows alone; the plan is small, and is joined to rows as a
broadcast table or by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True, order=True)
class Bounds:
    start: int
    end: int

    def __len__(self) -> int:
        return max(0, self.end - self.start)

    def union(self, other: Bounds) -> Bounds:
        return Bounds(min(self.start, other.start), max(self.end, other.end))

    def intersection(self, other: Bounds) -> Bounds | None:
        start, end = max(self.start, other.start), min(self.end, other.end)
        return Bounds(start, end) if start < end else None


@dataclass(frozen=True)
class Split:
    split_id: int
    train: tuple[Bounds, ...]
    test: tuple[Bounds, ...]

    def train_rows(self) -> list[int]:
        return [i for b in self.train for i in range(b.start, b.end)]

    def test_rows(self) -> list[int]:
        return [i for b in self.test for i in range(b.start, b.end)]


def merge_neighbours(bounds: list[Bounds]) -> list[Bounds]:
    """Ranges that touch or overlap become one."""
    out: list[Bounds] = []
    for b in sorted(bounds):
        if out and b.start <= out[-1].end:
            out[-1] = out[-1].union(b)
        else:
            out.append(b)
    return out


def rows_in(size: int | float, n: int) -> int:
    """A window's rows: a whole number from 1 as it is, a fraction under 1 of n rounded down."""
    if isinstance(size, float) and not size < 1 or size <= 0:
        raise ValueError(f"a window is a whole number from 1 or a fraction under 1, not {size}")
    return int(size * n) if isinstance(size, float) else int(size)


#: Looks up the row number of a timestamp.
Place = Callable[[object], int]


def _row(value, n: int, place: Place | None) -> int:
    if value is None:
        return n
    if isinstance(value, int):
        return value
    if place is None:
        raise ValueError("a timestamp needs a look-up")
    return place(value)


@dataclass(frozen=True)
class ExpandingWindowSplitter:
    initial_train_window: int | float
    step: int | float
    start: object = 0
    subtract_initial_train_window_from_start: bool = False
    end: object = None
    overlapping_test_sets: bool = False

    def splits(self, n: int, place: Place | None = None) -> list[Split]:
        first, step = rows_in(self.initial_train_window, n), rows_in(self.step, n)
        start, end = _row(self.start, n, place), _row(self.end, n, place)
        if self.subtract_initial_train_window_from_start:
            start -= first
        test = lambda i: Bounds(i, end if self.overlapping_test_sets else min(end, i + step))
        return [Split(k, (Bounds(start, i),), (test(i),)) for k, i in enumerate(range(start + first, end, step))]


@dataclass(frozen=True)
class SlidingWindowSplitter:
    train_window: int | float
    step: int | float
    initial_window: int | float | None = None
    start: object = 0
    subtract_initial_train_window_from_start: bool = False
    end: object = None
    overlapping_test_sets: bool = False

    def splits(self, n: int, place: Place | None = None) -> list[Split]:
        window, step = rows_in(self.train_window, n), rows_in(self.step, n)
        first = window if self.initial_window is None else rows_in(self.initial_window, n)
        start, end = _row(self.start, n, place), _row(self.end, n, place)
        if self.subtract_initial_train_window_from_start:
            start -= first
        test = lambda i: Bounds(i, end if self.overlapping_test_sets else min(end, i + step))
        return [Split(k, (Bounds(max(i - window, start), i),), (test(i),)) for k, i in enumerate(range(start + first, end, step))]


@dataclass(frozen=True)
class ForwardSingleWindowSplitter:
    train_window: int | float

    def splits(self, n: int, place: Place | None = None) -> list[Split]:
        at = rows_in(self.train_window, n)
        return [Split(0, (Bounds(0, at),), (Bounds(at, n),))]


@dataclass(frozen=True)
class WholeWindowSplitter:
    """Trains on everything, tests on the last rows: in sample."""

    test_window: int | float

    def splits(self, n: int, place: Place | None = None) -> list[Split]:
        return [Split(0, (Bounds(0, n),), (Bounds(n - rows_in(self.test_window, n), n),))]


@dataclass(frozen=True)
class CombinedSplitter:
    train_val_splitters: tuple = field(default=())
    test_splitter: object = None

    def splits(self, n: int, place: Place | None = None) -> list[Split]:
        every = [*self.train_val_splitters, *([self.test_splitter] if self.test_splitter else [])]
        found = [s for splitter in every for s in splitter.splits(n, place)]
        return [replace(s, split_id=k) for k, s in enumerate(found)]


def plan_splits(splitter, n: int, gap_before: int = 0, gap_after: int = 0, merge_threshold: float = 0.1, place: Place | None = None) -> list[Split]:
    """A splitter's windows with purged and embargoed rows left out of training, and a last test window that is too small merged into the one before."""
    found = []
    for s in splitter.splits(n, place):
        train = s.train
        if gap_after:
            train = tuple(Bounds(b.start + gap_after, b.end) if any(t.end <= b.start for t in s.test) else b for b in train)
        if gap_before:
            train = tuple(Bounds(b.start, b.end - gap_before) if any(t.start >= b.end for t in s.test) else b for b in train)
        found.append(replace(s, train=train))
    if not found:
        raise ValueError("no window fits into the series")
    if len(found) > 1 and sum(map(len, found[-1].test)) <= int(n * merge_threshold):
        last = found.pop()
        found[-1] = replace(found[-1], test=tuple(merge_neighbours([*found[-1].test, *last.test])))
    return found


def splits_table(spark: SparkSession, splits: list[Split]) -> DataFrame:
    """(split_id, tr_start, tr_end, te_start, te_end); a split of several ranges has a row for each pair."""
    rows = [(s.split_id, a.start, a.end, b.start, b.end) for s in splits for a in s.train for b in s.test]
    return spark.createDataFrame(rows, "split_id long, tr_start long, tr_end long, te_start long, te_end long")


def even_step(splits: list[Split]) -> int | None:
    """The step if test windows are adjacent and, but for the last, of one size."""
    tests = [t for s in splits for t in s.test]
    if len(tests) != len(splits) or any(a.end != b.start for a, b in zip(tests, tests[1:])):
        return None
    sizes = {len(t) for t in tests[:-1]} or {len(tests[0])}
    return sizes.pop() if len(sizes) == 1 else None


def stretches(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, lo, hi): of each stretch between neighbouring borders of ranges (id, start, end), the ids that cover it as runs lo to hi."""
    ranges = [r for r in ranges if r[1] < r[2]]
    if not ranges:
        return []
    least = min(r[0] for r in ranges)
    borders = sorted({x for _, a, b in ranges for x in (a, b)})
    place = {x: i for i, x in enumerate(borders)}
    change = [[] for _ in borders]
    for k, a, b in ranges:
        change[place[a]].append((k - least, 1))
        change[place[b]].append((k - least, -1))
    cover, out = np.zeros(max(r[0] for r in ranges) - least + 1, np.int64), []
    for i, (a, b) in enumerate(zip(borders, borders[1:])):
        for k, by in change[i]:
            cover[k] += by
        edge = np.flatnonzero(np.diff(cover > 0, prepend=False, append=False))
        out += [(a, b, int(lo) + least, int(hi) - 1 + least) for lo, hi in edge.reshape(-1, 2)]
    return out


def located(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """rows beside those of a table (start, end, ...) planned on the driver whose range holds their rid: an equality join by a part of the rid.

    The parts are as wide as a stretch is on the average, so a row meets few candidates, and the table stays in proportion to its rows.
    """
    first, end = min(t[0] for t in table), max(t[1] for t in table)
    width = max(1, -(-(end - first) // max(1, len({t[0] for t in table}))))
    parts = [(k, *t) for t in table for k in range(t[0] // width, (t[1] - 1) // width + 1)]
    small = rows.sparkSession.createDataFrame(parts, f"_part long, _start long, _end long, {schema}")
    inside = (F.col("rid") >= F.col("_start")) & (F.col("rid") < F.col("_end"))
    cut = rows.withColumn("_own", F.expr(f"rid div {width}"))
    return cut.join(F.broadcast(small), (F.col("_own") == F.col("_part")) & inside).drop("_own", "_part", "_start", "_end")


def dealt(rows: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """rows once for each range (id, start, end) that holds their rid, with split_id.

    Ranges are turned into stretches of one set of ids, and these into runs of ids, so
    the table that rows meet has a row a stretch and run, not one a range.
    """
    table = stretches(ranges)
    if not table:
        return rows.where("false").withColumn("split_id", F.lit(None).cast("long"))
    return located(rows, table, "_lo long, _hi long").withColumn("split_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def tag_test_rows(rows: DataFrame, splits: list[Split], memory: int = 0) -> DataFrame:
    """rows with split_id and halo: each split's test rows, and before them memory rows of context (halo is true there).

    With even windows the split is arithmetic on rid, without any join; a row
    also goes to the next splits whose context it is in.
    """
    step, first = even_step(splits), splits[0].test[0].start
    if step and memory <= step:
        end = splits[-1].test[-1].end
        ids = [s.split_id for s in splits]
        own = F.least(F.floor((F.col("rid") - first) / step), F.lit(len(splits) - 1)).cast("long")
        lead = F.floor((F.col("rid") + memory - first) / step).cast("long")
        in_own = F.when(F.col("rid") >= first, own)
        in_next = F.when((F.col("rid") + memory >= first) & (lead < len(splits)) & (F.coalesce(in_own, F.lit(-1).cast("long")) < lead), lead)
        both = rows.where((F.col("rid") >= first - memory) & (F.col("rid") < end)).withColumn("split_id", F.explode(F.array_compact(F.array(in_own, in_next))))
        both = both.withColumn("halo", F.col("rid") < first + F.col("split_id") * step)
        if ids != list(range(len(ids))):
            both = both.withColumn("split_id", F.element_at(F.array(*[F.lit(i).cast("long") for i in ids]), (F.col("split_id") + 1).cast("int")))
        return both
    return _pieces(rows, [(s.split_id, max(t.start - memory, 0), t.start, t.end) for s in splits for t in s.test]).drop("_run")


def _pieces(rows: DataFrame, pieces: list[tuple[int, int, int, int]]) -> DataFrame:
    """rows of each piece (split_id, context, start, end) with split_id, halo (from context to start) and the piece's number _run."""
    tagged = dealt(rows, [(k, context, end) for k, (_, context, _, end) in enumerate(pieces)]).withColumnRenamed("split_id", "_run")
    small = rows.sparkSession.createDataFrame([(k, x, start) for k, (x, _, start, _) in enumerate(pieces)], "_run long, split_id long, _first long")  # a row a piece
    return tagged.join(F.broadcast(small), "_run").withColumn("halo", F.col("rid") < F.col("_first")).drop("_first")


def tag_train_rows(rows: DataFrame, splits: list[Split]) -> DataFrame:
    """rows once for each split that trains on them."""
    return dealt(rows, [(s.split_id, b.start, b.end) for s in splits for b in s.train])


def tag_last_train_rows(rows: DataFrame, splits: list[Split], context: int) -> DataFrame:
    """rows once each, with the last split that trains on them; before each run of one such split, context rows (halo) inside its train window."""
    windows = {s.split_id: s.train for s in splits}
    runs: list[list[int]] = []
    for a, b, _, k in sorted(stretches([(s.split_id, t.start, t.end) for s in splits for t in s.train])):
        if runs and runs[-1][1:] == [a, b]:
            runs[-1][0] = max(runs[-1][0], k)
        else:
            runs.append([k, a, b])
    joined: list[list[int]] = []
    for k, a, b in runs:
        if joined and joined[-1][0] == k and joined[-1][2] == a:
            joined[-1][2] = b
        else:
            joined.append([k, a, b])
    start = lambda k, a: max(t.start for t in windows[k] if t.start <= a)
    return _pieces(rows, [(k, max(start(k, a), a - context), a, b) for k, a, b in joined])
