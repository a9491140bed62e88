"""Stateless features: lags, windows, differences, logarithms, dates, holidays and functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rows as rows_of
from ..functions import scalar
from ..functions.names import c
from ..functions.rows import ADD, LOW, TOP, before_block, over_windows
from ..functions.windows import aggregate, correlation, last_known
from ..plans.blocks import Block, Frame, chosen


def _list(x) -> list:
    return list(x) if isinstance(x, (list, range)) else [x]


def _cast(columns: dict[str, Column], kind: str | None) -> dict[str, Column]:
    return {k: v.cast(kind) for k, v in columns.items()} if kind else columns


@dataclass(frozen=True)
class AddLagsX(Block):
    """Columns' values so many rows back, as column~lag_n."""

    columns_and_lags: object  # (columns, lags) or a list of such
    keep_original: bool = True
    output_dtype: str | None = None
    name: str = "lags"
    learns = False

    def _pairs(self):
        return self.columns_and_lags if isinstance(self.columns_and_lags, list) else [self.columns_and_lags]

    @property
    def memory(self):
        return max(n for _, lags in self._pairs() for n in _list(lags))

    def process(self, frame, run, path):
        made = {f"{x}~lag_{n}": F.lag(c(x), n).over(frame.window) for patterns, lags in self._pairs() for x in chosen(frame, patterns) for n in sorted(_list(lags))}
        kept = {f: c(f) for f in frame.features} if self.keep_original else {}
        return frame.add(_cast(kept | made, self.output_dtype), [])


#: Aggregates over all rows so far that are put together from blocks of rows, and what they need of each block; p1 to p4 are sums of powers.
SO_FAR = {"sum": ("sum",), "mean": ("sum", "n"), "min": ("min",), "max": ("max",), "var": ("n", "p1", "p2"), "std": ("n", "p1", "p2"), "sem": ("n", "p1", "p2"), "skew": ("n", "p1", "p2", "p3"), "kurt": ("n", "p1", "p2", "p3", "p4")}
_TOTALS = {"sum": (F.sum, ADD), "n": (F.count, ADD), "min": (F.min, LOW), "max": (F.max, TOP)} | {f"p{k}": (F.sum, ADD) for k in (1, 2, 3, 4)}


def with_earlier(frame: Frame, totals: dict[str, tuple[Column, tuple]]) -> Frame:
    """The frame with columns that aggregate the blocks before each row's: {name: (aggregate of a block's own rows, how aggregates join)}."""
    by = list(frame.by)
    found = frame.df.where("NOT _halo").groupBy(*by).agg(*[x.alias(k) for k, (x, _) in totals.items()])
    earlier = before_block(found, {k: join for k, (_, join) in totals.items()}, [k for k in by if k != "_block"])
    return frame.on(frame.df.join(earlier, by, "left"))


def on_context(frame: Frame, columns: list[str]) -> Frame:
    """The frame with columns of all rows so far right in context rows too, as later windows read them there: from the rows' own blocks."""
    if not frame.ahead:
        return frame
    keys = [*[k for k in frame.by if k != "_block"], "rid"]
    own = frame.df.where("NOT _halo")
    context = frame.df.where("_halo").drop(*columns).join(own.select(*keys, *[c(x) for x in columns]), keys, "left")
    return frame.on(own.unionByName(context))


def with_shifts(frame: Frame, shifts: dict[str, Column]) -> Frame:
    """The frame with a number near each column's values, by which powers of them lose no digits: the mean in the first block of a group that knows any.

    Nothing behind a row's block has a part in it, but in the first block's rows.
    """
    groups = [k for k in frame.by if k != "_block"]
    means = frame.df.where("NOT _halo").groupBy(*frame.by).agg(*[F.avg(x).alias(k) for k, x in shifts.items()])
    found = means.groupBy(*groups).agg(*[F.min_by(k, F.when(F.col(k).isNotNull(), F.col("_block"))).alias(k) for k in shifts])
    # a row a split, or one
    return frame.on(frame.df.join(F.broadcast(found), groups, "left") if groups else frame.df.crossJoin(F.broadcast(found)))


def _so_far(own: Column, earlier: Column, fn, join, every) -> Column:
    """An aggregate over all rows so far, of a block's rows up to this one and of the blocks before."""
    own = fn(F.when(~F.col("_halo"), own)).over(every)
    return F.when(earlier.isNull(), own).when(own.isNull(), earlier).otherwise(join(earlier, own))


def _squares(n: Column, p1: Column, p2: Column) -> Column:
    """Squared deviations from the mean, from sums of powers; what is under the digits of these is 0."""
    m2 = p2 - p1 * p1 / n
    return F.when(m2 > 1e-13 * p2, m2).otherwise(0.0)


def moment(fn: str, n: Column, p: list[Column]) -> Column:
    """var, std, sem, skew or kurt from a count and sums of powers about any number, in pandas' meaning."""
    m2, d = _squares(n, p[0], p[1]), p[0] / n
    less = lambda k: F.nullif(n - k, F.lit(0))
    var = F.when(n > 1, m2 / less(1))
    if fn in ("var", "std", "sem"):
        return {"var": var, "std": F.sqrt(var), "sem": F.sqrt(var) / F.sqrt(less(1))}[fn]
    spread = F.nullif(m2 / n, F.lit(0.0))
    if fn == "skew":
        third = (p[2] - 3 * d * p[1] + 2 * n * d * d * d) / n
        return F.when(n >= 3, third / F.pow(spread, 1.5) * F.sqrt(n * (n - 1)) / less(2))
    fourth = (p[3] - 4 * d * p[2] + 6 * d * d * p[1] - 3 * n * F.pow(d, 4)) / n
    return F.when(n >= 4, ((n + 1) * (fourth / (spread * spread) - 3) + 6) * (n - 1) / (less(2) * less(3)))


@dataclass(frozen=True)
class AddWindowFeatures(Block):
    """Aggregates over the last rows, as column~fn_window, or over all so far (window None), as column~fn_expanding.

    A window of more rows than wide (a block's if None) is put together from pieces of at
    most that many rows, so it needs no context in its block; medians and own functions aren't,
    and make blocks as wide.
    """

    column_window_fn: object  # (columns, window, fn) or a list of such
    fillna: bool = False
    keep_original: bool = True
    output_dtype: str | None = None
    wide: int | None = None
    name: str = "windows"
    learns = False

    def _triples(self):
        return self.column_window_fn if isinstance(self.column_window_fn, list) else [self.column_window_fn]

    def _piece(self) -> int:
        return min(self.wide or rows_of.BLOCK_ROWS, rows_of.BLOCK_ROWS)

    def _is_wide(self, window, fn) -> bool:
        return window is not None and window > self._piece() and isinstance(fn, str) and fn in SO_FAR

    @property
    def memory(self):
        return max(w or 0 for _, w, _ in self._triples())

    @property
    def reach(self):
        return max((w for _, w, fn in self._triples() if w is not None and not self._is_wide(w, fn)), default=0)

    @property
    def so_far(self) -> bool:
        return any(w is None or self._is_wide(w, fn) for _, w, fn in self._triples())

    @property
    def unbounded(self):
        return any(w is None and not (isinstance(fn, str) and fn in SO_FAR) for _, w, fn in self._triples())

    windowed = True

    def process(self, frame, run, path):
        made = {f: c(f) for f in frame.features} if self.keep_original else {}
        every = frame.window.rowsBetween(Window.unboundedPreceding, 0)
        pieced = lambda w, fn: (w is None and not self.unbounded) or self._is_wide(w, fn)
        parts = sorted({(x, part, w or 0) for patterns, w, fn in self._triples() if pieced(w, fn) for x in chosen(frame, patterns) for part in SO_FAR[fn]})
        names = {k: f"_t_{i}" for i, k in enumerate(parts)}
        so_far = {k: name for k, name in names.items() if not k[2]}
        shift = {x: f"_s_{i}" for i, x in enumerate(dict.fromkeys(x for x, part, _ in parts if part.startswith("p")))}
        value = lambda x, part: F.pow(c(x) - F.col(shift[x]), int(part[1])) if part.startswith("p") else c(x)
        if shift:
            frame = with_shifts(frame, {k: c(x) for x, k in shift.items()})
        own_rows = frame.df.where("NOT _halo")
        for window in sorted({w for _, _, w in parts if w}):
            groups = [k for k in frame.by if k != "_block"]
            own = {names[x, part, w]: (value(x, part), *_TOTALS[part]) for x, part, w in parts if w == window}
            found = over_windows(own_rows, own, window, self._piece(), groups)
            frame = frame.on(frame.df.join(found, [*groups, "rid"], "left"))
        if so_far:
            frame = with_earlier(frame, {name: (_TOTALS[part][0](value(x, part)), _TOTALS[part][1]) for (x, part, _), name in so_far.items()})
            # columns of their own, as every mention of a window would be a window
            frame = frame.set(**{f"_u{k}": _so_far(value(x, part), F.col(k), _TOTALS[part][0], _TOTALS[part][1][1], every) for (x, part, _), k in so_far.items()})

        behind = []
        for patterns, window, fn in self._triples():
            label = fn if isinstance(fn, str) else "transformed" if fn.__name__ == "<lambda>" else fn.__name__
            for x in chosen(frame, patterns):
                key = f"{x}~{label}_{'expanding' if window is None else window}"
                total = lambda part, x=x, w=window or 0: F.col(names[x, part, w] if w else f"_u{names[x, part, w]}")
                if not pieced(window, fn):
                    made_of = aggregate(fn, c(x), every if window is None else frame.window.rowsBetween(1 - window, 0))
                elif fn == "mean":
                    made_of = total("sum") / F.nullif(total("n"), F.lit(0))
                elif fn not in ("sum", "min", "max"):
                    made_of = moment(fn, F.nullif(total("n"), F.lit(0)), [total(part) for part in SO_FAR[fn][1:]])
                else:
                    made_of = total(fn)
                if window is None:
                    behind.append(key)
                made[key] = made_of
        if self.fillna:
            made = {k: F.coalesce(v, F.lit(0.0)) for k, v in made.items()}
        frame = frame.add(_cast(made, self.output_dtype), [])
        return on_context(frame, behind) if so_far else frame


@dataclass(frozen=True)
class AddRollingCorrelation(Block):
    """Correlations of two columns over the last rows, as a_b~rolling_corr_window, or over all so far (window None), as a_b~corr_expanding."""

    pairs: object  # (a, b) or a list of such
    window: int | None = 10
    fillna: bool = False
    keep_original: bool = True
    name: str = "rolling correlation"
    learns = False
    windowed = True

    @property
    def memory(self):
        return self.window or 0

    @property
    def so_far(self) -> bool:
        return self.window is None

    def process(self, frame, run, path):
        pairs = self.pairs if isinstance(self.pairs, list) else [self.pairs]
        if self.window is None:
            frame, made = self._so_far(frame, pairs)
        else:
            rows = frame.window.rowsBetween(1 - self.window, 0)
            made = {f"{a}_{b}~rolling_corr_{self.window}": correlation(c(a), c(b), rows) for a, b in pairs}
        if self.fillna:
            made = {k: F.coalesce(v, F.lit(0.0)) for k, v in made.items()}
        frame = frame.add(made, None if self.keep_original else [])
        return on_context(frame, list(made)) if self.window is None else frame

    def _so_far(self, frame: Frame, pairs: list) -> tuple[Frame, dict[str, Column]]:
        """From counts and sums of products of the blocks before and of the own one."""
        every = frame.window.rowsBetween(Window.unboundedPreceding, 0)
        known = {i: c(a).isNotNull() & c(b).isNotNull() for i, (a, b) in enumerate(pairs)}
        frame = with_shifts(frame, {f"_s_{i}_{j}": F.when(known[i], c(x)) for i, pair in enumerate(pairs) for j, x in enumerate(pair)})
        centred = lambda i, j: F.when(known[i], c(pairs[i][j]) - F.col(f"_s_{i}_{j}"))
        sums = {}
        for i in known:
            x, y = centred(i, 0), centred(i, 1)
            sums |= {(i, k): v for k, v in {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}.items()}
        names = {k: f"_t_{k[0]}_{k[1]}" for k in sums} | {(i, "n"): f"_t_{i}_n" for i in known}
        frame = with_earlier(frame, {names[k]: (F.count(sums[k[0], "x"]) if k[1] == "n" else F.sum(sums[k]), ADD) for k in names})
        # columns of their own, as every mention of a window would be a window
        frame = frame.set(**{f"_u{name}": _so_far(sums[i, "x" if k == "n" else k], F.col(name), F.count if k == "n" else F.sum, ADD[1], every) for (i, k), name in names.items()})
        total = lambda i, k: F.col(f"_u{names[i, k]}")
        made = {}
        for i, (a, b) in enumerate(pairs):
            n, x, y = F.nullif(total(i, "n"), F.lit(0)), total(i, "x"), total(i, "y")
            spread = F.sqrt(_squares(n, x, total(i, "xx")) * _squares(n, y, total(i, "yy")))
            made[f"{a}_{b}~corr_expanding"] = (total(i, "xy") - x * y / n) / F.nullif(spread, F.lit(0.0))
        return frame, made


def _capped(x: Column, before: Column, undefined: float | None) -> Column:
    # near zero a return says little: the difference then
    return F.when((before > -1) & (before < 1), x - before).otherwise(x / F.nullif(before, F.lit(0.0)) - 1)


DIFFERENCES: dict[str, Callable[[Column, Column, float | None], Column]] = {
    "diff": lambda x, before, undefined: x - before,
    "returns": lambda x, before, undefined: scalar.ratio(x, before, undefined) - 1,
    "log_returns": lambda x, before, undefined: scalar.log(scalar.ratio(x, before, undefined)),
    "capped_returns": _capped,
}


@dataclass(frozen=True)
class Difference(Block):
    """Change against the row before; without memory (the default) the first row of each test window is null.

    undefined: the return from 0 to 0. Null counts as missing in whatever follows; NaN
    tells it from a row that has none before it.
    """

    method: str = "diff"
    clip_threshold: float | None = None
    fill_0_with_last: bool = False
    rows_of_memory: int = 0
    name: str = "difference"
    undefined: float | None = None
    learns = False

    @property
    def memory(self):
        return self.rows_of_memory

    @property
    def so_far(self) -> bool:
        return self.fill_0_with_last

    @property
    def reach(self):
        return max(1, self.rows_of_memory)

    def process(self, frame, run, path):
        made = {}
        for f in frame.features:
            x = DIFFERENCES[self.method](c(f), F.lag(c(f), 1).over(frame.window), self.undefined)
            if self.clip_threshold is not None:
                x = F.when(F.isnan(x), x).when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(self.clip_threshold))), F.lit(-float(self.clip_threshold))))
            made[f] = x
        frame = frame.add(made)
        if self.fill_0_with_last:
            # the last change of a block before stands in where the own block has none so far
            change = {f: F.nullif(scalar.nan_to_null(c(f)), F.lit(0.0)) for f in frame.features}
            frame = with_earlier(frame, {f"_t_{i}": (F.max(F.when(x.isNotNull(), F.struct("rid", x.alias("x")))), TOP) for i, x in enumerate(change.values())})
            frame = frame.add({f: F.when(c(f).isNotNull(), F.coalesce(last_known(F.when(~F.col("_halo"), x), frame.window), F.col(f"_t_{i}.x"))) for i, (f, x) in enumerate(change.items())})
            frame = on_context(frame, list(frame.features))
        return frame


@dataclass(frozen=True)
class TakeLog(Block):
    base: str = "e"
    name: str = "log"
    learns = False

    def process(self, frame, run, path):
        return frame.add({f: scalar.log(c(f), self.base) for f in frame.features})

    def inverse(self, frame, run, path, names):
        return frame.add({n: scalar.exponential(c(n), self.base) for n in names})


@dataclass(frozen=True)
class MultiplyBy(Block):
    constant: float
    name: str = "multiply"
    learns = False

    def process(self, frame, run, path):
        return frame.add({f: c(f) * self.constant for f in frame.features})

    def inverse(self, frame, run, path, names):
        return frame.add({n: c(n) / self.constant for n in names})


@dataclass(frozen=True)
class AddFeatures(Block):
    """Functions of each of the columns chosen, as column~fn; of a tuple of columns, one function of all of them, as a-b~fn."""

    column_fn: object  # (columns, fn) or a list of such
    past_window_size: int = 0
    keep_original: bool = True
    name: str = "functions"
    learns = False

    @property
    def memory(self):
        return self.past_window_size

    def process(self, frame, run, path):
        made = {}
        for patterns, fn in self.column_fn if isinstance(self.column_fn, list) else [self.column_fn]:
            label = "transformed" if getattr(fn, "__name__", "<lambda>") == "<lambda>" else fn.__name__
            if isinstance(patterns, tuple):
                made["-".join(patterns) + f"~{label}"] = fn(*[c(x) for x in patterns])
                continue
            for x in chosen(frame, patterns):
                made[f"{x}~{label}"] = fn(c(x))
        return frame.add(made, None if self.keep_original else [])


@dataclass(frozen=True)
class ApplyFunction(Block):
    """A function from the frame's DataFrame to one with the same rows and keys; its other columns are the features."""

    fn: Callable[[DataFrame], DataFrame]
    past_window_size: int = 0
    fillna: bool = False
    name: str = "function"
    learns = False

    @property
    def memory(self):
        return self.past_window_size

    def process(self, frame, run, path):
        out = self.fn(frame.df)
        known = set(frame.df.columns) - set(frame.features)
        features = tuple(f for f in out.columns if f not in known)
        frame = replace(frame, df=out, features=features)
        return frame.add({f: F.coalesce(c(f), F.lit(0.0)) for f in features}) if self.fillna else frame


@dataclass(frozen=True)
class AddDateTimeFeatures(Block):
    features: tuple
    keep_original: bool = True
    name: str = "date parts"
    learns = False

    def process(self, frame, run, path):
        made = {f"datetime~{p}": scalar.DATE_PARTS[p](F.col("ts")) for p in self.features}
        return frame.add(made, None if self.keep_original else [])


@dataclass(frozen=True)
class AddHolidayFeatures(Block):
    """holiday_code of each calendar: a table of (code, day, holiday), joined by day.

    labeling: "binary" (1 on holidays), "weekday_weekend_holiday" (0, 1 on
    weekends, 2 on holidays), "unique" (a number from 2 for each holiday by
    name, 1 on weekends, 0 else), or "string" (the name, "1" on weekends, "0" else).
    """

    calendar: DataFrame
    codes: tuple
    labeling: str = "weekday_weekend_holiday"
    keep_original: bool = True
    name: str = "holidays"
    learns = False

    def process(self, frame, run, path):
        df, made = frame.df.withColumn("_day", F.to_date("ts")), {}
        for code in self.codes:
            own = self.calendar.where(F.col("code") == code).groupBy("day").agg(F.min("holiday").alias("holiday"))
            if self.labeling == "unique":
                own = own.join(own.select("holiday").distinct().withColumn("number", F.row_number().over(Window.orderBy("holiday")) + 1), "holiday")
            own = own.withColumnsRenamed({"day": "_day", "holiday": f"_h_{code}", "number": f"_n_{code}"})
            df = df.join(own, "_day", "left")
            h = F.col(f"_h_{code}")
            made[f"holiday_{code}"] = {
                "binary": lambda h=h: F.when(h.isNotNull(), 1).otherwise(0),
                "weekday_weekend_holiday": lambda h=h: F.when(h.isNotNull(), 2).otherwise(scalar.weekend(F.col("ts"))),
                "unique": lambda code=code: F.coalesce(F.col(f"_n_{code}"), scalar.weekend(F.col("ts"))),
                "string": lambda h=h: F.coalesce(h, scalar.weekend(F.col("ts")).cast("string")),
            }[self.labeling]()
        return frame.on(df).add(made, None if self.keep_original else [])
