"""Fitting all splits from moments, without repeating rows.

Overlapping train windows would send a row to every split that trains on it. Many
pipelines learn only from counts, means, covariances, minima and maxima, and what
they make of a column is affine in it: scalers, least squares, what a model leaves
over, a scaled target, a mean of predictions. Such a pipeline is followed twice.

First by names: columns that windows and functions make become base columns of one
frame, and every learner notes which base columns it needs in which rows. One job
then takes these moments for each stretch between neighbouring window borders, and
they are merged for each split. Then by numbers, split by split on the driver: a
column is a constant and a weight for each base column, so its moments, and those of
residuals and predictions, follow from the base columns'. Work grows with rows plus
splits times stretches, not with rows times splits.

Pipelines that learn from anything else raise Unfollowed and are fitted on tagged rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import PREDICTION, PROBABILITY, c, prediction, select
from ..functions.rows import blocked
from ..operators import columns as cols
from ..operators import composites as comp
from ..operators import features as feat
from ..operators import models as mod
from .blocks import Block, Frame, Identity, Run, Sequence, as_block, reach_of, traverse
from .splits import Split, located


class Unfollowed(Exception):
    """A pipeline that learns from more than moments of affine columns."""


@dataclass
class Moments:
    """Of several columns: counts (or weights), means, sums of squared (or of products of) deviations, minima, maxima."""

    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        safe = np.where(n > 0, n, 1)
        shift = other.mean - self.mean
        if self.spread.ndim == 2:
            cross = np.outer(shift, shift) * (self.n * other.n / safe)[0]
        else:
            cross = shift * shift * self.n * other.n / safe
        return Moments(n, self.mean + shift * other.n / safe, self.spread + other.spread + cross, np.fmin(self.low, other.low), np.fmax(self.high, other.high))


#: Blocks whose value in a row depends on that row and so many rows before it alone.
_LOCAL = (feat.AddLagsX, feat.TakeLog, feat.MultiplyBy, feat.AddFeatures, feat.AddDateTimeFeatures, feat.AddHolidayFeatures, cols.Choice, Identity)


def is_local(block: Block) -> bool:
    if isinstance(block, feat.AddWindowFeatures):
        return not block.so_far
    if isinstance(block, feat.AddRollingCorrelation):
        return block.window is not None
    return isinstance(block, _LOCAL) or isinstance(block, feat.Difference) and not block.fill_0_with_last


@dataclass(frozen=True)
class Col:
    """const + the sum of weights of base columns, null where a base column of needs is. known: false if null throughout. affine: false if it may only be passed on."""

    const: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    needs: frozenset[str] = frozenset()
    known: bool = True
    affine: bool = True

    def times(self, scale: float, shift: float = 0.0) -> Col:
        return replace(self, const=self.const * scale + shift, weights={k: v * scale for k, v in self.weights.items()})

    def plus(self, other: Col) -> Col:
        weights = dict(self.weights)
        for k, v in other.weights.items():
            weights[k] = weights.get(k, 0.0) + v
        return Col(self.const + other.const, weights, self.needs | other.needs, self.known and other.known, self.affine and other.affine)

    @property
    def base(self) -> str | None:
        """The base column that this is unchanged."""
        return next(iter(self.weights)) if self.affine and self.const == 0 and list(self.weights.values()) == [1.0] and self.needs == frozenset(self.weights) else None


def passed_on(needs: frozenset[str] = frozenset()) -> Col:
    return Col(needs=needs, affine=False)


#: The base columns, the columns that must be known in a row, and whether rows weigh.
Request = tuple[tuple[str, ...], frozenset[str], bool]


class Fit:
    """What is noted while a pipeline is followed. frame: only by names; moments: only by numbers."""

    def __init__(self, frame: Frame | None, weighted: bool):
        self.frame, self.weighted = frame, weighted
        self.made: dict[str, dict[str, str]] = {}
        self.requests: dict[Request, None] = {}
        self.moments: Callable[[Request], Moments] | None = None
        self.states: dict[str, list[tuple]] = {}
        self.schemas: dict[str, str] = {}
        self.y = Col(weights={"y": 1.0}, needs=frozenset({"y"}))
        self.only: frozenset[str] = frozenset()

    def made_by(self, path: str, make: Callable[[Frame], Frame], given: dict[str, str]) -> dict[str, Col]:
        """New base columns, made of given ones ({name: base column}) by a function of a frame."""
        if self.moments is None:
            self.frame = make(self.frame.restore(given))
            self.frame, self.made[path] = self.frame.hide(f"m{len(self.made)}")
        return {n: Col(weights={h: 1.0}, needs=frozenset({h})) for n, h in self.made[path].items()}

    def of(self, columns: list[Col], known: frozenset[str], weighted: bool = False) -> Moments:
        """Joint moments of affine columns over the rows where known base columns are known."""
        bases = tuple(sorted({k for x in columns for k in x.weights}))
        request = (bases, known | self.only, weighted)
        if self.moments is None:
            self.requests[request] = None
            k = len(bases)
            m = Moments(np.ones(1), np.zeros(k), np.eye(k), np.zeros(k), np.ones(k))
        else:
            m = self.moments(request)
        a = np.array([[x.weights.get(k, 0.0) for k in bases] for x in columns]).reshape(len(columns), len(bases))
        const = np.array([x.const for x in columns])
        ends = np.stack([a * m.low, a * m.high]) if len(bases) else np.zeros((2, len(columns), 0))
        single = (a != 0).sum(1) <= 1
        low, high = (np.where(single, f(ends, axis=0).sum(1) + const, np.nan) for f in (np.min, np.max))
        n = np.full(len(columns), m.n[0])
        if not n.any():
            low = high = np.full(len(columns), np.nan)
        return Moments(n, a @ m.mean + const, a @ m.spread @ a.T, low, high)

    def keep(self, path: str, schema: str, state: tuple) -> None:
        self.schemas[path] = schema
        self.states.setdefault(path, []).append(state)


def _column_moments(fit: Fit, columns: list[Col]) -> Moments:
    each = [fit.of([x], x.needs) for x in columns]
    joint = lambda name: np.array([getattr(m, name).ravel()[0] for m in each])
    dead = np.array([not x.known for x in columns])
    return Moments(np.where(dead, 0, joint("n")), joint("mean"), joint("spread"), np.where(dead, np.nan, joint("low")), np.where(dead, np.nan, joint("high")))


def follow(block: Block, columns: dict[str, Col], path: str, fit: Fit, split: int) -> dict[str, Col]:
    """The columns after a block; learners leave their split's state in fit."""
    block = as_block(block)
    under = lambda i, child, given: follow(child, given, f"{path}:{i}", fit, split)
    if isinstance(block, Sequence):
        for i, step in enumerate(block.steps):
            columns = follow(step, columns, f"{path}/{i}", fit, split)
        return columns
    if isinstance(block, cols.Choice):
        return {new: columns[old] for new, old in block.mapping(list(columns)).items()}
    if isinstance(block, Identity):
        return columns
    if isinstance(block, feat.MultiplyBy) and all(x.affine for x in columns.values()):
        return {n: x.times(block.constant) for n, x in columns.items()}
    if is_local(block):
        bases = {n: x.base for n, x in columns.items()}
        if None in bases.values():
            raise Unfollowed(f"{block.name} of learnt columns")
        return fit.made_by(path, lambda frame: block.process(frame, Run(), path), bases)
    if hasattr(block, "affine"):
        return _scaled(block, columns, path, fit, split)
    if isinstance(block, mod.LinearRegression):
        return {PREDICTION + block.name: _least_squares(block, columns, path, fit, split)}
    if isinstance(block, mod.DummyRegressor):
        return {PREDICTION + block.name: Col(float(block.predicted_value))}
    if isinstance(block, mod.DummyClassifier):
        values = {PREDICTION + block.name: block.predicted_value} | {f"{PROBABILITY}{block.name}_{k}": p for k, p in zip(block.all_classes, block.predicted_probabilities, strict=True)}
        return {k: Col(float(v)) for k, v in values.items()}
    if isinstance(block, mod.RandomClassifier):
        return {PREDICTION + block.name: passed_on()} | {f"{PROBABILITY}{block.name}_{k}": passed_on() for k in block.all_classes}
    if isinstance(block, comp.Concat):
        outs = [under(i, p, columns) for i, p in enumerate(block.pipelines)]
        holders: dict[str, list[Col]] = {}
        for out in outs:
            for n, x in out.items():
                holders.setdefault(n, []).append(x)
        order = sorted(holders, key=lambda n: len(holders[n]) > 1)
        merged = lambda xs: passed_on() if block.custom_merge_logic else xs[0 if block.if_duplicate_keep == "first" else -1]
        return {n: merged(holders[n]) if len(holders[n]) > 1 else holders[n][0] for n in order}
    if isinstance(block, comp.TransformColumn):
        out = under(0, block.pipeline, {n: columns[n] for n in select(block.columns, list(columns))})
        return {n: x for n, x in columns.items() if n not in out} | out
    if isinstance(block, comp.TransformEachColumn):
        return {n: x for i, (f, own) in enumerate(columns.items()) for n, x in under(i, block.pipeline, {f: own}).items()}
    if isinstance(block, comp.EnsembleEachColumn):
        return _averaged([under(i, block.pipeline, {f: own}) for i, (f, own) in enumerate(columns.items())], block.name)
    if isinstance(block, comp.Ensemble):
        return _averaged([under(i, p, columns) for i, p in enumerate(block.pipelines)], block.name, not block.reconstruct_predictions_from_probabilities)
    if isinstance(block, comp.ModelResiduals):
        first = follow(block.primary, columns, f"{path}p:0", fit, split)
        p = first[prediction(list(first))]
        if not p.affine or not fit.y.affine:
            raise Unfollowed("residuals of a prediction that isn't affine")
        before, fit.y = (fit.y, fit.weighted), fit.y.plus(p.times(-1.0))
        fit.weighted = False
        second = follow(block.meta, columns, f"{path}m:0", fit, split)
        fit.y, fit.weighted = before
        made = {PREDICTION + block.name: p.plus(second[prediction(list(second))])}
        return made | (first if block.primary_output_included else {})
    if isinstance(block, comp.TransformTarget):
        before, target = fit.y, {"_target": fit.y}
        for i, step in enumerate(block.y_pipeline):
            target = follow(step, target, f"{path}y{i}", fit, split)
        fit.y = next(iter(target.values()))
        out = follow(block.wrapped_pipeline, columns, path + "w", fit, split)
        fit.y = before
        return {n: passed_on(x.needs) for n, x in out.items()}
    if isinstance(block, comp.SkipNA) and not any(b.windowed for b in traverse(as_block(block.pipeline))):
        if not all(x.affine and x.known for x in columns.values()):
            raise Unfollowed("rows without a null of learnt columns")
        before, fit.only = fit.only, fit.only | frozenset().union(*[x.needs for x in columns.values()])
        out = follow(block.pipeline, columns, path + "s", fit, split)
        fit.only = before
        return {n: replace(x, needs=x.needs | frozenset().union(*[y.needs for y in columns.values()])) for n, x in out.items()}
    if isinstance(block, comp.SelectBest):
        return follow(block.found(), columns, path + "b", fit, split)
    raise Unfollowed(block.name)


def _scaled(block, columns: dict[str, Col], path: str, fit: Fit, split: int) -> dict[str, Col]:
    """Scalers: their state follows from each column's own moments."""
    every = list(columns.values())
    if not all(x.affine for x in every) or not block.by_deviation and any(len(x.weights) > 1 for x in every):
        raise Unfollowed(f"{block.name} of columns that aren't affine in one")
    state = block.state_from(_column_moments(fit, every))
    fit.keep(path, block.state_schema(len(every)), (split, *state))
    out = {}
    for i, (n, x) in enumerate(columns.items()):
        how = block.affine(state, i)
        out[n] = passed_on(x.needs) if how is False else replace(x, known=False) if how is None else x.times(*how)
    return out


def _least_squares(block, columns: dict[str, Col], path: str, fit: Fit, split: int) -> Col:
    every = [*columns.values(), fit.y]
    if not all(x.affine for x in every):
        raise Unfollowed(f"{block.name} of columns that aren't affine")
    needs = frozenset().union(*[x.needs for x in columns.values()])
    m = fit.of(every, needs | fit.y.needs, fit.weighted)
    fit.schemas[path] = block.state_schema(len(every))
    if not m.n[0] or not all(x.known for x in every):
        return Col(needs=needs, known=False)
    state = block.state_from(m)
    fit.keep(path, block.state_schema(len(every)), (split, *state))
    (constant, *slopes), = state
    return replace(reduce(Col.plus, [x.times(b) for x, b in zip(columns.values(), slopes)], Col(constant)), needs=needs)


def _averaged(outs: list[dict[str, Col]], label: str, plain: bool = True) -> dict[str, Col]:
    """The mean prediction: affine where all predictions are known in the same rows."""
    every = [o[prediction(list(o))] for o in outs]
    same = plain and all(x.affine and x.known and x.needs == every[0].needs for x in every)
    made = {PREDICTION + label: reduce(Col.plus, every).times(1 / len(every)) if same else passed_on()}
    classes = sorted({n.rsplit("_", 1)[-1] for o in outs for n in o if n.startswith(PROBABILITY)})
    return made | {f"{PROBABILITY}{label}_{k}": passed_on() for k in classes}


def _aggregates(requests: list[Request], weight: Column) -> list[Column]:
    """All moments that are asked for, of one stretch's rows."""
    out = []
    for q, (bases, known, weighted) in enumerate(requests):
        there = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in sorted(known)], F.lit(True))
        w = F.when(there, weight if weighted else F.lit(1.0))
        x = [F.when(there, c(b).cast("double")) for b in bases]
        out.append((F.sum(w) if weighted else F.count(w)).alias(f"n{q}"))
        total = F.nullif(F.sum(w), F.lit(0.0))
        for i, v in enumerate(x):
            out += [(F.sum(w * v) / total if weighted else F.avg(v)).alias(f"m{q}_{i}"), F.min(v).alias(f"l{q}_{i}"), F.max(v).alias(f"h{q}_{i}")]
            for j in range(i, len(x)):
                # covar_pop keeps to the mean and loses no digits
                both = F.sum(w * v * x[j]) / total - F.sum(w * v) / total * F.sum(w * x[j]) / total if weighted else F.covar_pop(v, x[j])
                out.append(both.alias(f"c{q}_{i}_{j}"))
    return out


def _moments(row, q: int, k: int) -> Moments:
    number = lambda name: np.nan if row[name] is None else float(row[name])
    n = np.nan_to_num(number(f"n{q}"))
    spread = np.array([[number(f"c{q}_{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]).reshape(k, k) * n
    each = lambda letter: np.array([number(f"{letter}{q}_{i}") for i in range(k)])
    return Moments(np.full(max(k, 1), n), np.nan_to_num(each("m")), np.nan_to_num(spread), each("l"), each("h"))


def _by_split(splits: list[Split], borders: list[int], found: dict[int, Moments]) -> dict[int, Moments]:
    """Each split's moments; windows that begin alike and grow are merged step by step."""
    place = {b: i for i, b in enumerate(borders)}
    out, start, upto, so_far = {}, None, None, None
    for s in splits:
        if len(s.train) == 1 and s.train[0].start == start and place[s.train[0].end] >= upto:
            pieces, now = range(upto, place[s.train[0].end]), so_far
        else:
            pieces, now = [i for b in s.train for i in range(place[b.start], place[b.end])], None
        for i in pieces:
            if i in found:
                now = found[i] if now is None else now.merged(found[i])
        out[s.split_id] = now
        if len(s.train) == 1:
            start, upto, so_far = s.train[0].start, place[s.train[0].end], now
    return out


#: Where a run keeps the moments that its states follow from.
MOMENTS = "_moments"
_KEPT = "split_id long, request int, upto long, n array<double>, mean array<double>, spread array<array<double>>, low array<double>, high array<double>"


def _named(block: Block, rows: DataFrame, features: tuple[str, ...], place: str, inside: Column) -> tuple[Fit, dict[str, Col]]:
    """The pipeline followed by names over the rows inside."""
    fit, columns = _begun(reach_of(block), rows, features, place, inside)
    follow(block, columns, "main", fit, 0)
    return fit, columns


def _begun(reach: int, rows: DataFrame, features: tuple[str, ...], place: str, inside: Column) -> tuple[Fit, dict[str, Col]]:
    """The rows inside, in blocks for windows that look back reach rows, before anything is followed."""
    dealt = blocked(rows.where(inside), reach, 0, place=place).withColumns({"split_id": F.lit(0).cast("long"), "train": ~F.col("_halo"), "halo": F.col("_halo")})
    frame, given = Frame(dealt, features, ("_block", "_halo"), ("_block",)).hide("base")
    return Fit(frame, "weight" in rows.columns), {n: Col(weights={h: 1.0}, needs=frozenset({h})) for n, h in given.items()}


def _of_stretches(fit: Fit, stretches: list[tuple[int, int]]) -> dict[int, list[Moments]]:
    """All moments asked for, of each stretch that has rows."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if fit.weighted else F.lit(1.0)
    own = located(fit.frame.df.where("NOT _halo"), [(a, b, i) for i, (a, b) in enumerate(stretches)], "_stretch long")
    seen = own.groupBy("_stretch").agg(F.count("*").alias("rows"), *_aggregates(list(fit.requests), weight)).collect()
    return {r["_stretch"]: [_moments(r, q, len(bases)) for q, (bases, _, _) in enumerate(fit.requests)] for r in seen}


def _with_numbers(block: Block, columns: dict[str, Col], fit: Fit, known: dict[int, list[Moments]], upto: dict[int, int], spark) -> Run:
    """A run with the states that each split's moments give, and the moments."""
    number = {r: q for q, r in enumerate(fit.requests)}
    by_number = Fit(None, fit.weighted)
    by_number.made = fit.made
    kept = []
    for split, moments in known.items():
        by_number.moments = lambda r, moments=moments: moments[number[r]]
        follow(block, columns, "main", by_number, split)
        kept += [(split, q, upto[split], *[x.tolist() for x in (m.n, m.mean, m.spread, m.low, m.high)]) for q, m in enumerate(moments)]
    states = {path: spark.createDataFrame(by_number.states.get(path, []), f"split_id long, {schema}") for path, schema in fit.schemas.items()}
    return Run(states | {MOMENTS: spark.createDataFrame(kept, _KEPT)})


def fitted(pipeline, rows: DataFrame, features: tuple[str, ...], splits: list[Split], place: str = "rid") -> Run | None:
    """A run with every learner's state, from one pass over the rows; None if the pipeline can't be followed.

    rows are those of the engine (with weight if there are events). A row of moments
    a stretch reaches the driver. Train windows must begin at one place, or nothing
    may look back: else a window's first rows would see rows before it.
    """
    block = as_block(pipeline)
    starts = {b.start for s in splits for b in s.train}
    if not block.learns or not ((len(starts) == 1 and all(len(s.train) == 1 for s in splits)) or reach_of(block) == 0) or not any(len(b) for s in splits for b in s.train):
        return None
    splits = [replace(s, train=tuple(b for b in s.train if len(b))) for s in splits]
    borders = sorted({x for s in splits for b in s.train for x in (b.start, b.end)})
    try:
        fit, columns = _named(block, rows, features, place, (F.col("rid") >= borders[0]) & (F.col("rid") < borders[-1]))
        found = _of_stretches(fit, list(zip(borders, borders[1:])))
        by_request = [_by_split(splits, borders, {i: moments[q] for i, moments in found.items()}) for q in range(len(fit.requests))]
        known = {s.split_id: [of[s.split_id] for of in by_request] for s in splits if s.train and all(of[s.split_id] is not None for of in by_request)}
        return _with_numbers(block, columns, fit, known, {s.split_id: max(b.end for b in s.train) for s in splits if s.train}, rows.sparkSession)
    except Unfollowed:
        return None


#: Of each block's place, the schema of its state and the state of each window.
States = dict[str, tuple[str, dict[int, tuple]]]


def compared(candidates: dict[str, Block], rows: DataFrame, features: tuple[str, ...], windows: list[Split]) -> tuple[States, dict[tuple[int, str], tuple[float, float]]] | None:
    """(states of all candidates in all windows, {(window, candidate): (test rows, mean squared error)}) from one pass over the rows; None if a candidate can't be followed.

    candidates: by their places. A residual is affine in base columns too, so its mean
    square over test rows follows from their moments. Test rows' context must hold all
    that candidates look back at, so that their features are those of train rows; train
    windows must begin at one place, or nothing may look back.
    """
    reach = max(map(reach_of, candidates.values()))
    if reach and len({b.start for s in windows for b in s.train}) > 1:
        return None
    ranges = [b for s in windows for b in (*s.train, *s.test) if len(b)]
    borders = sorted({x for b in ranges for x in (b.start, b.end)})

    def errors(fit: Fit, split: int) -> dict[str, Col]:
        out = {}
        for path, block in candidates.items():
            made = follow(block, columns, path, fit, split)
            p = made[prediction(list(made))]
            if not p.affine:
                raise Unfollowed(f"{block.name}: the loss of a prediction that isn't affine")
            out[path] = fit.y.plus(p.times(-1.0))
        return out

    try:
        fit, columns = _begun(reach, rows, features, "rid", (F.col("rid") >= borders[0]) & (F.col("rid") < borders[-1]))
        for error in errors(fit, 0).values():
            fit.of([error], error.needs)
        found = _of_stretches(fit, list(zip(borders, borders[1:])))
        number = {r: q for q, r in enumerate(fit.requests)}
        joined = lambda every: [_by_split(every, borders, {i: moments[q] for i, moments in found.items()}) for q in range(len(fit.requests))]
        learnt, tested = joined(windows), joined([replace(s, train=s.test) for s in windows])
        by_number = Fit(None, False)
        by_number.made = fit.made
        losses = {}
        for s in windows:
            if any(of[s.split_id] is None for of in learnt):
                continue
            by_number.moments = lambda r, s=s: learnt[number[r]][s.split_id]
            residuals = errors(by_number, s.split_id)
            if any(of[s.split_id] is None for of in tested):
                continue
            by_number.moments = lambda r, s=s: tested[number[r]][s.split_id]
            for path, error in residuals.items():
                if error.known:
                    m = by_number.of([error], error.needs)
                    if m.n[0]:
                        losses[s.split_id, path] = (float(m.n[0]), max(float(m.spread[0, 0] / m.n[0]), 0.0) + float(m.mean[0]) ** 2)
    except Unfollowed:
        return None
    return {path: (schema, {state[0]: state[1:] for state in by_number.states.get(path, [])}) for path, schema in fit.schemas.items()}, losses


def updated(pipeline, run: Run, split: int, rows: DataFrame, features: tuple[str, ...]) -> Run:
    """The run of one split after learning from the rows that follow those it has learnt; before them, rows as context.

    Only the new rows are read to learn from: their moments are merged with those kept.
    """
    kept = run.states[MOMENTS].where(F.col("split_id") == split).orderBy("request").collect()  # a row a request
    if not kept:
        raise ValueError("the split has no moments to go on from")
    block, upto = as_block(pipeline), kept[0]["upto"]
    end = rows.agg(F.max("rid")).first()[0]
    if end is None or end < upto:
        return Run({k: v.where(F.col("split_id") == split) for k, v in run.states.items()})
    fit, columns = _named(block, rows, features, "rid", F.col("rid") >= upto - reach_of(block))
    before = [Moments(*[np.array(r[x], float) for x in ("n", "mean", "spread", "low", "high")]) for r in kept]
    more = _of_stretches(fit, [(upto, end + 1)]).get(0)
    moments = [_shaped(a, b).merged(b) for a, b in zip(before, more, strict=True)] if more else before
    return _with_numbers(block, columns, fit, {split: moments}, {split: end + 1}, rows.sparkSession)


def _shaped(a: Moments, b: Moments) -> Moments:
    """a with b's shapes: of no columns, a table keeps no rows of spreads."""
    return Moments(a.n.reshape(b.n.shape), a.mean.reshape(b.mean.shape), a.spread.reshape(b.spread.shape), a.low.reshape(b.low.shape), a.high.reshape(b.high.shape))
