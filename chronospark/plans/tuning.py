"""Grid search over a pipeline's parameters: all candidates and splits in one plan."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, is_dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import c, nested, prediction
from ..sources.tables import saved
from . import segments
from .blocks import Block, Frame, Identity, Run, Sequence, as_block, cut, memory_of, reach_of, renamed
from .engine import as_card, score, train_backtest
from .splits import Bounds, Split, plan_splits

MARK = "¦"


def _tunable(block: Block) -> Iterator[Block]:
    """The blocks that a search from outside may set; an Optimizer searches for itself."""
    yield block
    if not isinstance(block, Optimizer):
        for child in block.children():
            yield from _tunable(child)


def grid(pipeline) -> list[dict]:
    """All combinations of {name¦param: value} that the blocks of a pipeline ask to try; passthrough may also be one."""
    wanted: dict[str, list] = {}
    for b in _tunable(as_block(pipeline)):
        for param, values in b.tunable().items():
            key = f"{b.name}{MARK}{param}"
            if key in wanted:
                raise ValueError(f"two blocks to tune are named {b.name}")
            wanted[key] = [True, False] if param == "passthrough" else list(values)
    return [dict(zip(wanted, combination)) for combination in itertools.product(*wanted.values())]


def apply(pipeline, params: dict) -> Block:
    """The pipeline with parameters set; a block passed through is an identity."""
    by_name = nested(params, MARK)

    def rebuilt(block: Block) -> Block:
        own = dict(by_name.get(block.name, {}))
        if own.pop("passthrough", False):
            return Identity()
        if isinstance(block, Optimizer):
            return block
        if isinstance(block, Sequence):
            return Sequence(tuple(rebuilt(as_block(s)) for s in block.steps))
        changes: dict = {}
        if is_dataclass(block):
            for field in ("pipelines", "choose_from"):
                if hasattr(block, field):
                    changes[field] = tuple(rebuilt(as_block(p)) for p in getattr(block, field))
            for field in ("pipeline", "primary", "meta", "wrapped_pipeline"):
                if hasattr(block, field):
                    changes[field] = rebuilt(as_block(getattr(block, field)))
        return replace(block, **changes, **own) if changes or own else block

    return rebuilt(as_block(pipeline))


def tune(card, df: DataFrame, splitter, features=(), metric: str = "rmse", candidates: list[dict] | None = None, lower_is_better: bool = True, n: int | None = None) -> tuple[dict, DataFrame]:
    """(the best parameters, each candidate's score over all test rows); one job over all candidates and splits."""
    card = as_card(card)
    n = n if n is not None else df.agg(F.max("rid")).first()[0] + 1
    candidates = candidates if candidates is not None else grid(card.pipeline)
    scores = []
    for i, params in enumerate(candidates):
        results = train_backtest(replace(card, pipeline=apply(card.pipeline, params)), df, splitter, features, n=n)
        scores.append(score(results.withColumn("candidate", F.lit(i)).drop("split_id").withColumnRenamed("candidate", "split_id")).withColumnRenamed("split_id", "candidate"))
    table = reduce(DataFrame.union, scores)
    order = F.col(metric).asc_nulls_last() if lower_is_better else F.col(metric).desc_nulls_last()
    best = table.orderBy(order, "candidate").first()
    return candidates[best["candidate"]], table


#: Lower is better; of predictions p and truths y.
LOSSES = {"rmse": lambda p, y: F.sqrt(F.avg((p - y) * (p - y))), "mae": lambda p, y: F.avg(F.abs(p - y)), "error rate": lambda p, y: F.avg(F.when(p == y, 0.0).otherwise(1.0))}
_CHOSEN = "split_id long, chosen int"
#: More than the windows of an inner splitter, so that windows within windows have numbers of their own.
_INNER = 1 << 20


@dataclass(frozen=True)
class Grid:
    """All candidates at once, on all inner windows.

    A search says what to try next, for each split by itself: next(n, rounds), of
    n candidates and the rounds so far as (share, {candidate: loss}), gives the
    candidates and the share of inner windows, latest first, of another round, or
    None when it is done. The best of the last round is the choice.
    """

    def next(self, n: int, rounds: list[tuple[float, dict]]) -> tuple[list[int], float] | None:
        return None if rounds else (list(range(n)), 1.0)


@dataclass(frozen=True)
class Halving:
    """Successive halving: all candidates on the latest share of inner windows, then of each round the best factor-th on factor times as many."""

    first: float = 0.25
    factor: int = 2

    def next(self, n: int, rounds: list[tuple[float, dict]]) -> tuple[list[int], float] | None:
        if not rounds:
            return list(range(n)), min(1.0, self.first)
        share, losses = rounds[-1]
        kept = _in_order(losses)[: -(-len(losses) // self.factor)]
        return None if len(kept) <= 1 else (sorted(kept), min(1.0, share * self.factor))


def _latest(windows: list[int], share: float) -> list[int]:
    return windows[-math.ceil(share * len(windows)) :]


def _in_order(losses: dict[int, float | None]) -> list[int]:
    """Candidates by loss, unknown ones last; of equal ones the first."""
    return sorted(losses, key=lambda k: (losses[k] is None, losses[k] if losses[k] is not None else 0.0, k))


@dataclass(frozen=True)
class Optimizer(Block):
    """The pipeline with the parameters that did best inside each split's own train window.

    splitter cuts every train window again; the candidates, or all combinations
    that the pipeline's blocks ask to try, are fitted and scored on these windows, in
    the rounds that search asks for. Where candidates learn from moments and make affine
    predictions, states and losses (rmse) of all windows come from one pass over rows
    that aren't repeated (segments.compared). Else the tagged rows of all inner windows
    are written once and shared by all candidates and rounds; a round's scores, a row a
    split and candidate, reach the driver. Context covers the candidate that looks back
    furthest. A split's choice is its state; test rows have no part in it.
    """

    pipeline: object
    splitter: object
    candidates: tuple | None = None
    loss: str = "rmse"
    search: object = Grid()
    name: str = "optimizer"

    def children(self):
        return self.tried()

    def tried(self) -> list[Block]:
        params = grid(self.pipeline) if self.candidates is None else self.candidates
        return [apply(self.pipeline, p) for p in params]

    def _inner(self, frame: Frame) -> tuple[Frame, dict[int, list[int]]]:
        """Train rows as rows of the windows within their split's window; the windows of each split."""
        rows = frame.train_rows()
        ends = rows.groupBy("split_id").agg(F.min("rid").alias("a"), F.max("rid").alias("z")).collect()  # a row a split
        plan = [(r["split_id"], r["split_id"] * _INNER + s.split_id, *(r["a"] + x for x in (s.train[0].start, s.train[-1].end, s.test[0].start, s.test[-1].end))) for r in ends for s in plan_splits(self.splitter, r["z"] - r["a"] + 1)]
        windows: dict[int, list[int]] = {}
        for split, own, *_ in plan:
            windows.setdefault(split, []).append(own)
        table = frame.df.sparkSession.createDataFrame(plan, "split_id long, _own long, _tr0 long, _tr1 long, _te0 long, _te1 long")
        # a row a window, a number planned on the driver
        wide = rows.drop("train", "halo", "_role", "_run", "_block", "_halo").join(F.broadcast(table), "split_id").withColumn("split_id", F.col("_own"))
        memory, rid = memory_of(self), F.col("rid")
        role = F.when((rid >= F.col("_tr0")) & (rid < F.col("_tr1")), True)
        tested = F.when((rid >= F.col("_te0") - memory) & (rid < F.col("_te1")), False)
        both = wide.withColumn("_role", F.explode(F.array_compact(F.array(role, tested)))).withColumn("halo", ~F.col("_role") & (rid < F.col("_te0")))
        both = cut(both.drop("_own", "_tr0", "_tr1", "_te0", "_te1"), self)
        both = both.withColumns({"train": F.col("_role") & ~F.col("_halo"), "halo": F.col("halo") | F.col("_halo")})
        return Frame(saved(both), frame.features, frame.carry, ("split_id", "_role", "_block")), windows

    def _choice(self, frame: Frame) -> DataFrame:
        (inner, windows), tried = self._inner(frame), self.tried()

        def losses(plans: dict) -> dict:
            scores = []
            for i in sorted({i for some, _ in plans.values() for i in some}):
                own = [(w,) for s, (some, share) in plans.items() if i in some for w in _latest(windows[s], share)]
                used = inner.on(inner.df.join(F.broadcast(inner.df.sparkSession.createDataFrame(own, "split_id long")), "split_id", "left_semi"))  # a row a window
                out = tried[i].process(used, Run(), "inner")
                p, y = c(prediction(list(out.features))).cast("double"), F.col("y").cast("double")
                tested = out.df.where("NOT _role AND NOT halo").where(p.isNotNull() & y.isNotNull())
                scores.append(tested.groupBy(F.floor(F.col("split_id") / _INNER).cast("long").alias("split_id")).agg(LOSSES[self.loss](p, y).alias("loss")).withColumn("candidate", F.lit(i)))
            return {(r["split_id"], r["candidate"]): r["loss"] for r in reduce(DataFrame.union, scores).collect()}  # a row a split and candidate

        return frame.df.sparkSession.createDataFrame(self._searched(windows, len(tried), losses), _CHOSEN)

    def _searched(self, windows: dict[int, list[int]], n: int, losses) -> list[tuple[int, int]]:
        """Each split's choice after all rounds; losses: {(split, candidate): loss} of {split: (candidates, share)}."""
        rounds: dict[int, list] = {s: [] for s in windows}
        while True:
            plans = {s: self.search.next(n, rounds[s]) for s in windows}
            plans = {s: p for s, p in plans.items() if p}
            if not plans:
                break
            found = losses(plans)
            for s, (some, share) in plans.items():
                rounds[s].append((share, {i: found.get((s, i)) for i in some}))
        return [(s, _in_order(r[-1][1])[0]) for s, r in rounds.items()]

    def fit_at_once(self, rows, features, splits, run, path):
        tried = {f"{path}o{i}": b for i, b in enumerate(self.tried())}
        # a test row's context must hold what its features look back at
        if self.loss != "rmse" or "weight" in rows.columns or any(len(s.train) != 1 for s in splits) or any(reach_of(b) > memory_of(self) for b in tried.values()):
            return False
        seen = rows.agg(F.min("rid").alias("a"), F.max("rid").alias("z"), F.count("*").alias("n"), F.avg(F.col("y") * F.col("y")).alias("yy")).first()
        if not seen["n"] or seen["z"] - seen["a"] + 1 != seen["n"]:
            return False
        every, windows = [], {}
        for s in splits:
            a, z = max(s.train[0].start, seen["a"]), min(s.train[0].end, seen["z"] + 1)
            if a >= z:
                continue
            for w in plan_splits(self.splitter, z - a):
                own = s.split_id * _INNER + w.split_id
                windows.setdefault(s.split_id, []).append(own)
                every.append(Split(own, (Bounds(a + w.train[0].start, a + w.train[-1].end),), (Bounds(a + w.test[0].start, a + w.test[-1].end),)))
            every.append(Split(-1 - s.split_id, (Bounds(a, z),), ()))  # the split's own window
        made = segments.compared(tried, rows, features, every) if every else None
        if made is None:
            return False
        states, errors = made
        # squares of what fits all but exactly are lost in rounding: rows tell such candidates apart
        exact = [w for (w, _), (_, square) in errors.items() if square <= 1e-9 * (seen["yy"] or 0.0)]
        if len(exact) > len(set(exact)):
            return False

        def losses(plans: dict) -> dict:
            found = {}
            for s, (some, share) in plans.items():
                for i in some:
                    of = [errors[w, f"{path}o{i}"] for w in _latest(windows[s], share) if (w, f"{path}o{i}") in errors]
                    if of:
                        found[s, i] = math.sqrt(sum(n * square for n, square in of) / sum(n for n, _ in of))
            return found

        spark, chosen = rows.sparkSession, self._searched(windows, len(tried), losses)
        run.states[path] = spark.createDataFrame(chosen, _CHOSEN)
        for i in sorted({k for _, k in chosen}):
            for at, (schema, of) in states.items():
                if at.startswith(f"{path}o{i}") and not at[len(f"{path}o{i}") :][:1].isdigit():
                    run.states[at] = spark.createDataFrame([(s, *of[-1 - s]) for s, k in chosen if k == i and -1 - s in of], f"split_id long, {schema}")
        return True

    def process(self, frame, run, path):
        chosen = run.state(path, lambda: self._choice(frame))
        by_split = {r["split_id"]: r["chosen"] for r in chosen.collect()}  # a row a split
        outs = []
        for i, block in enumerate(self.tried()):
            own = [s for s, k in by_split.items() if k == i]
            if own:
                outs.append(block.process(frame.on(frame.df.where(F.col("split_id").isin(own))), run, f"{path}o{i}"))
        if not outs:
            raise ValueError("no split has a choice")
        # columns that a candidate names after its parameters go by the first choice's names
        names = outs[0].features
        outs = [o if o.features == names else renamed(o, dict(zip(o.features, names, strict=True))) for o in outs]
        return outs[0].on(reduce(lambda a, b: a.unionByName(b), [o.df.select(*[c(x) for x in outs[0].df.columns]) for o in outs]))
