"""Blocks that hold pipelines. Children see the same rows, and their columns meet without a join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import PREDICTION, PROBABILITY, c, prediction
from ..functions.rows import numbered
from ..plans.blocks import Block, Frame, Run, as_block, chosen, cut, in_turn, reach_of, traverse


class Composite(Block):
    """A block that learns if one of its children does."""

    @property
    def learns(self):
        return any(b.learns for b in self.children())


def branch(frame: Frame, children: list, run: Run, path: str, inputs: list[list[str]] | None = None) -> tuple[Frame, list[dict[str, str]]]:
    """Runs children on the frame's features (or on those of inputs) one after another; each result is hidden: {name: hidden name}."""
    tag = path.replace("/", "_").replace(":", "_")
    frame, hidden = frame.hide(f"in{tag}")
    outs = []
    for i, child in enumerate(children):
        own = hidden if inputs is None else {f: hidden[f] for f in inputs[i]}
        frame = as_block(child).process(frame.restore(own), run, f"{path}:{i}")
        frame, out = frame.hide(f"out{tag}_{i}")
        outs.append(out)
    return frame, [hidden, *outs]


def gather(frame: Frame, columns: dict[str, Column], carry: tuple[str, ...]) -> Frame:
    """New features instead of the old; hidden columns go, but for carry."""
    out = replace(frame.add(columns, []), carry=carry)
    return out.only(list(columns))


@dataclass(frozen=True)
class Concat(Composite):
    """All children's columns: those that one child has, then those that several have, of the first or last, or merged by a function of columns."""

    pipelines: tuple
    if_duplicate_keep: str = "first"
    custom_merge_logic: Callable[[list[Column]], Column] | None = None
    name: str = "concat"

    def children(self):
        return [as_block(p) for p in self.pipelines]

    def process(self, frame, run, path):
        carry = frame.carry
        frame, (_, *outs) = branch(frame, list(self.pipelines), run, path)
        holders: dict[str, list[str]] = {}
        for out in outs:
            for name, hidden in out.items():
                holders.setdefault(name, []).append(hidden)
        order = [n for n, h in holders.items() if len(h) == 1] + [n for n, h in holders.items() if len(h) > 1]
        merge = self.custom_merge_logic or (lambda xs: xs[0] if self.if_duplicate_keep == "first" else xs[-1])
        return gather(frame, {n: merge([c(h) for h in holders[n]]) if len(holders[n]) > 1 else c(holders[n][0]) for n in order}, carry)


def merge_tables(left: DataFrame, right: DataFrame, keep: str = "first", on: str = "rid") -> DataFrame:
    """All rows of two tables by a column: columns of one, then those of both, of the first or last table that knows the value."""
    both = [x for x in left.columns if x in right.columns and x != on]
    b = right.select(on, *[c(x).alias(f"_r_{x}" if x in both else x) for x in right.columns if x != on])
    joined = left.join(b, on, "full_outer")
    order = (lambda x: (c(x), c(f"_r_{x}"))) if keep == "first" else (lambda x: (c(f"_r_{x}"), c(x)))
    alone = [c(x) for x in (*left.columns, *right.columns) if x != on and x not in both]
    return joined.select(on, *alone, *[F.coalesce(*order(x)).alias(x) for x in both])


def mean_correlation(outs: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean correlation (correlation) between each two of several prediction columns; pairs without variation don't count."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    known = lambda a, b: c(a).isNotNull() & c(b).isNotNull()

    def corr(a: str, b: str) -> Column:
        x, y = F.when(known(a, b), c(a)), F.when(known(a, b), c(b))
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    return outs.agg(*[corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]).select(mean_of([F.col(f"_{i}") for i in range(len(pairs))]).alias("correlation"))


@dataclass(frozen=True)
class TransformColumn(Composite):
    """A pipeline on some columns; the others stay."""

    columns: object
    pipeline: object
    name: str = "transform column"

    def children(self):
        return [as_block(self.pipeline)]

    def process(self, frame, run, path):
        carry, some = frame.carry, chosen(frame, self.columns)
        frame, (hidden, out) = branch(frame, [self.pipeline], run, path, [some])
        rest = {n: c(h) for n, h in hidden.items() if n not in out}
        return gather(frame, rest | {n: c(h) for n, h in out.items()}, carry)


@dataclass(frozen=True)
class TransformEachColumn(Composite):
    pipeline: object
    name: str = "each column"

    def children(self):
        return [as_block(self.pipeline)]

    def process(self, frame, run, path):
        carry, features = frame.carry, list(frame.features)
        frame, (_, *outs) = branch(frame, [self.pipeline] * len(features), run, path, [[f] for f in features])
        return gather(frame, {n: c(h) for out in outs for n, h in out.items()}, carry)


def mean_of(columns: list[Column]) -> Column:
    """The mean of what is known."""
    known = F.array_compact(F.array(*columns))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known))


def averaged(outs: list[dict[str, str]], label: str, rebuild: bool) -> dict[str, Column]:
    """Mean prediction, and mean probability of each class; rebuild: the prediction is whether the second class's is 0.5 or more."""
    made = {PREDICTION + label: mean_of([c(o[prediction(list(o))]).cast("double") for o in outs])}
    by_class: dict[str, list[Column]] = {}
    for o in outs:
        for name, hidden in o.items():
            if name.startswith(PROBABILITY):
                by_class.setdefault(name.rsplit("_", 1)[-1], []).append(c(hidden))
    means = {k: mean_of(v) for k, v in sorted(by_class.items())}
    if rebuild and len(means) > 1:
        second = list(means.values())[1]
        made[PREDICTION + label] = F.when(second >= 0.5, 1.0).when(second < 0.5, 0.0)
    return made | {f"{PROBABILITY}{label}_{k}": v for k, v in means.items()}


@dataclass(frozen=True)
class Ensemble(Composite):
    pipelines: tuple
    reconstruct_predictions_from_probabilities: bool = False
    name: str = "Ensemble"

    def children(self):
        return [as_block(p) for p in self.pipelines]

    def process(self, frame, run, path):
        carry = frame.carry
        frame, (_, *outs) = branch(frame, list(self.pipelines), run, path)
        return gather(frame, averaged(outs, self.name, self.reconstruct_predictions_from_probabilities), carry)


@dataclass(frozen=True)
class EnsembleEachColumn(Composite):
    pipeline: object
    name: str = "EnsembleEachColumn"

    def children(self):
        return [as_block(self.pipeline)]

    def process(self, frame, run, path):
        carry, features = frame.carry, list(frame.features)
        frame, (_, *outs) = branch(frame, [self.pipeline] * len(features), run, path, [[f] for f in features])
        return gather(frame, averaged(outs, self.name, False), carry)


def _two_stage(block, frame: Frame, run: Run, path: str, target: Callable[[str], Column]):
    """The primary, then the meta pipeline on the same features with another target and no weights."""
    carry = frame.carry
    frame, own = frame.hide("keep" + path.replace("/", "_").replace(":", "_"), ["y", *(["weight"] if "weight" in frame.df.columns else [])])
    frame, (hidden, first) = branch(frame, [block.primary], run, path + "p")
    p = first[prediction(list(first))]
    frame = frame.restore(hidden).set(y=target(p))
    if "weight" in own:
        frame = frame.set(weight=F.lit(None).cast("double"))
    frame, (_, second) = branch(frame, [block.meta], run, path + "m")
    frame = frame.set(**{k: c(h) for k, h in own.items()})
    return frame, carry, first, second, p, second[prediction(list(second))]


@dataclass(frozen=True)
class ModelResiduals(Block):
    """The meta pipeline learns what the primary misses; both predictions are added."""

    primary: object
    meta: object
    primary_output_included: bool = False
    name: str = "ModelResiduals"

    def children(self):
        return [as_block(self.primary), as_block(self.meta)]

    def process(self, frame, run, path):
        frame, carry, first, _, p, g = _two_stage(self, frame, run, path, lambda p: F.col("y") - c(p))
        made = {PREDICTION + self.name: c(p) + c(g)}
        if self.primary_output_included:
            made |= {n: c(h) for n, h in first.items()}
        return gather(frame, made, carry)


@dataclass(frozen=True)
class MetaLabeling(Block):
    """The meta pipeline learns when the primary is right; the prediction is the product, with the meta's probabilities."""

    primary: object
    meta: object
    primary_output_included: bool = False
    name: str = "MetaLabeling"

    def children(self):
        return [as_block(self.primary), as_block(self.meta)]

    def process(self, frame, run, path):
        right = lambda p: F.when(c(p).cast("int") == F.col("y").cast("int"), 1.0).otherwise(0.0)
        frame, carry, first, second, p, g = _two_stage(self, frame, run, path, right)
        made = {PREDICTION + self.name: c(p) * c(g)} | {n: c(h) for n, h in second.items() if n.startswith(PROBABILITY)}
        if self.primary_output_included:
            made |= {n: c(h) for n, h in first.items()}
        return gather(frame, made, carry)


@dataclass(frozen=True)
class StrategyMetaLabeling(Composite):
    """The event's strategy label times the meta pipeline's prediction."""

    meta: object
    primary_output_included: bool = False
    name: str = "StrategyMetaLabeling"

    def children(self):
        return [as_block(self.meta)]

    def process(self, frame, run, path):
        carry = frame.carry
        frame, (_, out) = branch(frame, [self.meta], run, path)
        made = {PREDICTION + self.name: F.col("event_strategy_label") * c(out[prediction(list(out))])}
        made |= {n: c(h) for n, h in out.items() if n.startswith(PROBABILITY)}
        if self.primary_output_included:
            made |= {n: c(h) for n, h in out.items() if n.startswith(PREDICTION) and n not in made}
        return gather(frame, made, carry)


@dataclass(frozen=True)
class TransformTarget(Block):
    """The wrapped pipeline learns a transformed target; its predictions are transformed back, the last step first."""

    wrapped_pipeline: object
    y_pipeline: tuple
    invert_wrapped_output: bool = True
    name: str = "TransformTarget"

    def children(self):
        return [as_block(self.wrapped_pipeline)]

    @property
    def reach(self):
        return sum(reach_of(s) for s in self.y_pipeline)

    @property
    def unbounded(self):
        return any(as_block(s).unbounded for s in self.y_pipeline)

    def process(self, frame, run, path):
        carry, steps = frame.carry, [as_block(s) for s in self.y_pipeline]
        tag = path.replace("/", "_").replace(":", "_")
        frame, own = frame.hide("y" + tag, ["y"])
        frame, hidden = frame.hide("x" + tag)
        frame = frame.add({"_target": F.col("y")}, [])
        frame = in_turn(frame, steps, lambda i, s, frame: s.process(frame, run, f"{path}y{i}"))
        frame = frame.set(y=c(frame.features[0])).restore(hidden)
        frame = as_block(self.wrapped_pipeline).process(frame, run, path + "w").set(y=c(own["y"]))
        if self.invert_wrapped_output:
            for i, s in reversed(list(enumerate(steps))):
                frame = s.inverse(frame, run, f"{path}y{i}", [prediction(list(frame.features))])
        return replace(frame, carry=carry).only(list(frame.features))


@dataclass(frozen=True)
class SkipNA(Composite):
    """The pipeline sees only rows without a null feature; the others' results are null.

    Where the pipeline looks back, known rows may lie any number of rows apart: they
    are numbered in each split by counts of the blocks before, and dealt into blocks
    by that number, with as many known rows as context as the pipeline needs.
    """

    pipeline: object
    name: str = "SkipNA"

    def children(self):
        return [as_block(self.pipeline)]

    def process(self, frame, run, path):
        known = reduce(lambda a, b: a & b, [c(f).isNotNull() for f in frame.features])
        child, key = as_block(self.pipeline), [k for k in frame.by if k != "_block"]
        if not any(b.windowed for b in traverse(child)):
            out, key = child.process(frame.on(frame.df.where(known)), run, path + "s"), list(frame.by)
            rows = out.df
        else:
            own = numbered(frame.df.where("NOT _halo").drop("_halo"), known, "_skipped", [k for k in key if k != "_halo"])
            dealt = cut(own, child, "_skipped").withColumns({"train": F.col("train") & ~F.col("_halo"), "halo": F.col("halo") | F.col("_halo")})
            out = child.process(replace(frame, df=dealt, by=(*[k for k in key if k != "_halo"], "_block"), ahead=0), run, path + "s")
            rows, key = out.df.where("NOT _halo"), [k for k in key if k != "_halo"]
        result = rows.select(*key, "rid", *[c(f).alias(f"_r{i}") for i, f in enumerate(out.features)])
        df = frame.df.join(result, [*key, "rid"], "left")
        return frame.on(df).add({f: F.col(f"_r{i}") for i, f in enumerate(out.features)}, [])


def drawn(frame: Frame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train rows with their place _at, from 1, in a random order of their class; each class's size _n), by split and y.

    The order is that of a hash of seed and rid. A class is cut by the hash's first
    digits and its parts' sizes are summed up, so that no task orders a class.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.col("rid").cast("string")).cast("binary"))
    rows = frame.train_rows().withColumns({"_draw": key, "_part": F.substring(key, 1, 3)})
    parts = rows.groupBy("split_id", "y", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("split_id", "y").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("split_id", F.col("y").alias("_y"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"), "_n")
    at = F.row_number().over(Window.partitionBy("split_id", "y", "_part").orderBy("_draw", "rid"))
    rows = rows.withColumn("_at", at).withColumnRenamed("split_id", "_s").join(parts.drop("_n"), (F.col("_s") == F.col("split_id")) & F.col("y").eqNullSafe(F.col("_y")) & (F.col("_part") == F.col("_p")))
    rows = rows.withColumn("_at", F.col("_at") + F.col("_before")).drop("_s", "_y", "_p", "_part", "_draw", "_before")
    return rows, parts.groupBy("split_id", "_y").agg(F.sum("_n").alias("_n"))


def _sized(rows: DataFrame, sizes: DataFrame, goal: Callable) -> DataFrame:
    """rows with _n, their class's size, and _goal, an aggregate of the sizes in their split."""
    goals = sizes.groupBy("split_id").agg(goal("_n").alias("_goal"))
    wide = sizes.join(goals, "split_id").withColumnRenamed("split_id", "_s")
    return rows.join(wide, (F.col("split_id") == F.col("_s")) & F.col("y").eqNullSafe(F.col("_y"))).drop("_s", "_y")


@dataclass(frozen=True)
class UnderSampler:
    """Leaves as many rows of each class as the smallest has, chosen at random without repeats."""

    seed: int = 1

    def sample(self, frame: Frame) -> Frame:
        rows = _sized(*drawn(frame, self.seed), F.min)
        return frame.on(rows.where("_at <= _goal").drop("_at", "_n", "_goal"))


@dataclass(frozen=True)
class OverSampler:
    """Repeats rows until each class has as many as the largest: all equally often, and rows chosen at random once more."""

    seed: int = 1

    def sample(self, frame: Frame) -> Frame:
        rows = _sized(*drawn(frame, self.seed), F.max)
        times = F.floor(F.col("_goal") / F.col("_n")) + F.when(F.col("_at") <= F.col("_goal") % F.col("_n"), 1).otherwise(0)
        return frame.on(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_copy", "_at", "_n", "_goal"))


@dataclass(frozen=True)
class Sample(Composite):
    """The pipeline is fitted on sampled train rows and then applied to all rows."""

    sampler: object
    pipeline: object
    name: str = "Sample"

    def children(self):
        return [as_block(self.pipeline)]

    @property
    def unbounded(self):
        return any(b.windowed for b in traverse(as_block(self.pipeline)))

    def process(self, frame, run, path):
        child = as_block(self.pipeline)
        if run.fitting:
            fitted = Run()
            child.process(self.sampler.sample(frame), fitted, path + "s")
            run.states |= fitted.states
            run.models |= fitted.models
            run.labels |= fitted.labels
        use = Run(run.states)
        use.models = run.models
        return child.process(frame, use, path + "s")


@dataclass(frozen=True)
class SelectBest(Composite):
    """One of several pipelines, by name; tuning sets it."""

    choose_from: tuple
    selected: str | None = None
    name: str = "SelectBest"

    def children(self):
        return [as_block(p) for p in self.choose_from]

    def tunable(self):
        return {"selected": [as_block(p).name for p in self.choose_from]}

    def found(self) -> Block:
        found = next((p for p in self.children() if p.name == self.selected), None)
        if found is None:
            raise ValueError("nothing is selected: tune first")
        return found

    def process(self, frame, run, path):
        return self.found().process(frame, run, path + "b")


