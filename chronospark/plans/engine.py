"""Training, backtesting, inference and scores.

All windows are trained and tested in one plan: what a pipeline learns comes from
moments of stretches or from train rows tagged by split, test rows come with their
context, and the pipeline turns them into predictions. States are fetched as soon
as they are fitted, a row a split; the result's job runs when the caller acts on it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import c, prediction
from ..functions.rows import blocked, numbered
from ..operators.events import EVENT_COLUMNS, create_events
from ..sources.tables import saved
from . import segments
from .blocks import Block, Frame, Run, Sequence, as_block, bounded, cut, memory_of, reach_of, traverse
from .splits import plan_splits, tag_last_train_rows, tag_test_rows, tag_train_rows


@dataclass(frozen=True)
class PipelineCard:
    """A pipeline, what is done once to the whole series before, and how events are made."""

    pipeline: object
    preprocessing: object = None
    labeler: object = None
    event_filter: object = None
    trim_initial_period_after_preprocessing: bool = False
    forward_horizon: int = 0


@dataclass
class Trained:
    card: PipelineCard
    features: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Run
    preprocessing: Run | None
    rows: DataFrame  # test rows after the pipeline, and their context
    splits: list
    spine: DataFrame
    train: DataFrame | None = None  # train rows after the pipeline, if asked for
    once: bool = False  # each train row is there once, with the last split that covers it


def as_card(x) -> PipelineCard:
    return x if isinstance(x, PipelineCard) else PipelineCard(x)


def check_types(df: DataFrame, features=()) -> None:
    """TypeError unless rid is a whole number and y and features are numbers; ValueError where one is missing."""
    kinds = {f.name: f.dataType for f in df.schema}
    missing = [x for x in ("rid", "y", *features) if x not in kinds]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not isinstance(kinds["rid"], T.IntegralType):
        raise TypeError(f"rid must be a whole number, not {kinds['rid'].simpleString()}")
    for x in ("y", *features):
        if not isinstance(kinds[x], (T.NumericType, T.BooleanType, T.StringType, T.NullType)) or (x == "y" and isinstance(kinds[x], (T.StringType, T.BooleanType))):
            raise TypeError(f"{x} must be a number, not {kinds[x].simpleString()}")


def check_types_multi_series(df: DataFrame) -> None:
    """ValueError unless a table of several series has unique_id, ds and y."""
    missing = [x for x in ("unique_id", "ds", "y") if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _series(df: DataFrame, features) -> tuple[DataFrame, tuple[str, ...]]:
    """Columns rid, ts, y and features; a series without features has a column of zeros."""
    check_types(df, features)
    if "ts" not in df.columns:
        df = df.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    features = tuple(features)
    if not features:
        df, features = df.withColumn("X_not_available", F.lit(0.0)), ("X_not_available",)
    events = [x for x in df.columns if x.startswith("event_")]
    return df.select("rid", "ts", "y", *events, *[c(f) for f in features if f != "y"]), features


def _place(spine: DataFrame):
    """Looks up the row of a timestamp that a splitter's start or end names."""

    def look_up(ts) -> int:
        row = spine.where(F.col("ts") == F.lit(ts).cast("timestamp_ntz")).agg(F.min("rid").alias("rid")).first()
        if row["rid"] is None:
            raise ValueError(f"no row at {ts}")
        return row["rid"]

    return look_up


def preprocess(df: DataFrame, features: tuple[str, ...], pipeline, run: Run) -> tuple[DataFrame, tuple[str, ...]]:
    """A pipeline fitted once on the whole series. Windows run over blocks of rows with enough context, not over one partition."""
    block = as_block(pipeline)
    dealt = cut(df, block).withColumns({"split_id": F.lit(0).cast("long"), "train": ~F.col("_halo"), "halo": F.col("_halo")})
    out = block.process(Frame(dealt, features, ("_block", "_halo"), ("_block",)), run, "pre")
    done = out.df.where("NOT _halo").drop("_block", "_halo", "split_id", "train", "halo")
    return done, out.features


def first_valid(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the least rid (_first) whose columns are all known; null if none."""
    known = F.lit(True)
    for x in columns:
        known = known & c(x).isNotNull()
    return df.where(known).agg(F.min("rid").alias("_first"))


def trim_initial(df: DataFrame, columns: list[str]) -> DataFrame:
    """df from the first row on whose columns are all known."""
    return df.crossJoin(F.broadcast(first_valid(df, columns))).where(F.col("rid") >= F.col("_first")).drop("_first")


def train(card, df: DataFrame, splitter, features=(), events: DataFrame | None = None, for_deployment: bool = False, n: int | None = None, need_in_sample: bool = True) -> Trained:
    """Fits a pipeline on every split of df (rid, ts, y, features); for_deployment: on the last only.

    events: (rid, event columns), or made by the card's labeler. n, the number
    of rows, is counted if not given. Where the pipeline learns nothing, or from
    moments (see segments), no train row is repeated for several splits; without
    need_in_sample train rows are only read for what learns.
    """
    card = as_card(card)
    spine, features = _series(df, features)
    n = n if n is not None else spine.agg(F.max("rid")).first()[0] + 1
    if events is not None:
        spine = spine.join(events.select("rid", *[x for x in events.columns if x.startswith("event_")]), "rid", "left")
    elif card.labeler is not None:
        spine = create_events(spine, n, card.labeler, card.event_filter)
    rows, pre = spine, None
    if card.preprocessing is not None:
        pre = Run()
        rows, features = preprocess(rows, features, card.preprocessing, pre)
        if card.trim_initial_period_after_preprocessing:
            rows = trim_initial(rows, list(features))
    splits = plan_splits(splitter, n, gap_before=card.forward_horizon, place=_place(spine))
    if for_deployment:
        splits = splits[-1:]
    return _all_rows(card, rows, spine, splits, features, pre, need_in_sample)


def _all_rows(card, rows, spine, splits, features, pre, need_in_sample) -> Trained:
    block, has_events = as_block(card.pipeline), "event_label" in rows.columns
    rows, place = rows.withColumn("raw_y", F.col("y")), "rid"
    if has_events:
        # only rows with an event are seen, so windows count events; context is measured in rows before that
        known = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in EVENT_COLUMNS])
        place = "_place"
        rows = numbered(rows, known, place).withColumns({"y": F.col("event_label"), "weight": F.col("event_sample_weights")})
    fitted = segments.fitted(block, rows, features, splits, place)
    run = fitted or Run()
    test = _flagged(tag_test_rows(rows, splits, memory_of(block)), False)
    train = None
    once = need_in_sample and bounded(block) and (fitted is not None or not block.learns)
    if once:
        # what is learnt is known, so a train row is only needed once
        rows_once = _flagged(tag_last_train_rows(rows, splits, reach_of(block)), True)
        train = block.process(_framed(rows_once, features, block, place, ("split_id", "_role", "_run", "_block")), run, "main").df
    elif run.fitting and (block.learns or need_in_sample):
        train = _fit(rows, features, block, splits, place, run, need_in_sample)
    use = Run(run.states)
    use.models = run.models
    out = block.process(_framed(test, features, block, place), use, "main")
    return Trained(card, features, out.features, run, pre, out.df, splits, spine, train, once)


def _flagged(rows: DataFrame, is_train: bool) -> DataFrame:
    return rows.withColumns({"_role": F.lit(is_train), "halo": F.col("halo") if "halo" in rows.columns else F.lit(False)})


def _framed(rows: DataFrame, features, pipeline, place: str, by=("split_id", "_role", "_block")) -> Frame:
    """Tagged rows as a frame in blocks; a block's context rows are neither learnt from nor results."""
    dealt = cut(rows, pipeline, place)
    dealt = dealt.withColumns({"train": F.col("_role") & ~F.col("_halo") & ~F.col("halo"), "halo": F.col("halo") | F.col("_halo")})
    return Frame(dealt, tuple(features), by=by)


def _fit(rows: DataFrame, features, block: Block, splits: list, place: str, run: Run, to_end: bool) -> DataFrame | None:
    """Fits the pipeline on train rows of each split; to_end: their rows after the whole pipeline.

    First steps that see a row and a few before it give the same in every split whose
    window begins at one place: they are taken once, before rows are repeated for the
    splits. With several learners the repeated rows are written, as each learner reads
    them. What follows the last learner is only done to_end. A last block that can
    learns from rows that aren't repeated.
    """
    steps = block.children() if isinstance(block, Sequence) else [block]
    path = (lambda i: f"main/{i}") if isinstance(block, Sequence) else (lambda i: "main")
    one_start, early = len({b.start for s in splits for b in s.train}) == 1, []
    for s in steps:
        if not segments.is_local(s) or reach_of(s) and not one_start:
            break
        early.append(s)
    frame = Frame(rows, tuple(features))
    if early:
        start, end = min(b.start for s in splits for b in s.train), max(b.end for s in splits for b in s.train)
        inside = rows.where((F.col("rid") >= start) & (F.col("rid") < end))
        dealt = blocked(inside, sum(map(reach_of, early)), 0, place=place).withColumns({"split_id": F.lit(0).cast("long"), "train": ~F.col("_halo"), "halo": F.col("_halo")})
        frame = Frame(dealt, tuple(features), ("_block", "_halo"), ("_block",))
        for i, s in enumerate(early):
            frame = s.process(frame, run, path(i))
        frame = frame.on(frame.df.where("NOT _halo").drop("_block", "_halo", "split_id", "train", "halo"))
    rest = steps[len(early) :]
    at_once = len(rest) == 1 and place == "rid" and rest[0].fit_at_once(frame.df, frame.features, splits, run, path(len(early)))
    if at_once and not to_end:
        return None
    late = _framed(_flagged(tag_train_rows(frame.df, splits), True), frame.features, Sequence(tuple(rest)), place)
    if at_once:
        return rest[0].process(late, Run(run.states), path(len(early))).df
    if sum(1 for b in traverse(block) if b.learns and not b.children()) > 1:
        late = late.on(saved(late.df))
    last = max((i for i, s in enumerate(steps) if s.learns), default=-1)
    for i, s in enumerate(rest, len(early)):
        if i == last and not to_end:
            s.fit(late, run, path(i))
            return None
        late = s.process(replace(late, ahead=sum(map(reach_of, steps[i + 1 :]))), run, path(i))
    return late.df


def backtest(trained: Trained) -> DataFrame:
    """(split_id, rid, ts, y, predictions and probabilities) of all test rows; with events, null in rows without one."""
    outputs = [c(f) for f in trained.outputs]
    made = trained.rows.where("NOT halo")
    if "event_label" in trained.spine.columns:
        every = tag_test_rows(trained.spine.select("rid", "ts", "y"), trained.splits).drop("halo")
        return every.join(made.select("split_id", "rid", *outputs), ["split_id", "rid"], "left").select("split_id", "rid", "ts", "y", *outputs)
    return made.select("split_id", "rid", "ts", F.col("raw_y").alias("y"), *outputs)


def artifacts(trained: Trained) -> DataFrame:
    """What was made along the way, by row: (split_id, rid, artifact, value array<string>, numbers array<double>, event columns if there are events).

    A feature selector's columns are at the last row of each split's train window,
    as selected_features_name, and so are a tree model's features, greatest gain first,
    with their gains as numbers, as name_feature_importances: wherever in the pipeline
    the block is. Other rows, of split null, hold events only.
    """
    last = [(s.split_id, s.train[-1].end - 1) for s in trained.splits]
    spark = trained.spine.sparkSession
    ends = F.broadcast(spark.createDataFrame(last, "split_id long, rid long"))  # a row a split
    found = []
    for path, label in sorted(trained.run.labels.items()):
        state = trained.run.states[path].join(ends, "split_id")
        numbers = F.lit(None).cast("array<double>")
        if "selected" in state.columns:
            value = F.col("selected")
        else:
            value, numbers = F.col("_importances.feature"), F.col("_importances.gain")
        found.append(state.select("split_id", "rid", F.lit(label).alias("artifact"), value.alias("value"), numbers.alias("numbers")))
    kinds = "split_id long, rid long, artifact string, value array<string>, numbers array<double>"
    made = reduce(DataFrame.union, found) if found else spark.createDataFrame([], kinds)
    if "event_label" not in trained.spine.columns:
        return made
    events = trained.spine.where("event_label IS NOT NULL").select("rid", *[x for x in trained.spine.columns if x.startswith("event_")])
    return events.join(made, "rid", "full_outer").select("split_id", "rid", "artifact", "value", "numbers", *[x for x in events.columns if x != "rid"])


def in_sample(trained: Trained) -> DataFrame:
    """Predictions of train rows; where splits overlap, the last split's. Only of what was trained with need_in_sample."""
    outputs = [c(f) for f in trained.outputs]
    if trained.once:
        return trained.train.where("train").select("rid", "split_id", *outputs, "ts", F.col("raw_y").alias("y"))
    whole = F.struct(*outputs)
    best = trained.train.where("train").groupBy("rid").agg(F.max_by(whole, "split_id").alias("_row"), F.max("split_id").alias("split_id"), F.any_value("ts").alias("ts"), F.any_value("raw_y").alias("y"))
    return best.select("split_id", "rid", "_row.*", "ts", "y")


def train_backtest(card, df, splitter, features=(), return_artifacts: bool = False, **options):
    """The results; with return_artifacts (results, artifacts)."""
    trained = train(card, df, splitter, features, need_in_sample=False, **options)
    return (backtest(trained), artifacts(trained)) if return_artifacts else backtest(trained)


def infer(trained: Trained, df: DataFrame, features=()) -> DataFrame:
    """The last split's pipeline on all rows of df (rid, features), events or not; df must be longer than the pipeline's memory."""
    df, own = _series(df if "y" in df.columns else df.withColumn("y", F.lit(None).cast("double")), features)
    if trained.card.preprocessing is not None:
        df, own = preprocess(df, own, trained.card.preprocessing, Run(trained.preprocessing.states))
    last = trained.splits[-1].split_id
    use = Run({k: v.where(F.col("split_id") == last) for k, v in trained.run.states.items()})
    use.models = trained.run.models
    tagged = df.withColumns({"split_id": F.lit(last).cast("long"), "train": F.lit(False), "halo": F.lit(False)})
    dealt = cut(tagged, trained.card.pipeline)
    out = as_block(trained.card.pipeline).process(Frame(dealt, own, ("_block", "_halo"), ("_block",)), use, "main")
    return out.df.where("NOT _halo").select("rid", "ts", *[c(f) for f in out.features])


def update(trained: Trained, df: DataFrame, features=()) -> Trained:
    """The last split's pipeline after learning from the rows of df (rid, y, features) that follow its train window.

    What it has learnt is kept as moments, which are saved and loaded with the
    states, so old rows aren't read again: df needs the new rows and, before them,
    as many as the pipeline looks back. Rows that it has learnt from are passed
    over. ValueError for pipelines that don't learn from moments, and with events.
    """
    if segments.MOMENTS not in trained.run.states or trained.card.labeler is not None or "event_label" in trained.spine.columns:
        raise ValueError("only pipelines that learn from moments of rows can be updated")
    df, own = _series(df, features)
    if trained.card.preprocessing is not None:
        df, own = preprocess(df, own, trained.card.preprocessing, Run(trained.preprocessing.states))
    return replace(trained, run=segments.updated(trained.card.pipeline, trained.run, trained.splits[-1].split_id, df.withColumn("raw_y", F.col("y")), own))


METRICS = ("n", "rmse", "mse", "mae", "mape", "smape", "r2", "accuracy", "residual_mean", "residual_sd")


def score(results: DataFrame, by: list[str] = ("split_id",), events: DataFrame | None = None) -> DataFrame:
    """METRICS by group, weighted; with events (rid, event_label, event_test_sample_weights) against their labels.

    Rows without a prediction or a truth don't count. r2 and a weightless group's
    metrics are null where they would divide by zero; mape and smape leave out
    rows whose truth, or whose truth and prediction, are 0. Residuals are truths
    less predictions.
    """
    p = c(prediction([x for x in results.columns if x not in ("split_id", "rid", "ts", "y")]))
    w, y = F.lit(1.0), F.col("y")
    if events is not None:
        results = results.join(events.select("rid", "event_label", "event_test_sample_weights"), "rid")
        w, y = F.col("event_test_sample_weights"), F.col("event_label")
    rows = results.select(*by, p.alias("p"), y.alias("y"), w.alias("w")).dropna(subset=["p", "y", "w"])
    e, total = F.col("p") - F.col("y"), F.nullif(F.sum("w"), F.lit(0.0))
    spread = F.sum(F.col("w") * F.col("y") * F.col("y")) - F.sum(F.col("w") * F.col("y")) * F.sum(F.col("w") * F.col("y")) / total
    right = F.when(F.col("p") == F.col("y"), F.col("w")).otherwise(0.0)
    share = lambda a, b: F.sum(F.when(b != 0, F.col("w") * a / F.nullif(b, F.lit(0.0)))) / F.nullif(F.sum(F.when(b != 0, F.col("w"))), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.sum(F.col("w") * e * e) / total).alias("rmse"), (F.sum(F.col("w") * F.abs(e)) / total).alias("mae"),
        (1 - F.sum(F.col("w") * e * e) / F.nullif(spread, F.lit(0.0))).alias("r2"), (F.sum(right) / total).alias("accuracy"),
        (F.sum(F.col("w") * e * e) / total).alias("mse"), share(F.abs(e), F.abs("y")).alias("mape"), share(2 * F.abs(e), F.abs("y") + F.abs("p")).alias("smape"),
        (-F.sum(F.col("w") * e) / total).alias("residual_mean"),
        F.sqrt(F.greatest(F.sum(F.col("w") * e * e) / total - F.pow(F.sum(F.col("w") * e) / total, 2), F.lit(0.0))).alias("residual_sd"),
    )


def train_evaluate(card, df, splitter, features=(), **options) -> tuple[DataFrame, DataFrame, Trained]:
    """(test scores by split, in-sample scores by split, the trained pipeline)."""
    trained = train(card, df, splitter, features, **options)
    events = trained.spine if "event_label" in trained.spine.columns else None
    return score(backtest(trained), events=events), score(in_sample(trained), events=events), trained


def save_states(trained: Trained, path: str) -> None:
    """The fitted states as Parquet, a folder for each block; pyspark.ml models aren't among them."""
    for i, (key, state) in enumerate(sorted(trained.run.states.items())):
        state.withColumn("_path", F.lit(key)).write.mode("overwrite").parquet(f"{path}/state_{i}")


def load_states(spark: SparkSession, path: str, n: int) -> dict[str, DataFrame]:
    found = [spark.read.parquet(f"{path}/state_{i}") for i in range(n)]
    return {s.select("_path").first()[0]: s.drop("_path") for s in found}


def with_states(trained: Trained, states: dict[str, DataFrame]) -> Trained:
    run = Run(states)
    run.models = trained.run.models
    return replace(trained, run=run)
