"""What is fitted from moments equals what is fitted on tagged rows, and rows are read no more often than needed."""

import pytest
from pyspark.sql import functions as F

from chronospark.operators import columns as cols
from chronospark.operators import composites as comp
from chronospark.operators import events as ev
from chronospark.operators import features as feat
from chronospark.operators import models as mod
from chronospark.operators import scaling as sc
from chronospark.plans import engine, segments
from chronospark.plans.blocks import Identity, Sequence, as_block, reach_of
from chronospark.plans.splits import Bounds, CombinedSplitter, ExpandingWindowSplitter, ForwardSingleWindowSplitter, SlidingWindowSplitter, Split, dealt, plan_splits, stretches
from chronospark.sources import series

EXPANDING, SLIDING = ExpandingWindowSplitter(400, 150), SlidingWindowSplitter(300, 200)
LR = mod.LinearRegression
BACK = [feat.AddLagsX(("x", [1, 2])), feat.AddWindowFeatures(("x", 5, "mean"))]
PIPELINES = {
    "windows": [*BACK, LR()],
    "ridge": [*BACK, LR(3.0)],
    "two scalers": [sc.StandardScaler(), sc.MinMaxScaler((1, 3)), LR()],
    "scaler last": [*BACK, sc.TurnPositive()],
    "clipped": [sc.MinMaxScaler(clip=True)],
    "ensemble": [feat.AddLagsX(("x", 1)), comp.Ensemble(([sc.StandardScaler(), LR(1.0)], [feat.AddLagsX(("x", 3)), LR(name="b")], [mod.DummyRegressor(2)]))],
    "residuals": [comp.ModelResiduals([cols.SelectColumns("x"), LR(2.0)], [feat.AddLagsX(("x", 1), keep_original=False), sc.StandardScaler(), LR(name="meta")], True)],
    "residuals of an ensemble": [comp.ModelResiduals([comp.Ensemble(([LR(1.0)], [LR(9.0, name="b")]))], [LR()])],
    "residuals of residuals": [comp.ModelResiduals([mod.DummyRegressor(4)], [comp.ModelResiduals([cols.SelectColumns("x"), LR(5.0)], [LR()])])],
    "target log": [comp.TransformTarget([LR()], (feat.MultiplyBy(0.2), sc.TurnPositive(), feat.MultiplyBy(3.0)))],
    "target scaled": [comp.TransformTarget([comp.ModelResiduals([LR(2.0)], [LR()])], (sc.StandardScaler(),))],
    "target min-max": [comp.TransformTarget([LR(1.0)], (sc.MinMaxScaler((0, 5)),))],
    "columns": [comp.TransformColumn("x", [*BACK, sc.StandardScaler()]), cols.RenameColumns({"hole": "h"}), cols.DropColumns(["x~*"]), LR()],
    "each column": [comp.TransformEachColumn([sc.StandardScaler()]), comp.EnsembleEachColumn([LR()])],
    "concat": [comp.Concat(([sc.StandardScaler()], [*BACK, cols.SelectColumns(["x~*"])])), LR()],
    "known rows": [comp.SkipNA([sc.StandardScaler(), LR()])],
    "best": [comp.SelectBest((LR(name="a"), mod.DummyRegressor(1.0, name="b")), "a")],
    "prediction scaled": [LR(), sc.StandardScaler()],
}


@pytest.fixture(scope="module")
def rows(spark):
    df = series.sine(spark, 1000)
    return df.withColumns({"x": F.col("x") + F.pmod(F.xxhash64("rid"), F.lit(50)) / 100, "hole": F.when(F.col("rid") % 13 != 0, F.cos("rid")), "flat": F.lit(2.0)}).cache()


def same(a, b):
    a, b = (x.orderBy("split_id", "rid").toPandas() for x in (a, b))
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) > 0
    for name in a.columns:
        assert (a[name].isna() == b[name].isna()).all(), name
        if a[name].dtype.kind == "f":
            assert not (a[name] - b[name]).abs().max() > 1e-8, name


@pytest.mark.parametrize("name", PIPELINES)
def test_moments_equal_tagged_rows(rows, name, monkeypatch):
    pipeline, seen, fitted = PIPELINES[name], [], segments.fitted
    splitter = SLIDING if reach_of(pipeline) == 0 and len(name) % 2 else EXPANDING
    monkeypatch.setattr(segments, "fitted", lambda *a: seen.append(fitted(*a)) or seen[-1])
    lean = engine.train(pipeline, rows, splitter, ("x", "hole", "flat"))
    assert seen[0] is not None
    a, inside = engine.backtest(lean), engine.in_sample(lean)
    monkeypatch.setattr(segments, "fitted", lambda *a: None)
    whole = engine.train(pipeline, rows, splitter, ("x", "hole", "flat"))
    same(a, engine.backtest(whole))
    same(inside, engine.in_sample(whole))


@pytest.mark.parametrize("name", ["windows", "two scalers", "ensemble", "residuals"])
def test_moments_of_weighted_events(rows, name, monkeypatch):
    labeler = ev.FixedForwardHorizon(3, weighting_strategy=ev.WeightByMax(None))
    card = engine.PipelineCard(PIPELINES[name], labeler=labeler, event_filter=ev.EveryNth(3))
    a = engine.train_backtest(card, rows, EXPANDING, ("x", "hole"))
    monkeypatch.setattr(segments, "fitted", lambda *a: None)
    same(a, engine.train_backtest(card, rows, EXPANDING, ("x", "hole")))


def test_what_moments_cannot_say_is_tagged(rows):
    of = lambda p, s=EXPANDING, f=("x",): segments.fitted(p, rows.withColumn("raw_y", F.col("y")), f, plan_splits(s, 1000))
    assert of([feat.AddWindowFeatures(("x", None, "mean")), LR()]) is None
    assert of([sc.SelectKBest(1), LR()]) is None
    assert of([LR(), feat.AddLagsX(("predictions_LinearRegression", 1)), LR()]) is None
    assert of([sc.MinMaxScaler(clip=True), LR()]) is None
    assert of([comp.MetaLabeling([LR()], [LR()])]) is None
    assert of([feat.AddLagsX(("x", 1)), LR()], SLIDING) is None
    assert of([Identity()]) is None


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_stateless_pipelines_have_no_train_rows(rows):
    for pipeline in (BACK, [feat.Difference()], [feat.AddWindowFeatures(("x", None, "mean"))]):
        logical, physical = plan(engine.train_backtest(pipeline, rows, EXPANDING, ("x",)))
        assert "Union" not in logical and "NestedLoop" not in physical and "_lo" not in logical
    inside = engine.in_sample(engine.train(BACK, rows, EXPANDING, ("x",)))
    assert inside.count() == 850 and "Aggregate" not in plan(inside)[0]


def test_results_do_not_read_train_rows_again(rows):
    for pipeline in (PIPELINES["residuals"], [sc.SelectKBest(1), LR()], [feat.AddWindowFeatures(("x", None, "mean")), sc.StandardScaler(), feat.AddLagsX(("x", 1)), LR()]):
        logical, physical = plan(engine.train_backtest(pipeline, rows, EXPANDING, ("x", "flat")))
        assert "Union" not in logical and "NestedLoop" not in physical


def test_early_steps_are_taken_once(rows, monkeypatch):
    """Lags of train rows are computed before rows are repeated, and equal those computed after."""
    from pyspark.ml.regression import DecisionTreeRegressor

    pipeline = [*BACK, DecisionTreeRegressor(maxDepth=3, seed=1)]
    a = engine.train_backtest(pipeline, rows, EXPANDING, ("x",))
    monkeypatch.setattr(segments, "is_local", lambda b: False)
    same(a, engine.train_backtest(pipeline, rows, EXPANDING, ("x",)))


@pytest.mark.parametrize("splitter", [EXPANDING, SLIDING, CombinedSplitter((ForwardSingleWindowSplitter(0.3), SLIDING), EXPANDING)])
def test_rows_by_stretches(spark, splitter):
    splits = plan_splits(splitter, 1000)
    rows = spark.range(1100).withColumnRenamed("id", "rid")
    got = {(r["split_id"], r["rid"]) for r in dealt(rows, [(s.split_id, b.start, b.end) for s in splits for b in s.train]).collect()}
    assert got == {(s.split_id, i) for s in splits for i in s.train_rows()}


def test_stretches():
    assert stretches([(0, 0, 4), (1, 0, 6), (3, 2, 6), (9, 5, 5)]) == [(0, 2, 0, 1), (2, 4, 0, 1), (2, 4, 3, 3), (4, 6, 1, 1), (4, 6, 3, 3)]
    assert stretches([]) == []


def test_context_of_last_train_rows(spark):
    from chronospark.plans.splits import tag_last_train_rows

    splits = [Split(0, (Bounds(0, 10),), (Bounds(10, 12),)), Split(1, (Bounds(4, 6),), (Bounds(12, 14),))]
    got = sorted((r["split_id"], r["_run"], r["rid"], r["halo"]) for r in tag_last_train_rows(spark.range(20).withColumnRenamed("id", "rid"), splits, 2).collect())
    assert [x[2] for x in got if not x[3]] == [0, 1, 2, 3, 6, 7, 8, 9, 4, 5] and [x[2] for x in got if x[3]] == [4, 5]
    assert {x[0] for x in got if x[2] in (4, 5) and not x[3]} == {1}


def test_reach_adds_up_in_sequences_only():
    side = comp.Concat(([feat.AddLagsX(("x", 3))], [feat.AddLagsX(("x", 9)), feat.AddWindowFeatures(("x", 4, "mean"))]))
    assert reach_of(side) == 13 and reach_of([side, feat.AddLagsX(("x", 2))]) == 15
    assert as_block([Identity()]).learns is False and Sequence((LR(),)).learns is True


@pytest.mark.parametrize("name", ["windows", "two scalers", "ensemble", "residuals", "target scaled", "known rows", "columns"])
def test_a_state_that_is_updated_equals_one_fitted_on_all(spark, rows, name, tmp_path):
    from chronospark.plans.splits import WholeWindowSplitter

    pipeline, features = PIPELINES[name], ("x", "hole", "flat")
    back = reach_of(pipeline)
    whole = engine.train(pipeline, rows, WholeWindowSplitter(1), features, n=1000, need_in_sample=False)
    part = engine.train(pipeline, rows.where("rid < 500"), WholeWindowSplitter(1), features, n=500, need_in_sample=False)
    part = engine.update(part, rows.where(f"rid >= {500 - back} AND rid < 730"), features)
    engine.save_states(part, str(tmp_path))
    part = engine.with_states(part, engine.load_states(spark, str(tmp_path), len(part.run.states)))
    part = engine.update(part, rows.where(f"rid >= {730 - back}"), features)
    again = engine.update(part, rows.where("rid > 900"), features)  # nothing new
    want = engine.infer(whole, rows, features).withColumn("split_id", F.lit(0))
    same(engine.infer(part, rows, features).withColumn("split_id", F.lit(0)), want)
    same(engine.infer(again, rows, features).withColumn("split_id", F.lit(0)), want)


def test_what_cannot_be_updated(rows):
    trained = engine.train([sc.SelectKBest(1)], rows, EXPANDING, ("x", "flat"), need_in_sample=False)
    with pytest.raises(ValueError):
        engine.update(trained, rows, ("x", "flat"))
