"""Tuning inside train windows: candidates that look back further, rounds, and choices."""

import pytest
from pyspark.sql import functions as F

from chronospark.operators import composites as comp
from chronospark.operators import features as feat
from chronospark.operators import models as mod
from chronospark.plans import engine, tuning
from chronospark.plans.blocks import memory_of, reach_of
from chronospark.plans.splits import ExpandingWindowSplitter, ForwardSingleWindowSplitter
from chronospark.sources import series

SPLITTER = ExpandingWindowSplitter(400, 200)
LAGS = [feat.AddLagsX(("x", 1), keep_original=False, name="lags"), mod.LinearRegression()]


@pytest.fixture(scope="module")
def rows(spark):
    df = series.sine(spark, 1000)
    return df.withColumn("x", F.pmod(F.xxhash64("rid"), F.lit(1000)) / 1000).withColumn("y", F.when(F.col("rid") >= 50, 2 * F.pmod(F.xxhash64(F.col("rid") - 50), F.lit(1000)) / 1000 - 1).otherwise(0.0)).cache()


def sorted_rows(df):
    return df.orderBy("split_id", "rid").toPandas()


@pytest.mark.parametrize("tries", [(50,), (1, 7, 50)])
def test_a_tuned_lag_equals_the_pipeline_with_it(rows, tries):
    block = tuning.Optimizer(LAGS, ForwardSingleWindowSplitter(0.5), tuple({"lags¦columns_and_lags": ("x", k)} for k in tries))
    assert memory_of(block) == max(tries) == reach_of(block)
    tuned = sorted_rows(engine.train_backtest([block], rows, SPLITTER, ("x",)))
    direct = sorted_rows(engine.train_backtest([feat.AddLagsX(("x", 50), keep_original=False), mod.LinearRegression()], rows, SPLITTER, ("x",)))
    name = "predictions_LinearRegression"
    assert tuned[name].notna().all() and (tuned[name] - direct[name]).abs().max() < 1e-9


def test_halving_goes_on_with_the_better_half(rows):
    seen = []

    class Watched(tuning.Halving):
        def next(self, n, rounds):
            plan = super().next(n, rounds)
            seen.append((len(rounds), plan))
            return plan

    block = tuning.Optimizer(LAGS, ExpandingWindowSplitter(0.4, 0.1), tuple({"lags¦columns_and_lags": ("x", k)} for k in (1, 2, 3, 50, 5)), search=Watched(0.25))
    trained = engine.train([block], rows, SPLITTER, ("x",), need_in_sample=False)
    assert {r["chosen"] for r in trained.run.states["main/0"].collect()} == {3}
    assert [len(p[0]) for k, p in seen if k == 0] == [5] * 3 and [len(p[0]) for k, p in seen if k == 1] == [3] * 3
    assert all(p[1] == 0.5 and 3 in p[0] for k, p in seen if k == 1) and all(p is None for k, p in seen if k == 3)


def test_searches():
    assert tuning.Grid().next(3, []) == ([0, 1, 2], 1.0) and tuning.Grid().next(3, [(1.0, {})]) is None
    assert tuning.Halving().next(4, [(0.25, {0: 3.0, 1: None, 2: 1.0, 3: 1.0})]) == ([2, 3], 0.5)
    assert tuning.Halving().next(4, [(0.5, {2: 1.0, 3: 1.0})]) is None


def test_candidates_with_names_of_their_own_and_an_outer_search(rows):
    inner = tuning.Optimizer(feat.AddLagsX(("x", 1), keep_original=False, name="lags"), ForwardSingleWindowSplitter(0.5), ({"lags¦columns_and_lags": ("x", 1)}, {"lags¦columns_and_lags": ("x", 50)}))
    out = sorted_rows(engine.train_backtest([inner], rows, SPLITTER, ("x",)))
    x = rows.orderBy("rid").toPandas()["x"]
    assert (out["x~lag_50"].to_numpy() == x.shift(50).iloc[400:].to_numpy()).all()
    best, _ = tuning.tune([inner, comp.SelectBest((mod.LinearRegression(name="near"), mod.DummyRegressor(9.0, name="far")))], rows, SPLITTER, ("x",))
    assert best == {"SelectBest¦selected": "near"}


@pytest.mark.parametrize("search", [tuning.Grid(), tuning.Halving(0.5)])
def test_losses_of_moments_choose_as_losses_of_rows(rows, search, monkeypatch):
    """One pass over rows that aren't repeated; tagged rows, which cost a row a window, aren't made."""
    noisy = rows.withColumn("y", F.col("y") + F.pmod(F.xxhash64(F.col("rid") + 5), F.lit(1000)) / 500)
    pipeline = [feat.AddWindowFeatures(("x", 2, "mean"), keep_original=False, name="windows"), mod.LinearRegression()]
    block = tuning.Optimizer(pipeline, ExpandingWindowSplitter(0.5, 0.125), tuple({"windows¦column_window_fn": ("x", k, "mean")} for k in (2, 3, 8, 60)), search=search)
    with monkeypatch.context() as m:
        m.setattr(tuning.Optimizer, "_inner", lambda *a: pytest.fail("rows were repeated for inner windows"))
        once = engine.train([block], noisy, SPLITTER, ("x",), need_in_sample=False)
    monkeypatch.setattr(tuning.Optimizer, "fit_at_once", lambda *a: False)
    tagged = engine.train([block], noisy, SPLITTER, ("x",), need_in_sample=False)
    choice = lambda t: sorted(map(tuple, t.run.states["main/0"].collect()))
    assert choice(once) == choice(tagged) and set(once.run.states) == set(tagged.run.states)
    a, b = sorted_rows(engine.backtest(once)), sorted_rows(engine.backtest(tagged))
    name = "predictions_LinearRegression"
    assert len(a) == len(b) and (a[name] - b[name]).abs().max() < 1e-9
