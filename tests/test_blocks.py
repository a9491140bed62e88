"""Windows cut into small blocks of rows give what SQL gives, and no window is a whole split."""

import numpy as np
import pandas as pd
import pytest
from support import DATA, alike

from chronospark.functions import rows
from chronospark.operators import composites, features, models
from chronospark.plans import engine, splits, tuning
from chronospark.plans.blocks import as_block
from chronospark.queries import EXPANDING, ORACLE_SQL, QUERIES, events_series

WINDOWED = ["lags", "rolling_mean", "rolling_corr", "expanding_mean", "expanding_extremes", "expanding_moments", "expanding_corr", "windows_chained", "lags_of_expanding", "wide_windows", "arrays_of_blocks", "arrays_of_windows", "difference", "clip", "clip_and_ffill", "event_lags", "skip_na", "weight_by_max_expanding", "weight_by_max_fraction", "ols_on_lag", "infer_last_split", "preprocessing_lags", "model_residuals", "transform_target_log", "insample_dedup", "optimizer_in_window"]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(rows, "BLOCK_ROWS", 64)
    monkeypatch.setattr(rows, "GATHERED", 4)


@pytest.mark.parametrize("name", WINDOWED)
def test_query_in_small_blocks(spark, duck, small_blocks, name):
    alike(QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


def test_windows_are_of_blocks(spark, capsys):
    out = engine.train_backtest([features.AddLagsX(("value", 3)), features.AddWindowFeatures(("value", 5, "mean"))], events_series(spark, DATA), EXPANDING, ("value",))
    out.explain("formatted")
    windows = [x for x in capsys.readouterr().out.splitlines() if "windowspecdefinition(split_id" in x]
    assert windows and all("_block" in x for x in windows)


def test_before_block(spark):
    made = spark.createDataFrame([(g, b, float(g + b)) for g in (0, 1) for b in range(0, 40, 1 + g)], "g long, _block long, x double")
    for fn, want in ((rows.ADD, np.sum), (rows.TOP, np.max), (rows.LOW, np.min)):
        got = {(r["g"], r["_block"]): r["x"] for r in rows.before_block(made, {"x": fn}, ["g"]).collect()}
        for g in (0, 1):
            own = list(range(0, 40, 1 + g))
            for i, b in enumerate(own):
                assert got[g, b] == (want([float(g + k) for k in own[:i]]) if i else None)


def test_numbering(spark, small_blocks):
    got = rows.numbered(spark.range(500).withColumnRenamed("id", "rid"), "rid % 7 = 3", "k").orderBy("rid").collect()
    assert [r["k"] for r in got] == list(range(len(got)))


@pytest.mark.parametrize("sampler", [composites.UnderSampler(), composites.OverSampler()])
def test_samplers_balance(spark, sampler):
    from chronospark.plans.blocks import Frame

    made = spark.createDataFrame(pd.DataFrame({"split_id": [0] * 160 + [1] * 30, "rid": list(range(160)) + list(range(30)), "y": [0.0] * 100 + [1.0] * 60 + [0.0] * 10 + [1.0] * 20}))
    frame = Frame(made.selectExpr("*", "true AS train", "true AS _role"), ())
    out = sampler.sample(frame).df.groupBy("split_id", "y").count().toPandas()
    want = {0: 60, 1: 10} if isinstance(sampler, composites.UnderSampler) else {0: 100, 1: 20}
    assert len(out) == 4 and all(out["count"] == out["split_id"].map(want))


def test_optimizer_learns_inside_the_train_window_only(spark):
    """The target jumps in the last fifth, which is a test window: no choice follows it."""
    df = spark.range(1000).selectExpr("id AS rid", "if(id < 800, 1.0D, 9.0D) AS y", "1.0D AS x")
    block = tuning.Optimizer([models.DummyRegressor(0, name="m")], splits.ForwardSingleWindowSplitter(0.5), ({"m¦predicted_value": 1.0}, {"m¦predicted_value": 9.0}))
    out = engine.train_backtest([block], df, splits.ForwardSingleWindowSplitter(0.8), ("x",)).toPandas()
    assert len(out) == 200 and (out["predictions_m"] == 1.0).all()


def test_wide_pca_and_selection(spark):
    from pyspark.ml.feature import PCA, StandardScaler, UnivariateFeatureSelector

    df = events_series(spark, DATA)
    both = engine.train_backtest([StandardScaler(withMean=True)], df, EXPANDING, ("value", "cls"))
    assert {"value", "cls"} <= set(both.columns) and abs(both.toPandas()["value"].mean()) < 0.5
    one = engine.train_backtest([PCA(k=1)], df.withColumn("value", events_null("value")), EXPANDING, ("value", "cls")).toPandas()
    assert one["PCA_0"].isna().any() and one["PCA_0"].notna().any()
    kept = engine.train_backtest([UnivariateFeatureSelector(selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(1)], df, EXPANDING, ("value", "const"))
    assert [x for x in kept.columns if x in ("value", "const")]
    assert as_block(PCA(k=1)).name == ""


def events_null(name):
    from pyspark.sql import functions as F

    return F.when(F.col("rid") % 2 == 0, F.col(name))


def test_invertible_ml_stage(spark):
    from pyspark.ml.feature import StandardScaler

    df = events_series(spark, DATA)
    step = models.FromMlTransformation(StandardScaler(), inverse_function=lambda m, p: p * float(m.std[0]), name="unit")
    got = engine.train_backtest([composites.TransformTarget([models.LinearRegression()], (step,))], df, EXPANDING, ("value",)).toPandas().sort_values("rid")
    plain = engine.train_backtest([models.LinearRegression()], df, EXPANDING, ("value",)).toPandas().sort_values("rid")
    assert np.allclose(got["predictions_LinearRegression"], plain["predictions_LinearRegression"])


def test_type_checks(spark):
    df = spark.range(5).selectExpr("id AS rid", "'a' AS y")
    with pytest.raises(TypeError):
        engine.check_types(df)
    with pytest.raises(ValueError):
        engine.check_types(df.drop("y"))
    with pytest.raises(ValueError):
        engine.check_types_multi_series(df)


def test_multinomial_logistic_by_coefficients(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(600).selectExpr("id AS rid", "double(id % 3) AS y", "double(id % 3) * 2 + (id % 7) / 7 AS x")
    out = engine.train_backtest([models.FromMl(LogisticRegression(maxIter=50), name="m")], df, splits.ForwardSingleWindowSplitter(0.5), ("x",)).toPandas()
    assert (out["predictions_m"] == out["y"]).mean() > 0.95
    assert np.allclose(out[[f"probabilities_m_{k}" for k in range(3)]].sum(axis=1), 1)


@pytest.mark.parametrize("rows_a_block", [16, 1 << 16])
def test_known_rows_are_counted_across_blocks(spark, monkeypatch, rows_a_block):
    """Windows of SkipNA count known rows, though unknown ones fill whole blocks between them."""
    monkeypatch.setattr(rows, "BLOCK_ROWS", rows_a_block)
    known = lambda i: i % 3 != 0 and not 60 <= i < 130
    df = spark.createDataFrame([(i, float(i * i % 37) if known(i) else None, float(i)) for i in range(300)], "rid long, x double, y double")
    block = composites.SkipNA([features.AddLagsX(("x", 2)), features.AddWindowFeatures(("x~lag_2", 4, "sum"), keep_original=False)])
    splitter = splits.ForwardSingleWindowSplitter(0.1)
    out = engine.train_backtest([block], df, splitter, ("x",)).orderBy("rid").toPandas()
    x = pd.Series({i: float(i * i % 37) for i in range(300) if known(i)})
    # context before the test window is counted in rows, known or not
    x = x[x.index >= 30 - 4]
    want = x.shift(2).rolling(4, min_periods=1).sum().reindex(range(30, 300))
    assert (out["x~lag_2~sum_4"].isna().to_numpy() == want.isna().to_numpy()).all()
    assert (out["x~lag_2~sum_4"] - want.to_numpy()).abs().max() < 1e-9


def test_a_grid_of_an_empty_table_is_empty(spark):
    from chronospark.sources import series

    none = spark.createDataFrame([], "ts timestamp_ntz, tie long, v double")
    assert series.resample_last(none, "ts", "tie", "1 hour").count() == 0


def close(got, want):
    """Whether two results hold the same rows, numbers but for their last digits."""
    a, b = (x.sort_values(["split_id", "rid"]).reset_index(drop=True) for x in (got, want))
    assert list(a.columns) == list(b.columns)
    for k in a.columns:
        if a[k].dtype.kind == "f":
            np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=k)
        else:
            assert (a[k] == b[k]).all()


@pytest.mark.parametrize("second", [features.AddWindowFeatures(("value~mean_expanding", 9, "sum")), features.AddWindowFeatures(("value~max_expanding", 20, "mean"))])
def test_windows_over_columns_of_all_rows_so_far(spark, monkeypatch, second):
    """Context rows of a block hold what all rows up to them give, not all rows before the block."""
    pipeline = [features.AddWindowFeatures([("value", None, "mean"), ("value", None, "max")]), second]
    df = events_series(spark, DATA)
    whole = engine.train_backtest(pipeline, df, EXPANDING, ("value",)).toPandas()
    monkeypatch.setattr(rows, "BLOCK_ROWS", 32)
    close(engine.train_backtest(pipeline, df, EXPANDING, ("value",)).toPandas(), whole)


def test_filled_changes_under_windows(spark, monkeypatch):
    pipeline = [features.Difference(fill_0_with_last=True), features.AddWindowFeatures(("cls", 9, "sum"))]
    df = events_series(spark, DATA)
    whole = engine.train_backtest(pipeline, df, EXPANDING, ("cls",)).toPandas()
    monkeypatch.setattr(rows, "BLOCK_ROWS", 32)
    close(engine.train_backtest(pipeline, df, EXPANDING, ("cls",)).toPandas(), whole)


_WIDE = [("value", w, fn) for w in (65, 400) for fn in ("sum", "max")] + [("value_n", 129, fn) for fn in ("mean", "std", "skew")]


@pytest.mark.parametrize("more", [[], [features.AddLagsX(("value~sum_400", [3, 70]))]])
def test_wide_windows(spark, monkeypatch, more):
    """Windows of more rows than a piece give what windows inside one block give, over block borders and under later windows."""
    df = events_series(spark, DATA)
    want = engine.train_backtest([features.AddWindowFeatures(_WIDE), *more], df, EXPANDING, ("value", "value_n")).toPandas()
    monkeypatch.setattr(rows, "BLOCK_ROWS", 64)
    monkeypatch.setattr(rows, "GATHERED", 2)
    block = features.AddWindowFeatures(_WIDE)
    assert block.reach == 0 and block.memory == 400
    close(engine.train_backtest([block, *more], df, EXPANDING, ("value", "value_n")).toPandas(), want)
