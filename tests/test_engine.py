import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronospark.functions import names
from chronospark.functions import rows as rows_of
from chronospark.operators import composites as comp
from chronospark.operators import events as ev
from chronospark.operators import features as feat
from chronospark.operators import models as mod
from chronospark.operators import scaling as sc
from chronospark.plans import engine, tuning
from chronospark.plans.blocks import Identity, memory_of, names_of
from chronospark.plans.splits import ExpandingWindowSplitter
from chronospark.sources import series

SPLITTER = ExpandingWindowSplitter(400, 200)


@pytest.fixture(scope="module")
def sine(spark):
    return series.sine(spark, 1000).cache()


def test_generated_series(spark, sine):
    assert sine.count() == 1000
    rows = sine.orderBy("rid").toPandas()
    assert (rows["y"].iloc[:-1].to_numpy() == rows["x"].iloc[1:].to_numpy()).all()
    assert series.zeros(spark, 10).agg(F.sum("x")).first()[0] == 0
    assert 60 < series.zeros_and_ones(spark, 100, 0.8).agg(F.sum("x")).first()[0] <= 100
    assert series.monotonous(spark, 10).agg(F.max("y")).first()[0] == 1


def test_names():
    columns = ["a", "ab", "b_c"]
    assert names.select(["a*", "*c", "a"], columns) == ["a", "ab", "b_c"]
    assert names.select("all", columns) == columns
    assert names.is_prediction(["predictions_m", "probabilities_m_0"]) and not names.is_prediction(columns)
    assert names.prediction(["x"]) == "x" and names.classes(["probabilities_m_1"]) == ["1"]
    assert names.nested({"a¦b": 1, "a¦c": 2}) == {"a": {"b": 1, "c": 2}}
    with pytest.raises(ValueError):
        names.prediction(columns)


def test_test_rows_are_covered_once(sine):
    out = engine.train_backtest([Identity()], sine, SPLITTER, ("x",)).toPandas()
    assert sorted(out["rid"]) == list(range(400, 1000))


def test_lags_and_windows_equal_pandas(sine):
    pipeline = [feat.AddLagsX(("x", [1, 3])), feat.AddWindowFeatures([("x", 8, "mean"), ("x", 8, "std")])]
    out = engine.train_backtest(pipeline, sine, SPLITTER, ("x",)).orderBy("rid").toPandas()
    x = sine.orderBy("rid").toPandas()["x"]
    for name, want in {"x~lag_1": x.shift(1), "x~lag_3": x.shift(3), "x~mean_8": x.rolling(8, min_periods=1).mean(), "x~std_8": x.rolling(8, min_periods=1).std()}.items():
        assert (out[name].to_numpy() - want.iloc[400:].to_numpy() < 1e-9).all(), name
    assert memory_of(pipeline) == 8 and names_of(pipeline) == "lags->windows"


def test_no_look_ahead(sine):
    pipeline = [feat.AddLagsX(("x", 2)), sc.StandardScaler(), mod.LinearRegression()]
    whole = engine.train_backtest(pipeline, sine, SPLITTER, ("x",)).where("rid < 600").orderBy("rid").toPandas()
    cut = engine.train_backtest(pipeline, sine.where("rid < 600"), SPLITTER, ("x",), n=600).orderBy("rid").toPandas()
    assert (whole["predictions_LinearRegression"] - cut["predictions_LinearRegression"]).abs().max() < 1e-9


def test_partitions_do_not_matter(sine):
    pipeline = [feat.AddLagsX(("x", 2)), mod.LinearRegression()]
    a = engine.train_backtest(pipeline, sine.repartition(7), SPLITTER, ("x",)).orderBy("rid").toPandas()
    b = engine.train_backtest(pipeline, sine.coalesce(1), SPLITTER, ("x",)).orderBy("rid").toPandas()
    assert (a["predictions_LinearRegression"] - b["predictions_LinearRegression"]).abs().max() < 1e-9


def test_infer_equals_backtest(sine):
    pipeline = [feat.AddLagsX(("x", [1, 2]), keep_original=False), mod.LinearRegression()]
    trained = engine.train(pipeline, sine, SPLITTER, ("x",))
    last = engine.backtest(trained).where("split_id = 2").select("rid", F.col("predictions_LinearRegression").alias("p"))
    both = last.join(engine.infer(trained, sine.select("rid", "ts", "x"), ("x",)), "rid").toPandas()
    assert len(both) == 200 and (both["p"] - both["predictions_LinearRegression"]).abs().max() < 1e-9


def test_states_survive_a_round_trip(spark, sine, tmp_path):
    trained = engine.train([sc.MinMaxScaler(), mod.LinearRegression()], sine, SPLITTER, ("x",))
    engine.save_states(trained, str(tmp_path))
    loaded = engine.with_states(trained, engine.load_states(spark, str(tmp_path), len(trained.run.states)))
    a = engine.infer(trained, sine.select("rid", "ts", "x"), ("x",)).orderBy("rid").toPandas()
    b = engine.infer(loaded, sine.select("rid", "ts", "x"), ("x",)).orderBy("rid").toPandas()
    assert a.equals(b)


def test_event_counts(sine):
    long = sine.where("rid < 1000")
    for horizon, nth, want in ((1, 5, 120), (10, 1, 590), (10, 5, 118)):
        card = engine.PipelineCard([mod.DummyRegressor(1)], labeler=ev.FixedForwardHorizon(horizon), event_filter=ev.EveryNth(nth))
        out = engine.train_backtest(card, long, SPLITTER, ("x",))
        assert out.count() == 600
        assert out.where("predictions_DummyRegressor IS NOT NULL").count() == want


def test_blocks_of_rows_equal_one_window(spark):
    df = spark.range(500).select(F.col("id").alias("rid"), (F.col("id") * 7 % 31).cast("double").alias("v"))
    dealt = rows_of.blocked(df, 9, 4, rows=50)
    out = dealt.select("rid", "_halo", F.sum("v").over(rows_of.block_window().rowsBetween(-9, 4)).alias("s")).where("NOT _halo").orderBy("rid").toPandas()
    v = pd.Series([i * 7 % 31 for i in range(500)], dtype=float)
    want = [v[max(0, i - 9) : i + 5].sum() for i in range(500)]
    assert out["s"].tolist() == want


def test_residuals_and_two_feature_regression(spark):
    df = spark.range(300).select(F.col("id").alias("rid"), F.lit(None).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 5)
    out = engine.train_backtest([mod.LinearRegression()], df, ExpandingWindowSplitter(100, 100), ("a", "b")).toPandas()
    assert (out["y"] - out["predictions_LinearRegression"]).abs().max() < 1e-6
    residual = comp.ModelResiduals([mod.DummyRegressor(4)], [mod.LinearRegression()], True)
    out = engine.train_backtest([residual], df, ExpandingWindowSplitter(100, 100), ("a", "b")).toPandas()
    assert (out["y"] - out["predictions_ModelResiduals"]).abs().max() < 1e-6 and (out["predictions_DummyRegressor"] == 4).all()


def test_selection(sine):
    df = sine.withColumns({"flat": F.lit(1.0), "noise": F.pmod(F.xxhash64("rid"), F.lit(100)) / 100})
    trained = engine.train([sc.RemoveLowVariance(), sc.SelectKBest(1)], df, SPLITTER, ("flat", "noise", "x"))
    assert trained.outputs == ("x",)
    with pytest.raises(ValueError):
        engine.train([sc.RemoveLowVariance()], df, SPLITTER, ("flat",))


def test_tuning(sine):
    best, table = tuning.tune([sc.StandardScaler(), mod.DummyRegressor(0, name="dummy")], sine, SPLITTER, ("x",), candidates=[{"dummy¦predicted_value": v} for v in (5.0, 0.0, -5.0)])
    assert best == {"dummy¦predicted_value": 0.0} and table.count() == 3
    choice = comp.SelectBest((mod.DummyRegressor(5.0, name="far"), mod.DummyRegressor(0.0, name="near")))
    best, _ = tuning.tune([choice], sine, SPLITTER, ("x",))
    assert best == {"SelectBest¦selected": "near"}


def test_importances_and_ml(sine):
    from pyspark.ml.regression import DecisionTreeRegressor

    df = sine.withColumn("noise", F.pmod(F.xxhash64("rid"), F.lit(100)) / 100)
    trained = engine.train([DecisionTreeRegressor(maxDepth=3)], df, ExpandingWindowSplitter(600, 300), ("x", "noise"))
    path, = trained.run.models
    assert all(v[0][0] == "x" for v in mod.importances(trained.run, path, ["x", "noise"]).values())


def test_in_sample_takes_the_last_split(sine):
    trained = engine.train([mod.LinearRegression()], sine, SPLITTER, ("x",))
    out = engine.in_sample(trained).toPandas()
    assert len(out) == 800 and (out["split_id"] == 2).all()


def test_holidays_and_dates(spark):
    from chronospark.sources import calendars

    assert str(calendars.easter(2024)) == "2024-03-31" and str(calendars.easter(2019)) == "2019-04-21"
    days = lambda code, year: {str(r["day"]) for r in calendars.holidays(spark, code, range(year, year + 1)).collect()}
    assert {"2024-12-25", "2024-04-01", "2024-05-09", "2024-10-03"} <= days("DE", 2024) and len(days("DE", 2024)) == 9
    assert {"2021-12-31", "2021-06-18", "2021-06-19", "2021-07-05", "2021-11-25"} <= days("us", 2021)
    assert {"2022-06-02", "2022-06-03", "2022-09-19", "2022-12-27", "2022-01-03"} <= days("GB", 2022) and "2022-05-30" not in days("GB", 2022)
    closed = {str(r["day"]) for r in calendars.closed_days(spark, "all", range(2021, 2022)).where("code = 'NYSE' AND holiday <> 'weekend'").collect()}
    assert closed == {"2021-01-01", "2021-01-18", "2021-02-15", "2021-04-02", "2021-05-31", "2021-07-05", "2021-09-06", "2021-11-25", "2021-12-24"}
    with pytest.raises(ValueError):
        calendars.holidays(spark, "XX", range(2021, 2022))


def test_streaming(spark, tmp_path):
    from chronospark.streaming.features import stream_features

    rows = [(k, i, float(i * (k + 1))) for k in range(2) for i in range(10)]
    source = str(tmp_path / "in")
    schema = "k long, t long, v double"
    for part in (rows[:4] + rows[10:13], rows[4:10] + rows[13:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = stream_features(stream, "k", "t", "v", [1, 3], 4)
    run = out.writeStream.format("memory").queryName("stream_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    got = spark.table("stream_out").toPandas().sort_values(["k", "t"])
    assert len(got) == 20
    for k, g in got.groupby("k"):
        v = pd.Series([float(i * (k + 1)) for i in range(10)])
        assert g["lag_3"].fillna(-1).tolist() == v.shift(3).fillna(-1).tolist()
        assert g["rolling_mean"].tolist() == v.rolling(4, min_periods=1).mean().tolist()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 2, float("nan"))], "t long, i long, v double")
    assert series.clean(df).where("v IS NULL").count() == 1
    assert {r["v"] for r in series.deduplicate(df.where("t = 1"), "t", "i", "last").collect()} == {6.0}
    series.write(df, str(tmp_path / "x.parquet"))
    assert series.read(spark, str(tmp_path / "x.parquet")).count() == 3
    with pytest.raises(ValueError):
        series.require_columns(df, ["missing"])
    assert [r["rid"] for r in series.with_rid(df.repartition(3), ["t", "i"]).orderBy("t", "i").collect()] == [0, 1, 2]


def test_splitters_take_timestamps(sine):
    ts = sine.where("rid = 300").first()["ts"]
    out = engine.train_backtest([Identity()], sine, ExpandingWindowSplitter(100, 300, start=ts), ("x",))
    assert out.agg(F.min("rid")).first()[0] == 400
    with pytest.raises(ValueError):
        engine.train([Identity()], sine, ExpandingWindowSplitter(100, 300, start="1999-01-01"), ("x",))
