"""Several series in one table against each series alone."""

import numpy as np
import pandas as pd
import pytest
from support import DATA, alike

from chronospark.functions import rows
from chronospark.operators import composites, features, models
from chronospark.plans import engine, panel, splits
from chronospark.queries import ORACLE_SQL, QUERIES

STEPS = [features.AddWindowFeatures([("x", 4, "mean"), ("x", None, "max")]), models.LinearRegression(ridge=0.1)]


@pytest.fixture(scope="module")
def table():
    """A long series and short ones, one of them of a null id."""
    rng, parts = np.random.default_rng(3), []
    for name, n in (("long", 300), ("b", 41), (None, 33), ("one", 1), ("two", 2)):
        x = rng.normal(size=n)
        parts.append(pd.DataFrame({"unique_id": [name] * n, "ds": pd.date_range("2024-01-01", periods=n, freq="h"), "x": x, "y": 2 * x + rng.normal(size=n)}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("splitter", [splits.ExpandingWindowSplitter(0.4, 0.1), splits.SlidingWindowSplitter(0.3, 0.2), splits.SlidingWindowSplitter(12, 7)])
def test_each_series_alone(spark, monkeypatch, table, splitter):
    monkeypatch.setattr(rows, "BLOCK_ROWS", 32)
    got = panel.backtest(STEPS, spark.createDataFrame(table), splitter, ("x",)).toPandas()
    assert not got.duplicated(["unique_id", "rid"]).any()
    for name, own in table.groupby("unique_id", dropna=False):
        mine = got[got["unique_id"].isna() if name is None or pd.isna(name) else got["unique_id"] == name].sort_values("rid")
        if len(own) < 30:
            assert len(mine) < len(own) or mine["predictions_LinearRegression"].isna().any()
            continue
        df = spark.createDataFrame(own.reset_index(drop=True).reset_index(names="rid").rename(columns={"ds": "ts"}).drop(columns="unique_id"))
        want = engine.train_backtest(STEPS, df, splitter, ("x",)).orderBy("rid").toPandas()
        assert list(mine["rid"]) == list(want["rid"]) and list(mine["split"]) == list(want["split_id"])
        np.testing.assert_allclose(mine["predictions_LinearRegression"], want["predictions_LinearRegression"], rtol=1e-6)


@pytest.mark.parametrize("name", ["panel_lags", "panel_ols"])
def test_query_in_small_blocks(spark, duck, monkeypatch, name):
    monkeypatch.setattr(rows, "BLOCK_ROWS", 16)
    alike(QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


def test_what_is_refused(spark, table):
    df = spark.createDataFrame(table)
    with pytest.raises(ValueError):
        panel.backtest([composites.Sample(composites.UnderSampler(), models.LinearRegression())], df, splits.ExpandingWindowSplitter(0.4, 0.1), ("x",))
    with pytest.raises(ValueError):
        panel.backtest(STEPS, df, splits.ForwardSingleWindowSplitter(0.5), ("x",))
    with pytest.raises(ValueError):
        panel.backtest(STEPS, df.drop("ds"), splits.ExpandingWindowSplitter(0.4, 0.1), ("x",))
    assert panel.backtest(STEPS, df.limit(0), splits.ExpandingWindowSplitter(0.4, 0.1), ("x",)).count() == 0
