"""Functions of arrays over blocks of rows."""

import numpy as np
import pytest
from support import DATA

from chronospark.functions import rows
from chronospark.operators.arrays import ApplyArrays, RollingArrays
from chronospark.operators.features import AddLagsX
from chronospark.plans import engine
from chronospark.queries import EXPANDING, events_series


def infer_like(spark, pipeline, df, names):
    """A pipeline on the whole series, as preprocessing."""
    return engine.preprocess(df, names, pipeline, engine.Run())[0].orderBy("rid").toPandas()


def test_nulls_first_rows_and_types(spark, monkeypatch):
    monkeypatch.setattr(rows, "BLOCK_ROWS", 64)
    df = events_series(spark, DATA)
    got = infer_like(spark, [RollingArrays(lambda w: np.nanmax(np.where(np.isnan(w), -1.0, w), axis=1), 7, "value_n", "top", output_dtype="int")], df, ("value_n", "cls"))
    x = df.orderBy("rid").toPandas()["value_n"]
    want = x.fillna(-1.0).rolling(7, min_periods=1).max()
    assert list(got["value_n~top_7"]) == [int(v) for v in want] and len(got) == len(x)
    filled = infer_like(spark, [ApplyArrays(lambda v: 1 / (v - v), fillna=True)], df, ("value_n",))
    assert (filled["value_n"] == 0).all()


def test_under_later_windows(spark, monkeypatch):
    df = events_series(spark, DATA)
    pipeline = [RollingArrays(lambda w: w.sum(axis=1), 5, "value", "sum", keep_original=False), AddLagsX(("all", 3))]
    whole = engine.train_backtest(pipeline, df, EXPANDING, ("value",)).orderBy("split_id", "rid").toPandas()
    monkeypatch.setattr(rows, "BLOCK_ROWS", 32)
    small = engine.train_backtest(pipeline, df, EXPANDING, ("value",)).orderBy("split_id", "rid").toPandas()
    np.testing.assert_allclose(small["value~sum_5~lag_3"], whole["value~sum_5~lag_3"], equal_nan=True)


def test_named_outputs_and_shapes(spark):
    df = events_series(spark, DATA)
    got = infer_like(spark, [ApplyArrays(lambda v: np.column_stack([v.sum(axis=1), v[:, 0] * v[:, 1]]), outputs=("both", "product"))], df, ("value", "cls"))
    assert np.allclose(got["both"], got["value"] + got["cls"]) and np.allclose(got["product"], got["value"] * got["cls"])
    with pytest.raises(ValueError):
        ApplyArrays(lambda v: v, outputs=("a",), batch_columns=1)
    with pytest.raises(Exception, match="columns for"):
        infer_like(spark, [ApplyArrays(lambda v: v, outputs=("a",))], df, ("value", "cls"))
