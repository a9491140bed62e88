"""Lags and rolling means over a stream, with as many rows of state a key as the features reach back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_features(stream: DataFrame, key: str, ts: str, value: str, lags: list[int], window: int) -> DataFrame:
    """(key, ts, value, lag_n..., rolling_mean) for each row as it comes, rows of a batch in the order of ts.

    A key's state is its last values, at most the greatest lag or window.
    """
    reach = max([window - 1, *lags])
    names = [f"lag_{n}" for n in lags]
    kind = dict(stream.dtypes)
    out = f"{key} {kind[key]}, {ts} {kind[ts]}, {value} double, " + ", ".join(f"{n} double" for n in names) + ", rolling_mean double"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        before = list(state.get[0]) if state.exists else []
        series = pd.Series([*before, *rows[value].astype(float)])
        made = {key: rows[key].to_numpy(), ts: rows[ts].to_numpy(), value: rows[value].to_numpy(float)}
        made |= {f"lag_{n}": series.shift(n).to_numpy()[len(before) :] for n in lags}
        made["rolling_mean"] = series.rolling(window, min_periods=1).mean().to_numpy()[len(before) :]
        state.update((series.tolist()[-reach:] if reach else [],))
        yield pd.DataFrame(made)

    return stream.groupBy(key).applyInPandasWithState(update, out, "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def tumbling_scores(predictions: DataFrame, ts: str, every: str, late: str) -> DataFrame:
    """Errors (columns p, y) by windows of time, dropping rows later than the watermark."""
    from pyspark.sql import functions as F

    e = F.col("p") - F.col("y")
    return predictions.withWatermark(ts, late).groupBy(F.window(ts, every)).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
