"""The driver's queries and, for each that SQL can express, the SQL that checks it.

Series: S_e is events in the order of (ts, event_id) with feature value and the
next value as y; S_d is daily revenue from orders. Unless a query says
otherwise, windows expand from 0.4 of the rows in steps of 0.1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rows as rows_of
from .functions import scalar
from .functions.names import c
from .operators import arrays as arr
from .operators import columns as col_ops
from .operators import composites as comp
from .operators import events as ev
from .operators import features as feat
from .operators import models as mod
from .operators import scaling as sc
from .operators.trees import BoostedTrees
from .plans import engine, panel
from .plans import splits as sp
from .plans import tuning
from .sources import calendars
from .sources import series as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EXPANDING = sp.ExpandingWindowSplitter(0.4, 0.1)
SLIDING = sp.SlidingWindowSplitter(0.3, 0.1)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events_series(spark: SparkSession, d: str) -> DataFrame:
    """S_e: rid, ts, value, value2 (value - 50), const, cls (a purchase), value_n (null from rid 70 to 99), y."""
    df = src.clean(_table(spark, d, "events")).select("event_id", "ts", "value", (F.col("event_type") == "purchase").cast("double").alias("cls"))
    df = src.with_target(src.with_rid(df, ["ts", "event_id"]), "value").drop("event_id")
    return df.withColumns({"value2": F.col("value") - 50, "const": F.lit(1.0), "value_n": F.when(~F.col("rid").between(70, 99), F.col("value"))})


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """S_d: rid, ts (the day), rev, y."""
    daily = _table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("rev"))
    return src.with_target(src.with_rid(daily, ["day"]), "rev").withColumn("ts", F.col("day").cast("timestamp_ntz"))


E = """s0 AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS rid, ts, value, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0 END AS cls FROM events),
s1 AS (SELECT *, lead(value) OVER (ORDER BY rid) AS y, value - 50 AS value2, 1.0::DOUBLE AS const, CASE WHEN rid BETWEEN 70 AND 99 THEN NULL ELSE value END AS value_n FROM s0),
b AS (SELECT * FROM s1 WHERE y IS NOT NULL)"""
D = """d0 AS (SELECT CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS rev FROM orders GROUP BY 1),
d1 AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS rid, * FROM d0), b AS (SELECT * FROM (SELECT *, lead(rev) OVER (ORDER BY rid) AS y FROM d1) WHERE y IS NOT NULL)"""


def splits_sql(window: float, step: float, sliding: bool = False, gap: int = 0, initial: float | None = None) -> str:
    first = window if initial is None else initial
    return f"""cfg AS (SELECT n, CAST(floor({window}::DOUBLE * n) AS BIGINT) AS w, CAST(floor({first}::DOUBLE * n) AS BIGINT) AS f, CAST(floor({step}::DOUBLE * n) AS BIGINT) AS s, CAST(floor(0.1::DOUBLE * n) AS BIGINT) AS m FROM (SELECT count(*) AS n FROM b)),
raw AS (SELECT k AS split_id, {"greatest(f + k * s - w, 0)" if sliding else "0::BIGINT"} AS tr0, f + k * s - {gap} AS tr1, f + k * s AS te0, least(n, f + (k + 1) * s) AS te1, n, m FROM cfg, (SELECT unnest(range(0, 200)) AS k) WHERE f + k * s < n),
lastk AS (SELECT max(split_id) AS kk, max_by(te1 - te0, split_id) AS len FROM raw),
splits AS (SELECT split_id, tr0, tr1, te0, CASE WHEN kk > 0 AND len <= m AND split_id = kk - 1 THEN n ELSE te1 END AS te1 FROM raw, lastk WHERE NOT (kk > 0 AND len <= m AND split_id = kk))"""


SPLITS = splits_sql(0.4, 0.1)


def _rounded(df: DataFrame, columns: dict, digits: int | None):
    kinds = dict(df.select(*[x.alias(k) for k, x in columns.items()]).dtypes)
    return [(x if digits is None else scalar.rounded(x, digits) if kinds[k] == "double" else F.round(x, digits)).alias(k) for k, x in columns.items()]


def feature(name: str, pipeline, outputs: dict[str, str], exprs: dict[str, str], memory: int = 0, digits: int | None = 6, series=events_series, base: str = E, features=("value", "value2", "const"), splitter=EXPANDING, splits: str = SPLITS, extra: str = "", joins: str = "", cast: str | None = None) -> None:
    """Registers a query of a pipeline's columns on test rows, and its SQL. exprs may use window w, te0 and the tables in joins."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        steps = pipeline(spark, d) if callable(pipeline) else pipeline
        df = engine.train_backtest(steps, series(spark, d), splitter, features)
        value = lambda k: c(k).cast(cast) if cast else c(k)
        return df.select("split_id", "rid", *_rounded(df, {v: value(k) for k, v in outputs.items()}, digits))

    QUERIES[name] = query
    # adding 0 turns -0.0 into 0.0
    out = ", ".join(f"round({k}, {digits}) + 0::DOUBLE AS {k}" if digits is not None else f"CAST({k} AS BIGINT) AS {k}" if cast else k for k in exprs)
    made = ", ".join(f"{x} AS {k}" for k, x in exprs.items())
    ORACLE_SQL[name] = f"""WITH {base}, {splits}{extra}, t AS (SELECT s.split_id, s.te0, b.* FROM b JOIN splits s ON b.rid >= greatest(s.te0 - {memory}, 0) AND b.rid < s.te1),
r AS (SELECT t.split_id, t.rid, t.te0, {made} FROM t {joins} WINDOW w AS (PARTITION BY t.split_id ORDER BY t.rid))
SELECT split_id, rid, {out} FROM r WHERE rid >= te0"""


TRAIN = ", train AS (SELECT s.split_id, b.* FROM b JOIN splits s ON b.rid >= s.tr0 AND b.rid < s.tr1)"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


# --- sources


def _hourly(spark, d):
    return _table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_id", "value")


for _keep, _order in (("first", "ASC"), ("last", "DESC")):
    query(f"dedupe_{_keep}", f"""SELECT CAST(hour AS VARCHAR) AS hour, event_id, value FROM (SELECT date_trunc('hour', ts) AS hour, event_id, value, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id {_order}) AS k FROM events) WHERE k = 1""")(
        lambda spark, d, keep=_keep: src.deduplicate(_hourly(spark, d), "hour", "event_id", keep).select(F.col("hour").cast("string").alias("hour"), "event_id", "value")
    )


@query("resample_last_grid", """WITH g AS (SELECT unnest(generate_series((SELECT time_bucket(INTERVAL '10 minutes', min(ts)) FROM events), (SELECT time_bucket(INTERVAL '10 minutes', max(ts)) FROM events), INTERVAL '10 minutes')) AS ts),
v AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS bucket, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1) SELECT CAST(g.ts AS VARCHAR) AS ts, v.value FROM g LEFT JOIN v ON g.ts = v.bucket""")
def resample_last_grid(spark, d):
    df = _table(spark, d, "events").select("ts", "event_id", "value")
    return src.resample_last(df, "ts", "event_id", "10 minutes").select(F.col("ts").cast("string").alias("ts"), "value")


@query("make_target_lead", f"WITH {E} SELECT rid, value, y FROM b")
def make_target_lead(spark, d):
    return events_series(spark, d).select("rid", "value", "y")


@query("shorten_head", f"WITH {E} SELECT rid, value FROM b WHERE rid <= 100")
def shorten_head(spark, d):
    return src.shorten(events_series(spark, d), 100).select("rid", "value")


# --- splits


def _splits(name, splitter, gap=0, sql=None, series=events_series, base=E):
    @query(name, f"WITH {base}, {sql} SELECT split_id, tr0 AS tr_start, tr1 AS tr_end, te0 AS te_start, te1 AS te_end FROM splits" if sql else None)
    def run(spark, d):
        n = series(spark, d).count()
        return sp.splits_table(spark, sp.plan_splits(splitter, n, gap_before=gap))


_splits("splits_expanding", EXPANDING, sql=SPLITS)
_splits("splits_sliding", SLIDING, sql=splits_sql(0.3, 0.1, True))
_splits("splits_sliding_initial_window", sp.SlidingWindowSplitter(0.3, 0.1, initial_window=0.5), sql=splits_sql(0.3, 0.1, True, initial=0.5))
_splits("splits_gap_before", EXPANDING, 25, splits_sql(0.4, 0.1, gap=25))
_splits("splits_merge_last", sp.ExpandingWindowSplitter(0.45, 0.15), sql=splits_sql(0.45, 0.15))
_splits("splits_forward_single", sp.ForwardSingleWindowSplitter(0.6), sql="splits AS (SELECT 0::BIGINT AS split_id, 0::BIGINT AS tr0, CAST(floor(0.6::DOUBLE * count(*)) AS BIGINT) AS tr1, CAST(floor(0.6::DOUBLE * count(*)) AS BIGINT) AS te0, count(*) AS te1 FROM b)")
_splits("splits_whole", sp.WholeWindowSplitter(0.2), sql="splits AS (SELECT 0::BIGINT AS split_id, 0::BIGINT AS tr0, count(*) AS tr1, count(*) - CAST(floor(0.2::DOUBLE * count(*)) AS BIGINT) AS te0, count(*) AS te1 FROM b)")
_splits("splits_combined", sp.CombinedSplitter((sp.ForwardSingleWindowSplitter(0.6),), sp.ForwardSingleWindowSplitter(0.8)), sql="splits AS (SELECT k AS split_id, 0::BIGINT AS tr0, CAST(floor(f * n) AS BIGINT) AS tr1, CAST(floor(f * n) AS BIGINT) AS te0, n AS te1 FROM (VALUES (0::BIGINT, 0.6::DOUBLE), (1::BIGINT, 0.8::DOUBLE)) v(k, f), (SELECT count(*) AS n FROM b))")


@query("split_row_counts", f"""WITH {E}, {SPLITS} SELECT s.split_id, count(*) FILTER (b.rid >= s.tr0 AND b.rid < s.tr1) AS train_rows, count(*) FILTER (b.rid >= s.te0 AND b.rid < s.te1) AS test_rows FROM b, splits s GROUP BY 1""")
def split_row_counts(spark, d):
    df = events_series(spark, d)
    splits = sp.plan_splits(EXPANDING, df.count())
    counted = lambda x, name: x.groupBy("split_id").agg(F.count("*").alias(name))
    return counted(sp.tag_train_rows(df, splits), "train_rows").join(counted(sp.tag_test_rows(df, splits), "test_rows"), "split_id")


# --- columns

feature("select_pattern", [col_ops.SelectColumns(["value*"])], {"value": "value", "value2": "value2"}, {"value": "value", "value2": "value2"})
feature("drop_columns", [col_ops.DropColumns(["*2", "missing"])], {"value": "value", "const": "const"}, {"value": "value", "const": "const"})
feature("rename_columns", [col_ops.RenameColumns({"value": "renamed", "missing": "x"})], {"renamed": "renamed"}, {"renamed": "value"})
feature("add_suffix", [col_ops.AddColumnSuffix("_s")], {"value_s": "value_s", "const_s": "const_s"}, {"value_s": "value", "const_s": "const"})

# --- windows

feature("lags", [feat.AddLagsX([("value", [1, 2, 5]), ("value2", range(3, 4))])], {"value~lag_1": "lag_1", "value~lag_2": "lag_2", "value~lag_5": "lag_5", "value2~lag_3": "lag2_3"}, {"lag_1": "lag(value, 1) OVER w", "lag_2": "lag(value, 2) OVER w", "lag_5": "lag(value, 5) OVER w", "lag2_3": "lag(value2, 3) OVER w"}, 5)
_FRAME = "OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
for _fn, _sql in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "median": "median", "skew": "skewness", "kurt": "kurtosis"}.items():
    feature(f"rolling_{_fn}", [feat.AddWindowFeatures(("value", 10, _fn))], {f"value~{_fn}_10": "r"}, {"r": f"{_sql}(value) {_FRAME}"}, 10, 6 if _fn == "var" else 4)
feature("rolling_sem", [feat.AddWindowFeatures(("value", 10, "sem"))], {"value~sem_10": "r"}, {"r": f"CASE WHEN count(value) {_FRAME} > 1 THEN stddev_samp(value) {_FRAME} / sqrt(count(value) {_FRAME} - 1) END"}, 10, 4)


def _cov(spark, d):
    from .functions.windows import covariance

    def run(frame):
        return frame.add({"cov": covariance(c("value"), F.col("y"), frame.window.rowsBetween(-9, 0))})

    from .plans.blocks import Project

    return [Project(run, 10)]


feature("rolling_cov", _cov, {"cov": "r"}, {"r": f"covar_samp(value, y) {_FRAME}"}, 10, 6)
# times the number of rows: a mean of many may lie on a tie of rounding
feature("expanding_mean", [feat.AddWindowFeatures([("value", None, "mean"), ("const", None, "sum")]), feat.ApplyFunction(lambda df: df.withColumn("r", F.col("`value~mean_expanding`") * F.col("`const~sum_expanding`")))], {"r": "r"}, {"r": "sum(value) OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, digits=4)
_ALL = "OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_SO_FAR = {"std": "stddev_samp", "var": "var_samp", "skew": "skewness", "kurt": "kurtosis"}
feature("expanding_moments", [feat.AddWindowFeatures([("value", None, fn) for fn in (*_SO_FAR, "sem")])], {f"value~{fn}_expanding": fn for fn in (*_SO_FAR, "sem")}, {fn: f"{sql}(value) {_ALL}" for fn, sql in _SO_FAR.items()} | {"sem": f"CASE WHEN count(value) {_ALL} > 1 THEN stddev_samp(value) {_ALL} / sqrt(count(value) {_ALL} - 1) END"}, digits=6)
feature("expanding_corr", [feat.AddRollingCorrelation([("value", "cls"), ("value", "const"), ("value_n", "value2")], None)], {"value_cls~corr_expanding": "r", "value_const~corr_expanding": "none", "value_n_value2~corr_expanding": "one"}, {"r": f"CASE WHEN stddev_pop(value) {_ALL} > 0 AND stddev_pop(cls) {_ALL} > 0 THEN corr(value, cls) {_ALL} END", "none": "NULL::DOUBLE", "one": f"CASE WHEN stddev_pop(value_n) {_ALL} > 0 THEN 1.0 END"}, features=("value", "cls", "const", "value_n", "value2"))


def _weighed(values):
    """Half of each row, 0.3 of the row before and 0.2 of the one before that."""
    out = 0.5 * values
    out[1:] += 0.3 * values[:-1]
    out[2:] += 0.2 * values[:-2]
    return out


def _trimmed_sum(windows):
    """The sum without the least and the greatest."""
    return np.sort(windows, axis=1)[:, 1:-1].sum(axis=1)


feature("arrays_of_blocks", [arr.ApplyArrays(_weighed, 2, batch_columns=1)], {"value": "a", "cls": "b"}, {"a": "0.5 * value + 0.3 * lag(value, 1) OVER w + 0.2 * lag(value, 2) OVER w", "b": "0.5 * cls + 0.3 * lag(cls, 1) OVER w + 0.2 * lag(cls, 2) OVER w"}, 2, 4, features=("value", "cls"))
_TEN = "list_sort(list(value) OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"
feature("arrays_of_windows", [arr.RollingArrays(_trimmed_sum, 10, "value", "trimmed")], {"value~trimmed_10": "r"}, {"r": f"list_sum({_TEN}[2:9])"}, 10, 4)
# windows of more rows than a piece, for the query 64 rows, at any size of the table
_LAST = "OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
feature("wide_windows", [feat.AddWindowFeatures([("value", 300, "sum"), ("value", 300, "max"), ("value_n", 200, "min"), ("value", 129, "std")], wide=64)], {"value~sum_300": "total", "value~max_300": "hi", "value_n~min_200": "lo", "value~std_129": "sd"}, {"total": f"sum(value) {_LAST.format(299)}", "hi": f"max(value) {_LAST.format(299)}", "lo": f"min(value_n) {_LAST.format(199)}", "sd": f"stddev_samp(value) {_LAST.format(128)}"}, 300, 4, features=("value", "value_n"))
feature("lags_of_expanding", [feat.AddWindowFeatures(("value", None, "max"), keep_original=False), feat.AddLagsX(("all", [2, 7]), keep_original=False)], {"value~max_expanding~lag_2": "two", "value~max_expanding~lag_7": "seven"}, {"two": "lag(m, 2) OVER w", "seven": "lag(m, 7) OVER w"}, 7, extra=", b2 AS (SELECT s.split_id, b.rid, max(b.value) OVER (PARTITION BY s.split_id ORDER BY b.rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM b JOIN splits s ON b.rid >= greatest(s.te0 - 7, 0) AND b.rid < s.te1)", joins="JOIN b2 ON t.split_id = b2.split_id AND t.rid = b2.rid", features=("value",))
feature("windows_chained", [feat.AddWindowFeatures(("value", 5, "mean"), keep_original=False), feat.AddLagsX(("all", 2), keep_original=False)], {"value~mean_5~lag_2": "r"}, {"r": "lag(m, 2) OVER w"}, 5, extra=", b2 AS (SELECT s.split_id, b.rid, avg(b.value) OVER (PARTITION BY s.split_id ORDER BY b.rid ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM b JOIN splits s ON b.rid >= greatest(s.te0 - 5, 0) AND b.rid < s.te1)", joins="JOIN b2 ON t.split_id = b2.split_id AND t.rid = b2.rid")
feature("rolling_corr", [feat.AddRollingCorrelation(("value", "cls"), 20)], {"value_cls~rolling_corr_20": "r"}, {"r": "CASE WHEN stddev_pop(value) OVER f > 0 AND stddev_pop(cls) OVER f > 0 THEN corr(value, cls) OVER f END".replace("OVER f", "OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")}, 20, 4, features=("value", "cls"))
_B = "lag(value, 1) OVER w"
feature("difference", [feat.Difference("diff")], {"value": "r"}, {"r": f"value - {_B}"})
# SQL tells 0 / 0 (NaN) from no row before (null)
feature("returns", [feat.Difference("returns", undefined=float("nan"))], {"value": "r"}, {"r": f"value / {_B} - 1"})
feature("log_returns", [feat.Difference("log_returns", undefined=float("nan"))], {"value": "r"}, {"r": f"ln(value / {_B})"}, features=("value",))
feature("capped_returns", [feat.Difference("capped_returns")], {"value2": "r"}, {"r": "CASE WHEN lag(value2, 1) OVER w > -1 AND lag(value2, 1) OVER w < 1 THEN value2 - lag(value2, 1) OVER w ELSE value2 / lag(value2, 1) OVER w - 1 END"})
feature("clip", [feat.Difference("diff", clip_threshold=20, rows_of_memory=1)], {"value": "r"}, {"r": "greatest(least(value - lag(value, 1) OVER w, 20), -20)"}, 1, features=("value",))
feature("clip_and_ffill", [feat.Difference("diff", clip_threshold=20, fill_0_with_last=True, rows_of_memory=1)], {"cls": "r"}, {"r": "last_value(CASE WHEN cd = 0 THEN NULL ELSE cd END IGNORE NULLS) OVER w"}, 1, features=("cls",), extra=", b2 AS (SELECT s.split_id, b.rid, cls - lag(cls, 1) OVER (PARTITION BY s.split_id ORDER BY b.rid) AS cd FROM b JOIN splits s ON b.rid >= greatest(s.te0 - 1, 0) AND b.rid < s.te1)", joins="JOIN b2 ON t.split_id = b2.split_id AND t.rid = b2.rid")

# --- scalars

feature("datetime_features", [feat.AddDateTimeFeatures(tuple(scalar.DATE_PARTS), keep_original=False)], {f"datetime~{p}": p for p in scalar.DATE_PARTS}, {"second": "CAST(second(ts) AS BIGINT)", "minute": "minute(ts)", "hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "day_of_month": "day(ts)", "day_of_year": "dayofyear(ts)", "week": "week(ts)", "week_of_year": "week(ts)", "month": "month(ts)", "quarter": "quarter(ts)", "year": "year(ts)"}, digits=None, cast="long")
feature("take_log", [feat.TakeLog("10")], {"value": "r", "value2": "r2"}, {"r": "log10(value)", "r2": "CASE WHEN value2 > 0 THEN log10(value2) WHEN value2 = 0 THEN '-infinity'::DOUBLE END"})
feature("multiply_by", [feat.MultiplyBy(2.5)], {"value": "r"}, {"r": "value * 2.5"})
feature("add_features", [feat.AddFeatures(("value*", F.sqrt))], {"value~sqrt": "r"}, {"r": "sqrt(value)"}, features=("value",))
_ODD = "CASE WHEN rid % 5 = 0 THEN 'infinity'::DOUBLE WHEN rid % 5 = 1 THEN '-infinity'::DOUBLE WHEN rid % 5 = 2 THEN 'nan'::DOUBLE ELSE value_n END"


def _odd(df):
    odd = [F.lit(float(x)) for x in ("inf", "-inf", "nan")]
    made = reduce(lambda a, i: a.when(F.col("rid") % 5 == i, odd[i]), (1, 2), F.when(F.col("rid") % 5 == 0, odd[0]))
    return df.withColumn("value_n", scalar.fill_na_inf(made.otherwise(F.col("value_n"))))


feature("fill_na_inf", [feat.ApplyFunction(_odd)], {"value_n": "r"}, {"r": f"CASE WHEN {_ODD} IS NULL OR isnan({_ODD}) OR isinf({_ODD}) THEN 0.0 ELSE {_ODD} END"}, features=("value_n",), splitter=sp.ForwardSingleWindowSplitter(50), splits="splits AS (SELECT 0::BIGINT AS split_id, 0::BIGINT AS tr0, 50::BIGINT AS tr1, 50::BIGINT AS te0, count(*) AS te1 FROM b)")


def _holidays(labeling, *codes):
    return lambda spark, d: [feat.AddHolidayFeatures(calendars.holidays(spark, codes, range(1995, 2003)), codes, labeling, keep_original=False)]


# the same days by month, weekday and day; dates of Easter are stated
_MD, _DOW = "(month(ts), day(ts))", "isodow(ts)"
_US_NAMES = {
    "Christmas Day": f"{_MD} = (12, 25)", "Independence Day": f"{_MD} = (7, 4)", "New Year's Day": f"{_MD} = (1, 1)", "Veterans Day": f"{_MD} = (11, 11)",
    "Martin Luther King Jr. Day": f"month(ts) = 1 AND {_DOW} = 1 AND day(ts) BETWEEN 15 AND 21", "Washington's Birthday": f"month(ts) = 2 AND {_DOW} = 1 AND day(ts) BETWEEN 15 AND 21",
    "Memorial Day": f"month(ts) = 5 AND {_DOW} = 1 AND day(ts) > 24", "Labor Day": f"month(ts) = 9 AND {_DOW} = 1 AND day(ts) < 8",
    "Columbus Day": f"month(ts) = 10 AND {_DOW} = 1 AND day(ts) BETWEEN 8 AND 14", "Thanksgiving Day": f"month(ts) = 11 AND {_DOW} = 4 AND day(ts) BETWEEN 22 AND 28",
    "Christmas Day (observed)": f"({_DOW} = 5 AND {_MD} = (12, 24) OR {_DOW} = 1 AND {_MD} = (12, 26))", "Independence Day (observed)": f"({_DOW} = 5 AND {_MD} = (7, 3) OR {_DOW} = 1 AND {_MD} = (7, 5))",
    "New Year's Day (observed)": f"({_DOW} = 5 AND {_MD} = (12, 31) OR {_DOW} = 1 AND {_MD} = (1, 2))", "Veterans Day (observed)": f"({_DOW} = 5 AND {_MD} = (11, 10) OR {_DOW} = 1 AND {_MD} = (11, 12))",
}
_US = "(" + " OR ".join(_US_NAMES.values()) + ")"
_WEEKEND = f"CASE WHEN {_DOW} > 5 THEN 1 ELSE 0 END"
_EASTER = "(" + ", ".join(f"DATE '{d}'" for d in ("1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23", "2001-04-15", "2002-03-31")) + ")"
_AFTER = lambda *days: " OR ".join(f"CAST(ts AS DATE) - {n} IN {_EASTER}" for n in days)
_DE = f"({_MD} IN ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26)) OR {_AFTER(-2, 1, 39, 50)})"
_MOVED = ", ".join(f"DATE '{d}'" for d in ("1995-01-02", "1995-05-08", "1998-12-28", "1999-12-27", "1999-12-28", "1999-12-31", "2000-01-03", "2002-06-03", "2002-06-04"))
_GB = f"({_MD} IN ((1, 1), (12, 25), (12, 26)) OR {_AFTER(-2, 1)} OR CAST(ts AS DATE) IN ({_MOVED}) OR {_DOW} = 1 AND (month(ts) = 5 AND day(ts) < 8 AND year(ts) <> 1995 OR month(ts) = 5 AND day(ts) > 24 AND year(ts) <> 2002 OR month(ts) = 8 AND day(ts) > 24))"
_CLOSED = f"""({_DOW} > 5 OR {_AFTER(-2)} OR ts BETWEEN '2001-09-11' AND '2001-09-14' OR {" OR ".join(x for k, x in _US_NAMES.items() if k not in ("Columbus Day", "Veterans Day", "Veterans Day (observed)", "New Year's Day (observed)", "Martin Luther King Jr. Day"))} OR {_DOW} = 1 AND {_MD} = (1, 2) OR year(ts) > 1997 AND {_US_NAMES["Martin Luther King Jr. Day"]})"""
_DAILY = {"series": daily_series, "base": D, "features": ("rev",)}
_NUMBER = "CASE " + " ".join(f"WHEN {_US_NAMES[k]} THEN {i}" for i, k in enumerate(sorted(_US_NAMES), 2)) + f" ELSE {_WEEKEND} END"
_NAME = "CASE " + " ".join(f"""WHEN {x} THEN '{k.replace("'", "''")}'""" for k, x in _US_NAMES.items()) + f" ELSE CAST({_WEEKEND} AS VARCHAR) END"
feature("holiday_binary", _holidays("binary", "US"), {"holiday_US": "r"}, {"r": f"CASE WHEN {_US} THEN 1 ELSE 0 END"}, digits=None, cast="long", **_DAILY)
feature("holiday_weekend", _holidays("weekday_weekend_holiday", "US"), {"holiday_US": "r"}, {"r": f"CASE WHEN {_US} THEN 2 ELSE {_WEEKEND} END"}, digits=None, cast="long", **_DAILY)
feature("holiday_de_gb", _holidays("weekday_weekend_holiday", "DE", "GB"), {"holiday_DE": "de", "holiday_GB": "gb"}, {"de": f"CASE WHEN {_DE} THEN 2 ELSE {_WEEKEND} END", "gb": f"CASE WHEN {_GB} THEN 2 ELSE {_WEEKEND} END"}, digits=None, cast="long", **_DAILY)
feature("holiday_unique", _holidays("unique", "US"), {"holiday_US": "r"}, {"r": _NUMBER}, digits=None, cast="long", **_DAILY)
feature("holiday_string", _holidays("string", "US"), {"holiday_US": "r"}, {"r": _NAME}, digits=None, **_DAILY)
feature("exchange_holidays", lambda spark, d: [feat.AddHolidayFeatures(calendars.closed_days(spark, "NYSE", range(1995, 2003)), ("NYSE",), "binary", keep_original=False)], {"holiday_NYSE": "r"}, {"r": f"CASE WHEN {_CLOSED} THEN 1 ELSE 0 END"}, digits=None, cast="long", **_DAILY)
_SESSIONS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem"
feature("exchange_sessions_table", lambda spark, d: [feat.AddHolidayFeatures(calendars.without_session(_table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")), "X", "1995-01-01", "2002-01-01"), ("X",), "binary", keep_original=False)], {"holiday_X": "r"}, {"r": "CASE WHEN CAST(ts AS DATE) IN (SELECT day FROM sessions) THEN 0 ELSE 1 END"}, digits=None, cast="long", extra=f", sessions AS ({_SESSIONS})", **_DAILY)


@query("weekend_flag", f"WITH {D} SELECT rid, CAST(isodow(ts) > 5 AS BIGINT) AS weekend FROM b")
def weekend_flag(spark, d):
    return daily_series(spark, d).select("rid", scalar.weekend(F.col("ts")).cast("long").alias("weekend"))


# --- fitted

_STATE = "JOIN st ON t.split_id = st.split_id"
feature("standard_scaler", [sc.StandardScaler()], {"value": "r", "const": "k"}, {"r": "(value - m) / d", "k": "const - 1"}, extra=TRAIN + ", st AS (SELECT split_id, avg(value) AS m, stddev_pop(value) AS d FROM train GROUP BY 1)", joins=_STATE)
feature("minmax_scaler", [sc.MinMaxScaler((0, 2), clip=True)], {"value": "r", "const": "k"}, {"r": "greatest(least((value - lo) / (hi - lo) * 2, 2), 0)", "k": "0.0"}, extra=TRAIN + ", st AS (SELECT split_id, min(value) AS lo, max(value) AS hi FROM train GROUP BY 1)", joins=_STATE)
feature("turn_positive", [sc.TurnPositive()], {"value": "r", "value2": "r2"}, {"r": "value + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END", "r2": "value2 + CASE WHEN lo2 <= 0 THEN abs(lo2) + 1 ELSE 0 END"}, extra=TRAIN + ", st AS (SELECT split_id, min(value) AS lo, min(value2) AS lo2 FROM train GROUP BY 1)", joins=_STATE)


@query("low_variance", f"WITH {E}, {SPLITS} {TRAIN} SELECT split_id, CASE WHEN var_pop(value) > 1e-5 THEN 1 ELSE 0 END + CASE WHEN var_pop(value2) > 1e-5 THEN 1 ELSE 0 END + CASE WHEN var_pop(const) > 1e-5 THEN 1 ELSE 0 END AS kept, CAST(var_pop(const) > 1e-5 AS BIGINT) AS const_kept FROM train GROUP BY 1")
def low_variance(spark, d):
    trained = engine.train([sc.RemoveLowVariance()], events_series(spark, d), EXPANDING, ("value", "value2", "const"))
    state = trained.run.states["main/0"]
    return state.select("split_id", F.size("selected").alias("kept"), F.array_contains("selected", "const").cast("long").alias("const_kept"))


@query("select_k_best_corr", f"WITH {E}, {SPLITS} {TRAIN} SELECT split_id, CASE WHEN coalesce(power(corr(value, y), 2), -1) >= coalesce(power(corr(cls, y), 2), -1) THEN 'value' ELSE 'cls' END AS best FROM train GROUP BY 1")
def select_k_best_corr(spark, d):
    trained = engine.train([sc.SelectKBest(1)], events_series(spark, d), EXPANDING, ("value", "cls"))
    return trained.run.states["main/0"].select("split_id", F.col("selected")[0].alias("best"))


# --- events


def _with_events(spark, d, labeler, event_filter=None):
    df = events_series(spark, d)
    return ev.create_events(df.select("rid", "ts", "y", "value"), df.count(), labeler, event_filter)


@query("every_nth", f"WITH {E} SELECT rid, y FROM b WHERE rid % 7 = 0")
def every_nth(spark, d):
    return events_series(spark, d).where(ev.EveryNth(7).keep()).select("rid", "y")


@query("filter_zero", f"WITH {E} SELECT rid, cls FROM b WHERE cls <> 0")
def filter_zero(spark, d):
    return events_series(spark, d).withColumn("y", F.col("cls")).where(ev.FilterZero().keep()).select("rid", "cls")


for _fn, _sql in {"sum": "sum", "mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}.items():
    query(f"forward_{_fn}_label", f"WITH {E}, f AS (SELECT rid, {_sql}(y) OVER (ORDER BY rid ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS label, y AS raw FROM b) SELECT rid, round(label, 6) AS label, round(raw, 6) AS raw FROM f WHERE rid < (SELECT count(*) FROM b) - 5")(
        lambda spark, d, fn=_fn: _with_events(spark, d, ev.FixedForwardHorizon(5, aggregate_function=fn)).where("event_label IS NOT NULL").select("rid", F.round("event_label", 6).alias("label"), F.round("event_raw", 6).alias("raw"))
    )


@query("forward_end_times", f"WITH {E}, f AS (SELECT rid, coalesce(lead(ts, 5) OVER (ORDER BY rid), (SELECT max_by(ts, rid) FROM b)) AS e FROM b) SELECT rid, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', e)) AS BIGINT) AS event_end FROM f WHERE rid < (SELECT count(*) FROM b) - 5")
def forward_end_times(spark, d):
    df = _with_events(spark, d, ev.FixedForwardHorizon(5)).where("event_label IS NOT NULL")
    return df.select("rid", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', date_trunc('second', event_end)::timestamp_ntz)").alias("event_end"))


_FORWARD = "fw AS (SELECT *, CASE WHEN rid < (SELECT count(*) FROM b) - 3 THEN avg(y - 50) OVER (ORDER BY rid ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) END AS f FROM b)"


def _forward(**options):
    return ev.FixedForwardHorizon(3, transformation_function=lambda y: y - 50, aggregate_function="mean", **options)


@query("binarize_sign", f"WITH {E}, {_FORWARD} SELECT rid, CASE WHEN f >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM fw WHERE f IS NOT NULL")
def binarize_sign(spark, d):
    return _with_events(spark, d, _forward(labeling_strategy=ev.binarize_sign)).where("event_label IS NOT NULL").select("rid", F.col("event_label").alias("label"))


@query("flip_sign", f"WITH {E}, {_FORWARD} SELECT rid, CASE WHEN f >= 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM fw WHERE f IS NOT NULL")
def flip_sign(spark, d):
    return _with_events(spark, d, _forward(labeling_strategy=ev.binarize_sign, flip_sign=True)).where("event_label IS NOT NULL").select("rid", F.col("event_label").alias("label"))


@query("weight_by_max", f"WITH {E}, {_FORWARD}, g AS (SELECT * FROM fw WHERE f IS NOT NULL) SELECT rid, round(abs(f) / max(abs(f)) OVER (ORDER BY rid ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS weight FROM g")
def weight_by_max(spark, d):
    return _with_events(spark, d, _forward(weighting_strategy=ev.WeightByMax(100))).where("event_label IS NOT NULL").select("rid", F.round("event_sample_weights", 6).alias("weight"))


@query("weight_by_max_fraction", f"WITH {E}, {_FORWARD}, g AS (SELECT *, (SELECT CAST(floor(0.2::DOUBLE * count(*)) AS BIGINT) FROM b) AS k FROM fw WHERE f IS NOT NULL) SELECT a.rid, round(abs(any_value(a.f)) / max(abs(z.f)), 6) AS weight FROM g a JOIN g z ON z.rid > a.rid - a.k AND z.rid <= a.rid GROUP BY 1")
def weight_by_max_fraction(spark, d):
    return _with_events(spark, d, _forward(weighting_strategy=ev.WeightByMax(0.2))).where("event_label IS NOT NULL").select("rid", F.round("event_sample_weights", 6).alias("weight"))


@query("weight_by_max_expanding", f"WITH {E}, {_FORWARD}, g AS (SELECT * FROM fw WHERE f IS NOT NULL) SELECT rid, round(abs(f) / max(abs(f)) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS weight FROM g")
def weight_by_max_expanding(spark, d):
    return _with_events(spark, d, _forward(weighting_strategy=ev.WeightByMax(None))).where("event_label IS NOT NULL").select("rid", F.round("event_sample_weights", 6).alias("weight"))


@query("weight_by_max_lookahead", f"WITH {E}, {_FORWARD} SELECT rid, round(abs(f) / (SELECT max(f) FROM fw), 6) AS weight FROM fw WHERE f IS NOT NULL")
def weight_by_max_lookahead(spark, d):
    return _with_events(spark, d, _forward()).where("event_label IS NOT NULL").select("rid", F.round("event_test_sample_weights", 6).alias("weight"))


@query("identity_labeler", f"WITH {E} SELECT rid, y AS label FROM b WHERE rid % 3 = 0")
def identity_labeler(spark, d):
    return _with_events(spark, d, ev.IdentityLabeler(), ev.EveryNth(3)).where("event_label IS NOT NULL").select("rid", F.col("event_label").alias("label"))


@query("event_lags", f"""WITH {E}, {SPLITS}, {_FORWARD}, g AS (SELECT * FROM fw WHERE f IS NOT NULL AND rid % 3 = 0),
t AS (SELECT s.split_id, s.te0, g.rid, lag(g.value, 1) OVER (PARTITION BY s.split_id ORDER BY g.rid) AS l FROM g JOIN splits s ON g.rid >= greatest(s.te0 - 6, 0) AND g.rid < s.te1),
a AS (SELECT s.split_id, b.rid FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1)
SELECT a.split_id, a.rid, round(t.l, 6) AS lag_1 FROM a LEFT JOIN t ON a.split_id = t.split_id AND a.rid = t.rid""")
def event_lags(spark, d):
    card = engine.PipelineCard([feat.AddLagsX(("value", [1, 6]), keep_original=False)], labeler=_forward(), event_filter=ev.EveryNth(3))
    return engine.train_backtest(card, events_series(spark, d), EXPANDING, ("value",)).select("split_id", "rid", F.round("`value~lag_1`", 6).alias("lag_1"))


# --- models and composites



def model(name, pipeline, outputs, exprs, extra="", joins="", **options):
    feature(name, pipeline, outputs, exprs, extra=extra, joins=joins, **options)


model("dummy_regressor", [mod.DummyRegressor(3.5)], {"predictions_DummyRegressor": "p"}, {"p": "3.5::DOUBLE"})
model("dummy_classifier", [mod.DummyClassifier(1, (0, 1), (0.3, 0.7))], {"predictions_DummyClassifier": "p", "probabilities_DummyClassifier_0": "p0", "probabilities_DummyClassifier_1": "p1"}, {"p": "1.0::DOUBLE", "p0": "0.3::DOUBLE", "p1": "0.7::DOUBLE"})
_FIT = TRAIN + ", st AS (SELECT split_id, regr_slope(y, value) AS m, regr_intercept(y, value) AS c FROM train GROUP BY 1)"
model("ols_expanding", [mod.LinearRegression()], {"predictions_LinearRegression": "p"}, {"p": "m * value + c"}, _FIT, _STATE, digits=4, features=("value",))
model("ols_sliding", [mod.LinearRegression()], {"predictions_LinearRegression": "p"}, {"p": "m * value + c"}, _FIT, _STATE, digits=4, features=("value",), splitter=SLIDING, splits=splits_sql(0.3, 0.1, True))
_TRAIN_LAG = TRAIN + ", tl AS (SELECT *, lag(rev, 1) OVER (PARTITION BY split_id ORDER BY rid) AS l FROM train), st AS (SELECT split_id, regr_slope(y, l) AS m, regr_intercept(y, l) AS c FROM tl WHERE l IS NOT NULL GROUP BY 1)"
_LAG_MODEL = [feat.AddLagsX(("rev", 1), keep_original=False), mod.LinearRegression()]
model("ols_on_lag", _LAG_MODEL, {"predictions_LinearRegression": "p"}, {"p": "m * lag(rev, 1) OVER w + c"}, _TRAIN_LAG, _STATE, memory=1, digits=1, series=daily_series, base=D, features=("rev",))


@query("ols_two_features", f"""WITH {E}, {SPLITS} {TRAIN}, q AS (SELECT split_id, var_pop(value) AS a, var_pop(cls) AS d, covar_pop(value, cls) AS o, covar_pop(value, y) AS u, covar_pop(cls, y) AS v, avg(value) AS mx, avg(cls) AS mc, avg(y) AS my FROM train GROUP BY 1),
st AS (SELECT split_id, (u * d - v * o) / (a * d - o * o) AS b1, (v * a - u * o) / (a * d - o * o) AS b2, mx, mc, my FROM q)
SELECT s.split_id, b.rid, round(my + b1 * (b.value - mx) + b2 * (b.cls - mc), 4) AS p FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN st ON s.split_id = st.split_id""")
def ols_two_features(spark, d):
    df = engine.train_backtest([mod.LinearRegression()], events_series(spark, d), EXPANDING, ("value", "cls"))
    return df.select("split_id", "rid", F.round("predictions_LinearRegression", 4).alias("p"))


_TESTED = f"WITH {E}, {SPLITS} SELECT s.split_id, b.rid, {{}} FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1"


@query("random_classifier", _TESTED.format("TRUE AS valid"))
def random_classifier(spark, d):
    """Random, so what is checked is that each row has one of the classes and probabilities that sum to 1."""
    df = engine.train_backtest([mod.RandomClassifier((0, 1))], events_series(spark, d), EXPANDING, ("value",))
    p = [F.col(f"probabilities_RandomClassifier_{k}") for k in (0, 1)]
    return df.select("split_id", "rid", (F.col("predictions_RandomClassifier").isin(0.0, 1.0) & p[0].between(0, 1) & (F.abs(p[0] + p[1] - 1) < 1e-9)).alias("valid"))


@query("random_binary_classifier", f"WITH {E}, {SPLITS} {TRAIN}, st AS (SELECT split_id, avg(CASE WHEN cls > 0 THEN 1.0 ELSE -1.0 END) / 2 + 0.5 AS center FROM train GROUP BY 1) SELECT s.split_id, count(*) AS n, round(any_value(st.center), 1) AS center, TRUE AS consistent FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN st ON s.split_id = st.split_id GROUP BY 1")
def random_binary_classifier(spark, d):
    """Random around a fitted center: the mean probability is near it, and the class follows the probability."""
    df = events_series(spark, d).withColumn("y", F.col("cls"))
    out = engine.train_backtest([mod.RandomBinaryClassifier()], df, EXPANDING, ("value",))
    one, zero = F.col("probabilities_RandomBinaryClassifier_1"), F.col("probabilities_RandomBinaryClassifier_0")
    consistent = F.bool_and((F.col("predictions_RandomBinaryClassifier") == (one >= 0.5).cast("double")) & (F.abs(one + zero - 1) < 1e-9))
    return out.groupBy("split_id").agg(F.count("*").alias("n"), F.round(F.avg(one), 1).alias("center"), consistent.alias("consistent"))


# one tree of one cut: the greatest gain among all values of two features of few values
_STUMP = """st AS (SELECT split_id, avg(y) AS base, count(*) AS n FROM train GROUP BY 1),
long AS (SELECT t.split_id, f.f, CASE WHEN f.f = 0 THEN t.cls ELSE t.tens END AS x, t.y - s.base AS r FROM (SELECT *, least(floor(value / 20), 9) AS tens FROM train) t JOIN st s ON t.split_id = s.split_id, (VALUES (0), (1)) f(f)),
sums AS (SELECT split_id, f, x, sum(r) AS r, count(*) AS n FROM long GROUP BY ALL),
cuts AS (SELECT split_id, f, x, sum(r) OVER w AS rl, sum(n) OVER w AS nl, sum(r) OVER (PARTITION BY split_id, f) - sum(r) OVER w AS rr, sum(n) OVER (PARTITION BY split_id, f) - sum(n) OVER w AS nr FROM sums WINDOW w AS (PARTITION BY split_id, f ORDER BY x)),
best AS (SELECT split_id, arg_max({'f': f, 'x': x, 'l': rl / nl, 'r': rr / nr, 'gain': (rl * rl / nl + rr * rr / nr) / 2}, (round((rl * rl / nl + rr * rr / nr) / 2, 9), -f, -x)) AS c FROM cuts WHERE nl >= 1 AND nr >= 1 GROUP BY 1)"""


def _stump_series(spark, d):
    return events_series(spark, d).withColumn("tens", F.least(F.floor(F.col("value") / 20), F.lit(9)).cast("double"))


@query("boosted_stump", f"""WITH {E}, {SPLITS} {TRAIN}, {_STUMP}
SELECT s.split_id, b.rid, round(st.base + CASE WHEN (CASE WHEN best.c.f = 0 THEN b.cls ELSE least(floor(b.value / 20), 9) END) <= best.c.x THEN best.c.l ELSE best.c.r END, 6) AS p
FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN st ON st.split_id = s.split_id JOIN best ON best.split_id = s.split_id""")
def boosted_stump(spark, d):
    out = engine.train_backtest([BoostedTrees(1, 1, 1.0, l2=0.0)], _stump_series(spark, d), EXPANDING, ("cls", "tens"))
    return out.select("split_id", "rid", F.round("predictions_BoostedTrees", 6).alias("p"))


@query("boosted_importances", f"WITH {E}, {SPLITS} {TRAIN}, {_STUMP} SELECT s.split_id, s.tr1 - 1 AS rid, CASE WHEN best.c.f = 0 THEN 'cls' ELSE 'tens' END AS feature, round(best.c.gain, 4) AS gain FROM splits s JOIN best ON best.split_id = s.split_id")
def boosted_importances(spark, d):
    """Importances of a model inside an ensemble, as artifacts."""
    block = comp.Ensemble(([BoostedTrees(1, 1, 1.0, l2=0.0)], [mod.DummyRegressor(50)]))
    _, made = engine.train_backtest([block], _stump_series(spark, d), EXPANDING, ("cls", "tens"), return_artifacts=True)
    return made.select("split_id", "rid", F.col("value")[0].alias("feature"), F.round(F.col("numbers")[0], 4).alias("gain"))


# a perfect cut: whatever is under the threshold is 0, and the trees come closer by a fixed factor each
@query("boosted_classifier", f"""WITH {E}, {SPLITS} {TRAIN}, st AS (SELECT split_id, count(*) FILTER (value > 60) AS one, count(*) FILTER (value <= 60) AS zero FROM train GROUP BY 1)
SELECT s.split_id, b.rid, CAST(b.value > 60 AS BIGINT) AS p, CAST(b.value > 60 AS BIGINT) AS likely FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN st ON st.split_id = s.split_id WHERE st.one > 0 AND st.zero > 0""")
def boosted_classifier(spark, d):
    """Whether a value's floor is over 60, from the floor and a class of no use: trees must find the threshold, with balanced classes."""
    df = events_series(spark, d).withColumns({"whole": F.ceil(F.col("value") / 20).cast("double"), "y": F.when(F.col("value") > 60, 1.0).otherwise(0.0)})
    out = engine.train_backtest([BoostedTrees(5, 2, objective="classification", class_weights="balanced")], df, EXPANDING, ("cls", "whole"))
    return out.select("split_id", "rid", F.col("predictions_BoostedTrees").cast("long").alias("p"), (F.col("probabilities_BoostedTrees_1") > 0.8).cast("long").alias("likely"))


@query("gbt", f"WITH {D}, {splits_sql(0.6, 0.3)} {TRAIN}, st AS (SELECT split_id, min(y) AS lo, max(y) AS hi FROM train GROUP BY 1) SELECT s.split_id, count(*) AS n, TRUE AS in_range FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN st ON s.split_id = st.split_id GROUP BY 1")
def gbt(spark, d):
    """Boosted trees know every test row, stay near the targets' range, and err at most a fifth more than the mean would (SQL states the rows and that this holds)."""
    from pyspark.ml.regression import GBTRegressor

    lags = feat.AddLagsX(("rev", [1, 2]))
    df = daily_series(spark, d)
    out = engine.train_backtest([lags, GBTRegressor(maxIter=3, maxDepth=3, seed=1)], df, sp.ExpandingWindowSplitter(0.6, 0.3), ("rev",))
    ends = df.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("mean"))
    p, margin = F.col("predictions_GBTRegressor"), (F.col("hi") - F.col("lo")) / 10
    inside = F.coalesce(p.between(F.col("lo") - margin, F.col("hi") + margin), F.lit(False))
    error = lambda x: F.sqrt(F.avg(F.pow(x - F.col("y"), 2)))
    return out.crossJoin(F.broadcast(ends)).groupBy("split_id").agg(F.count("*").alias("n"), (F.bool_and(inside) & (error(p) <= 1.2 * error(F.col("mean")))).alias("in_range"))


def _newton(steps: int) -> str:
    """Weighted logistic regression of cls on value by Newton's steps, one common table a step."""
    out = ", w AS (SELECT split_id, sum(cls) AS one, count(*) - sum(cls) AS zero FROM train GROUP BY 1), tw AS MATERIALIZED (SELECT t.split_id, (t.value - 50) / 50 AS x, t.cls AS y, CASE WHEN t.cls = 1 THEN w.zero / w.one ELSE 1.0 END AS wt FROM train t JOIN w ON t.split_id = w.split_id), n0 AS (SELECT split_id, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM w)"
    for k in range(steps):
        out += f""", p{k} AS (SELECT tw.split_id, tw.x, tw.wt, tw.y, n.b0, n.b1, 1 / (1 + exp(-n.b0 - n.b1 * tw.x)) AS p FROM tw JOIN n{k} n ON tw.split_id = n.split_id),
g{k} AS (SELECT split_id, any_value(b0) AS b0, any_value(b1) AS b1, sum(wt * (y - p)) AS g0, sum(wt * (y - p) * x) AS g1, sum(wt * p * (1 - p)) AS h, sum(wt * p * (1 - p) * x) AS i, sum(wt * p * (1 - p) * x * x) AS j FROM p{k} GROUP BY 1),
n{k + 1} AS MATERIALIZED (SELECT split_id, b0 + (j * g0 - i * g1) / (h * j - i * i) AS b0, b1 + (h * g1 - i * g0) / (h * j - i * i) AS b1 FROM g{k})"""
    return out


@query("logistic", f"""WITH {E}, {splits_sql(0.6, 0.3)} {TRAIN} {_newton(6)}
SELECT s.split_id, b.rid, round(1 / (1 + exp(-n6.b0 - n6.b1 * (b.value - 50) / 50)), 3) + 0::DOUBLE AS p1 FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN n6 ON s.split_id = n6.split_id""")
def logistic(spark, d):
    from pyspark.ml.classification import LogisticRegression

    df = events_series(spark, d).withColumn("y", F.col("cls"))
    model = mod.FromMl(LogisticRegression(maxIter=100, tol=1e-10), "balanced", "logistic")
    return engine.train_backtest([model], df, sp.ExpandingWindowSplitter(0.6, 0.3), ("value",)).select("split_id", "rid", F.round("probabilities_logistic_1", 3).alias("p1"))


@query("pca", f"""WITH {E}, {SPLITS} {TRAIN}, q AS (SELECT split_id, var_samp(value) AS a, var_samp(cls * 30) AS d, covar_samp(value, cls * 30) AS o FROM train GROUP BY 1),
l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + o * o) AS top FROM q), v AS (SELECT split_id, o / sqrt(o * o + (top - a) * (top - a)) AS vx, (top - a) / sqrt(o * o + (top - a) * (top - a)) AS vy FROM l)
SELECT s.split_id, b.rid, round(abs(v.vx * b.value + v.vy * b.cls * 30), 4) AS size FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN v ON s.split_id = v.split_id""")
def pca(spark, d):
    """The first component's absolute value, as its sign is free."""
    from pyspark.ml.feature import PCA

    df = events_series(spark, d).withColumn("cls30", F.col("cls") * 30)
    out = engine.train_backtest([PCA(k=1)], df, EXPANDING, ("value", "cls30"))
    return out.select("split_id", "rid", F.round(F.abs("PCA_0"), 4).alias("size"))


_TWO = ([feat.MultiplyBy(2.0)], [feat.MultiplyBy(3.0), col_ops.SelectColumns(["value"])])
feature("concat_first", [comp.Concat(_TWO)], {"value": "r", "const": "k"}, {"r": "value * 2", "k": "const * 2"})
feature("concat_last", [comp.Concat(_TWO, "last")], {"value": "r", "const": "k"}, {"r": "value * 3", "k": "const * 2"})
feature("concat_custom_merge", [comp.Concat(_TWO, custom_merge_logic=lambda xs: xs[0] + xs[1])], {"value": "r"}, {"r": "value * 5"})
feature("transform_column", [comp.TransformColumn("value", [feat.MultiplyBy(4.0)])], {"value": "r", "value2": "r2"}, {"r": "value * 4", "r2": "value2"})
feature("transform_each_column", [comp.TransformEachColumn([sc.StandardScaler()])], {"value": "r", "value2": "r2"}, {"r": "(value - m) / d", "r2": "(value - m) / d"}, extra=TRAIN + ", st AS (SELECT split_id, avg(value) AS m, stddev_pop(value) AS d FROM train GROUP BY 1)", joins=_STATE, features=("value", "value2"))
feature("ensemble_mean", [comp.Ensemble(([mod.DummyRegressor(2)], [mod.LinearRegression()]))], {"predictions_Ensemble": "p"}, {"p": "(2 + m * value + c) / 2"}, extra=_FIT, joins=_STATE, digits=4, features=("value",))
_CLASSIFIERS = ([mod.DummyClassifier(1, (0, 1), (0.3, 0.7))], [mod.DummyClassifier(0, (0, 1), (0.6, 0.4))])
feature("ensemble_probabilities", [comp.Ensemble(_CLASSIFIERS, True)], {"predictions_Ensemble": "p", "probabilities_Ensemble_1": "p1"}, {"p": "1.0::DOUBLE", "p1": "0.55::DOUBLE"})
feature("ensemble_each_column", [comp.EnsembleEachColumn([feat.MultiplyBy(2.0)])], {"predictions_EnsembleEachColumn": "p"}, {"p": "(value + value2) * 2 / 2"}, features=("value", "value2"))
feature("model_residuals", [comp.ModelResiduals([mod.DummyRegressor(40)], [mod.LinearRegression()])], {"predictions_ModelResiduals": "p"}, {"p": "m * value + c"}, extra=_FIT, joins=_STATE, digits=4, features=("value",))
feature("transform_target_log", [comp.TransformTarget([mod.LinearRegression()], (feat.TakeLog(), sc.StandardScaler()))], {"predictions_LinearRegression": "p"}, {"p": "exp(m * rev + c)"}, extra=TRAIN + ", st AS (SELECT split_id, regr_slope(ln(y), rev) AS m, regr_intercept(ln(y), rev) AS c FROM train GROUP BY 1)", joins=_STATE, digits=1, series=daily_series, base=D, features=("rev",))
feature("meta_labeling", [comp.MetaLabeling([mod.DummyRegressor(1)], [mod.LinearRegression()])], {"predictions_MetaLabeling": "p"}, {"p": "m * value + c"}, extra=TRAIN + ", st AS (SELECT split_id, regr_slope(hit, value) AS m, regr_intercept(hit, value) AS c FROM (SELECT split_id, value, CASE WHEN trunc(y) = 1 THEN 1.0 ELSE 0.0 END AS hit FROM train) GROUP BY 1)", joins=_STATE, digits=4, features=("value",))
feature("skip_na", [comp.SkipNA([feat.AddLagsX(("value_n", 1), keep_original=False)])], {"value_n~lag_1": "r"}, {"r": "l"}, features=("value_n",), splitter=sp.ForwardSingleWindowSplitter(50), splits="splits AS (SELECT 0::BIGINT AS split_id, 0::BIGINT AS tr0, 50::BIGINT AS tr1, 50::BIGINT AS te0, count(*) AS te1 FROM b)", memory=1, extra=", b2 AS (SELECT rid, lag(value_n, 1) OVER (ORDER BY rid) AS l FROM b WHERE value_n IS NOT NULL AND rid >= 49)", joins="LEFT JOIN b2 ON t.rid = b2.rid")

def _sampled(sampler):
    def run(spark, d):
        df = events_series(spark, d).withColumn("y", F.col("cls"))
        results = engine.train_backtest([comp.Sample(sampler, [mod.LinearRegression()])], df, EXPANDING, ("value",))
        return results.select("split_id", "rid", F.round("predictions_LinearRegression", 4).alias("p"))

    return run


_COUNTS = "n AS (SELECT split_id, cls, count(*) AS k FROM train GROUP BY 1, 2), nm AS (SELECT split_id, min(k) AS lo, max(k) AS hi FROM n GROUP BY 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY split_id, cls ORDER BY md5('1-' || rid), rid) AS at FROM train)"
_SAMPLED = """WITH {E}, {SPLITS} {TRAIN}, {counts}, tr AS ({rows}), st AS (SELECT split_id, regr_slope(cls, value) AS m, regr_intercept(cls, value) AS c FROM tr GROUP BY 1)
SELECT s.split_id, b.rid, round(st.m * b.value + st.c, 4) AS p FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN st ON s.split_id = st.split_id"""
QUERIES["undersample"] = _sampled(comp.UnderSampler())
ORACLE_SQL["undersample"] = _SAMPLED.format(E=E, SPLITS=SPLITS, TRAIN=TRAIN, counts=_COUNTS, rows="SELECT t.* FROM ranked t JOIN nm ON t.split_id = nm.split_id WHERE t.at <= nm.lo")
QUERIES["oversample"] = _sampled(comp.OverSampler())
ORACLE_SQL["oversample"] = _SAMPLED.format(E=E, SPLITS=SPLITS, TRAIN=TRAIN, counts=_COUNTS, rows="SELECT t.*, unnest(range(0, nm.hi // n.k + CASE WHEN t.at <= nm.hi % n.k THEN 1 ELSE 0 END)) FROM ranked t JOIN n ON t.split_id = n.split_id AND t.cls = n.cls JOIN nm ON t.split_id = nm.split_id")


@query("strategy_meta_labeling", f"WITH {E}, {SPLITS}, {_FORWARD} SELECT s.split_id, fw.rid, CASE WHEN fw.f IS NOT NULL THEN CASE WHEN fw.value > 50 THEN 2.0 ELSE -2.0 END END::DOUBLE AS p FROM fw JOIN splits s ON fw.rid >= s.te0 AND fw.rid < s.te1")
def strategy_meta_labeling(spark, d):
    df = events_series(spark, d)
    events = ev.create_events(df, df.count(), _forward()).withColumn("event_strategy_label", F.when(F.col("value") > 50, 1.0).otherwise(-1.0))
    out = engine.train_backtest([comp.StrategyMetaLabeling([mod.DummyRegressor(2)])], df, EXPANDING, ("value",), events=events)
    return out.select("split_id", "rid", F.col("predictions_StrategyMetaLabeling").alias("p"))


@query("ols_weighted_events", f"""WITH {E}, {SPLITS}, {_FORWARD}, g AS (SELECT rid, value, f, abs(f) / max(abs(f)) OVER (ORDER BY rid ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS k FROM fw WHERE f IS NOT NULL),
q AS (SELECT s.split_id, sum(k) AS sw, sum(k * value) AS sx, sum(k * f) AS sy, sum(k * value * value) AS sxx, sum(k * value * f) AS sxy FROM g JOIN splits s ON g.rid >= s.tr0 AND g.rid < s.tr1 GROUP BY 1),
st AS (SELECT split_id, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS m, sx, sy, sw FROM q)
SELECT s.split_id, g.rid, round(st.m * g.value + (st.sy - st.m * st.sx) / st.sw, 4) AS p FROM g JOIN splits s ON g.rid >= s.te0 AND g.rid < s.te1 JOIN st ON s.split_id = st.split_id""")
def ols_weighted_events(spark, d):
    card = engine.PipelineCard([mod.LinearRegression()], labeler=_forward(weighting_strategy=ev.WeightByMax(100)))
    out = engine.train_backtest(card, events_series(spark, d), EXPANDING, ("value",))
    return out.where("predictions_LinearRegression IS NOT NULL").select("split_id", "rid", F.round("predictions_LinearRegression", 4).alias("p"))


model("ols_with_gap", engine.PipelineCard([mod.LinearRegression()], forward_horizon=10), {"predictions_LinearRegression": "p"}, {"p": "m * value + c"}, _FIT, _STATE, digits=4, features=("value",), splits=splits_sql(0.4, 0.1, gap=10))


@query("merge_tables", f"WITH {E} SELECT coalesce(x.rid, z.rid) AS rid, x.a, z.b, round(coalesce(x.v, z.v), 6) AS v FROM (SELECT rid, value AS a, value AS v FROM b WHERE value < 60) x FULL JOIN (SELECT rid, cls AS b, value2 AS v FROM b WHERE value > 40) z ON x.rid = z.rid")
def merge_tables(spark, d):
    df = events_series(spark, d)
    left = df.where("value < 60").select("rid", F.col("value").alias("a"), F.col("value").alias("v"))
    right = df.where("value > 40").select("rid", F.col("cls").alias("b"), F.col("value2").alias("v"))
    return comp.merge_tables(left, right).withColumn("v", F.round("v", 6))


@query("mean_correlation", f"WITH {E} SELECT round((corr(value, y) + corr(value, cls) + corr(y, cls)) / 3, 6) AS correlation FROM b")
def mean_correlation(spark, d):
    return comp.mean_correlation(events_series(spark, d), ["value", "y", "cls"]).select(F.round("correlation", 6).alias("correlation"))


# --- the loop

_PREDICTED = f"""WITH {D}, {SPLITS} {_TRAIN_LAG}, t AS (SELECT s.split_id, s.te0, b.*, lag(b.rev, 1) OVER (PARTITION BY s.split_id ORDER BY b.rid) AS l FROM b JOIN splits s ON b.rid >= greatest(s.te0 - 1, 0) AND b.rid < s.te1),
pr AS (SELECT t.split_id, t.rid, t.y, st.m * t.l + st.c AS p FROM t JOIN st ON t.split_id = st.split_id WHERE t.rid >= t.te0)"""


@query("backtest_scores", f"{_PREDICTED} SELECT split_id, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round(avg(abs(y - p)), 2) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM pr WHERE p IS NOT NULL GROUP BY 1")
def backtest_scores(spark, d):
    scores = engine.score(engine.train_backtest(_LAG_MODEL, daily_series(spark, d), EXPANDING, ("rev",)))
    return scores.select("split_id", "n", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"))


@query("weighted_scores", f"""WITH {E}, {SPLITS}, {_FORWARD}, g AS (SELECT *, f AS label, abs(f) / (SELECT max(f) FROM fw) AS wt FROM fw WHERE f IS NOT NULL),
j AS (SELECT s.split_id, g.label, g.wt, 2.0 AS p FROM g JOIN splits s ON g.rid >= s.te0 AND g.rid < s.te1) SELECT split_id, count(*) AS n, round(sqrt(sum(wt * (label - p) * (label - p)) / sum(wt)), 4) AS rmse FROM j GROUP BY 1""")
def weighted_scores(spark, d):
    card = engine.PipelineCard([mod.DummyRegressor(2)], labeler=_forward())
    scores, _, _ = engine.train_evaluate(card, events_series(spark, d), EXPANDING, ("value",))
    return scores.select("split_id", "n", F.round("rmse", 4).alias("rmse"))


@query("accuracy_scores", f"WITH {E}, {SPLITS} SELECT s.split_id, round(avg(CASE WHEN b.cls = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 GROUP BY 1")
def accuracy_scores(spark, d):
    df = events_series(spark, d).withColumn("y", F.col("cls"))
    return engine.score(engine.train_backtest([mod.DummyRegressor(1)], df, EXPANDING, ("value",))).select("split_id", F.round("accuracy", 6).alias("accuracy"))


@query("insample_dedup", f"""WITH {E}, {SPLITS} {_FIT}, a AS (SELECT s.split_id, b.rid, b.value FROM b JOIN splits s ON b.rid >= s.tr0 AND b.rid < s.tr1), k AS (SELECT rid, max(split_id) AS split_id, any_value(value) AS value FROM a GROUP BY 1)
SELECT k.split_id, k.rid, round(st.m * k.value + st.c, 4) AS p FROM k JOIN st ON k.split_id = st.split_id""")
def insample_dedup(spark, d):
    trained = engine.train([mod.LinearRegression()], events_series(spark, d), EXPANDING, ("value",))
    return engine.in_sample(trained).select("split_id", "rid", F.round("predictions_LinearRegression", 4).alias("p"))


@query("infer_last_split", f"WITH {E}, {SPLITS} {_FIT} SELECT b.rid, round(st.m * lag(b.value, 1) OVER (ORDER BY b.rid) + st.c, 4) AS p FROM b, st WHERE st.split_id = (SELECT max(split_id) FROM splits)".replace("regr_slope(y, value)", "regr_slope(y, l)").replace("regr_intercept(y, value)", "regr_intercept(y, l)").replace("FROM train GROUP BY 1)", "FROM (SELECT *, lag(value, 1) OVER (PARTITION BY split_id ORDER BY rid) AS l FROM train) WHERE l IS NOT NULL GROUP BY 1)"))
def infer_last_split(spark, d):
    df = events_series(spark, d)
    trained = engine.train([feat.AddLagsX(("value", 1), keep_original=False), mod.LinearRegression()], df, EXPANDING, ("value",), for_deployment=True)
    return engine.infer(trained, df.select("rid", "ts", "value"), ("value",)).select("rid", F.round("predictions_LinearRegression", 4).alias("p"))


@query("preprocessing_lags", f"WITH {E}, {SPLITS}, l AS (SELECT *, lag(value, 3) OVER (ORDER BY rid) AS v FROM b) SELECT s.split_id, l.rid, round(l.v, 6) AS lag_3 FROM l JOIN splits s ON l.rid >= s.te0 AND l.rid < s.te1")
def preprocessing_lags(spark, d):
    from .plans.blocks import Identity

    card = engine.PipelineCard([Identity()], preprocessing=[feat.AddLagsX(("value", 3), keep_original=False)])
    return engine.train_backtest(card, events_series(spark, d), EXPANDING, ("value",)).select("split_id", "rid", F.round("`value~lag_3`", 6).alias("lag_3"))


@query("preprocessing_scaler", f"WITH {E}, {SPLITS} SELECT s.split_id, b.rid, round((b.value - (SELECT avg(value) FROM b)) / (SELECT stddev_pop(value) FROM b), 6) AS scaled FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1")
def preprocessing_scaler(spark, d):
    from .plans.blocks import Identity

    card = engine.PipelineCard([Identity()], preprocessing=[sc.StandardScaler()])
    return engine.train_backtest(card, events_series(spark, d), EXPANDING, ("value",)).select("split_id", "rid", F.round("value", 6).alias("scaled"))


@query("trim_initial", f"WITH {E}, l AS (SELECT rid, lag(value, 4) OVER (ORDER BY rid) AS v FROM b) SELECT rid, round(v, 6) AS v FROM l WHERE rid >= (SELECT min(rid) FROM l WHERE v IS NOT NULL)")
def trim_initial(spark, d):
    df = events_series(spark, d)
    lagged = rows_of.blocked(df.select("rid", "value"), 4, 0).withColumn("v", F.lag("value", 4).over(rows_of.block_window())).where("NOT _halo")
    return engine.trim_initial(lagged, ["v"]).select("rid", F.round("v", 6).alias("v"))


@query("grid_search", f"WITH {E}, {SPLITS}, g AS (SELECT c.k AS candidate, avg((b.y - c.v) * (b.y - c.v)) AS e, count(*) AS n FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1, (VALUES (0, 10.0), (1, 50.0), (2, 90.0)) c(k, v) GROUP BY 1) SELECT candidate, n, round(sqrt(e), 4) AS rmse FROM g")
def grid_search(spark, d):
    tries = [{"m¦predicted_value": v} for v in (10.0, 50.0, 90.0)]
    _, table = tuning.tune([mod.DummyRegressor(0, name="m")], events_series(spark, d), EXPANDING, ("value",), candidates=tries)
    return table.select("candidate", "n", F.round("rmse", 4).alias("rmse"))


_INNER = "first AS (SELECT split_id, tr0 + CAST(floor(0.5::DOUBLE * (tr1 - tr0)) AS BIGINT) AS at, tr1 FROM splits)"
_TRIED = (46.0, 48.0, 50.0, 52.0, 54.0)


@query("optimizer_in_window", f"""WITH {E}, {SPLITS}, {_INNER}, g AS (SELECT f.split_id, c.v, avg((b.y - c.v) * (b.y - c.v)) AS e FROM first f JOIN b ON b.rid >= f.at AND b.rid < f.tr1, (VALUES {", ".join(f"({v})" for v in _TRIED)}) c(v) GROUP BY 1, 2),
best AS (SELECT split_id, min_by(v, e)::DOUBLE AS v FROM g GROUP BY 1) SELECT s.split_id, b.rid, best.v AS p FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN best ON s.split_id = best.split_id""")
def optimizer_in_window(spark, d):
    tries = tuple({"m¦predicted_value": v} for v in _TRIED)
    block = tuning.Optimizer([mod.DummyRegressor(0, name="m")], sp.ExpandingWindowSplitter(0.5, 0.25), tries)
    return engine.train_backtest([block], events_series(spark, d), EXPANDING, ("value",)).select("split_id", "rid", F.col("predictions_m").alias("p"))


_LAGS, _WIDTHS = (1, 3, 24), (2, 8, 32, 128)
_CANDIDATES = lambda xs: "candidates AS (" + " UNION ALL ".join(f"SELECT rid, y, {k} AS k, {x} AS x FROM b" for k, x in xs.items()) + ")"
_FITTED = "SELECT s.split_id, b.rid, round(o.i + o.s * c.x, 6) AS p FROM b JOIN splits s ON b.rid >= s.te0 AND b.rid < s.te1 JOIN best USING (split_id) JOIN candidates c ON c.rid = b.rid AND c.k = best.k JOIN outside o ON o.split_id = s.split_id"
_OUTSIDE = "outside AS (SELECT s.split_id, regr_slope(c.y, c.x) AS s, regr_intercept(c.y, c.x) AS i FROM splits s JOIN best USING (split_id) JOIN candidates c ON c.k = best.k AND c.rid >= s.tr0 AND c.rid < s.tr1 GROUP BY 1)"


@query("incremental_fit", f"""WITH {E}, x AS (SELECT rid, y, lag(value, 2) OVER (ORDER BY rid) AS x FROM b), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x)
SELECT rid, round(i + s * x, 6) AS p FROM x, f""")
def incremental_fit(spark, d):
    """Fitted on six tenths of the rows, then updated with two tenths at a time; old rows are only read as context."""
    df = events_series(spark, d)
    n = df.count()
    pipeline = [feat.AddLagsX(("value", 2), keep_original=False), sc.StandardScaler(), mod.LinearRegression()]
    k = n * 6 // 10
    trained = engine.train(pipeline, df.where(F.col("rid") < k), sp.WholeWindowSplitter(1), ("value",), n=k, need_in_sample=False)
    for end in (n * 8 // 10, n):
        trained, k = engine.update(trained, df.where((F.col("rid") >= k - 2) & (F.col("rid") < end)), ("value",)), end
    return engine.infer(trained, df, ("value",)).select("rid", F.round("predictions_LinearRegression", 6).alias("p"))


@query("optimizer_lags", f"""WITH {E}, {SPLITS}, {_INNER}, {_CANDIDATES({k: f"lag(value, {k}) OVER (ORDER BY rid)" for k in _LAGS})},
inside AS (SELECT f.split_id, c.k, regr_slope(c.y, c.x) AS s, regr_intercept(c.y, c.x) AS i FROM first f JOIN candidates c ON c.rid < f.at GROUP BY ALL),
best AS (SELECT split_id, arg_min(k, e) AS k FROM (SELECT f.split_id, c.k, avg(power(c.y - i - s * c.x, 2)) AS e FROM first f JOIN candidates c ON c.rid >= f.at AND c.rid < f.tr1 JOIN inside n ON n.split_id = f.split_id AND n.k = c.k GROUP BY ALL) GROUP BY 1),
{_OUTSIDE} {_FITTED}""")
def optimizer_lags(spark, d):
    pipeline = [feat.AddLagsX(("value", 1), keep_original=False, name="lags"), mod.LinearRegression()]
    block = tuning.Optimizer(pipeline, sp.ForwardSingleWindowSplitter(0.5), tuple({"lags¦columns_and_lags": ("value", k)} for k in _LAGS))
    return engine.train_backtest([block], events_series(spark, d), EXPANDING, ("value",)).select("split_id", "rid", F.round("predictions_LinearRegression", 6).alias("p"))


@query("optimizer_halving", f"""WITH {E}, {SPLITS}, {_CANDIDATES({k: f"avg(value) OVER (ORDER BY rid ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in _WIDTHS})},
sizes AS (SELECT split_id, tr0, tr1, CAST(floor(0.5::DOUBLE * (tr1 - tr0)) AS BIGINT) AS f, CAST(floor(0.125::DOUBLE * (tr1 - tr0)) AS BIGINT) AS st FROM splits),
windows AS (SELECT split_id, j, tr0, tr0 + f + j * st AS te0, CASE WHEN j = 3 THEN tr1 ELSE tr0 + f + (j + 1) * st END AS te1 FROM sizes, (SELECT unnest(range(0, 4)) AS j)),
inside AS (SELECT w.split_id, w.j, c.k, regr_slope(c.y, c.x) AS s, regr_intercept(c.y, c.x) AS i FROM windows w JOIN candidates c ON c.rid >= w.tr0 AND c.rid < w.te0 GROUP BY ALL),
errors AS (SELECT w.split_id, w.j, c.k, power(c.y - n.i - n.s * c.x, 2) AS e FROM windows w JOIN candidates c ON c.rid >= w.te0 AND c.rid < w.te1 JOIN inside n ON n.split_id = w.split_id AND n.j = w.j AND n.k = c.k),
half AS (SELECT split_id, k FROM (SELECT split_id, k, row_number() OVER (PARTITION BY split_id ORDER BY avg(e), k) AS place FROM errors WHERE j >= 2 GROUP BY 1, 2) WHERE place <= 2),
best AS (SELECT split_id, arg_min(k, e) AS k FROM (SELECT split_id, k, avg(e) AS e FROM errors JOIN half USING (split_id, k) GROUP BY 1, 2) GROUP BY 1),
{_OUTSIDE} {_FITTED}""")
def optimizer_halving(spark, d):
    pipeline = [feat.AddWindowFeatures(("value", 2, "mean"), keep_original=False, name="windows"), mod.LinearRegression()]
    tries = tuple({"windows¦column_window_fn": ("value", k, "mean")} for k in _WIDTHS)
    block = tuning.Optimizer(pipeline, sp.ExpandingWindowSplitter(0.5, 0.125), tries, search=tuning.Halving(0.5))
    return engine.train_backtest([block], events_series(spark, d), EXPANDING, ("value",)).select("split_id", "rid", F.round("predictions_LinearRegression", 6).alias("p"))


@query("artifacts_selected", f"WITH {E}, {SPLITS} {TRAIN}, k AS (SELECT split_id, CASE WHEN coalesce(power(corr(value, y), 2), -1) >= coalesce(power(corr(cls, y), 2), -1) THEN 'value' ELSE 'cls' END AS best FROM train GROUP BY 1) SELECT s.split_id, s.tr1 - 1 AS rid, 'selected_features_k best' AS artifact, k.best FROM splits s JOIN k ON s.split_id = k.split_id")
def artifacts_selected(spark, d):
    _, made = engine.train_backtest([sc.SelectKBest(1), mod.DummyRegressor(1)], events_series(spark, d), EXPANDING, ("value", "cls"), return_artifacts=True)
    return made.select("split_id", "rid", "artifact", F.col("value")[0].alias("best"))


@query("all_metrics", f"{_PREDICTED} SELECT split_id, round(avg((y - p) * (y - p)) / 1e6, 2) AS mse, round(avg(abs(y - p) / abs(y)), 6) AS mape, round(avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) AS smape, round(avg(y - p), 2) + 0::DOUBLE AS residual_mean, round(stddev_pop(y - p), 2) AS residual_sd FROM pr WHERE p IS NOT NULL GROUP BY 1")
def all_metrics(spark, d):
    scores = engine.score(engine.train_backtest(_LAG_MODEL, daily_series(spark, d), EXPANDING, ("rev",)))
    return scores.select("split_id", F.round(F.col("mse") / 1e6, 2).alias("mse"), F.round("mape", 6).alias("mape"), F.round("smape", 6).alias("smape"), (F.round("residual_mean", 2) + 0.0).alias("residual_mean"), F.round("residual_sd", 2).alias("residual_sd"))


# --- windows, columns and inverses that the queries above leave out


@query("splits_gap_after", f"WITH {E}, c AS (SELECT count(*) AS n FROM b), w AS (SELECT n, CAST(floor(0.3::DOUBLE * n) AS BIGINT) AS a, CAST(floor(0.2::DOUBLE * n) AS BIGINT) AS k FROM c) SELECT 0::BIGINT AS split_id, t.s AS tr_start, t.e AS tr_end, a AS te_start, a + k AS te_end FROM w, LATERAL (VALUES (0::BIGINT, a - 5), (a + k + 20, n)) t(s, e)")
def splits_gap_after(spark, d):
    """A test window amid its train windows: 5 rows are left out before it and 20 after."""
    n = events_series(spark, d).count()
    a, k = int(0.3 * n), int(0.2 * n)

    class Amid:
        def splits(self, n, place=None):
            return [sp.Split(0, (sp.Bounds(0, a), sp.Bounds(a + k, n)), (sp.Bounds(a, a + k),))]

    return sp.splits_table(spark, sp.plan_splits(Amid(), n, gap_before=5, gap_after=20))


@query("splits_overlapping", f"WITH {E}, {SPLITS.replace('least(n, f + (k + 1) * s)', 'n')} SELECT split_id, tr0 AS tr_start, tr1 AS tr_end, te0 AS te_start, te1 AS te_end FROM splits")
def splits_overlapping(spark, d):
    n = events_series(spark, d).count()
    return sp.splits_table(spark, sp.plan_splits(sp.ExpandingWindowSplitter(0.4, 0.1, overlapping_test_sets=True), n))


@query("only_probabilities", _TESTED.format("0.3::DOUBLE AS p0, 0.7::DOUBLE AS p1"))
def only_probabilities(spark, d):
    out = engine.train_backtest([mod.DummyClassifier(1, (0, 1), (0.3, 0.7)), col_ops.OnlyProbabilities()], events_series(spark, d), EXPANDING, ("value",))
    return out.select("split_id", "rid", F.col("probabilities_DummyClassifier_0").alias("p0"), F.col("probabilities_DummyClassifier_1").alias("p1"))


feature("only_predictions", [comp.Concat(([col_ops.SelectColumns(["value"])], [mod.LinearRegression()])), col_ops.OnlyPredictions()], {"predictions_LinearRegression": "p"}, {"p": "m * value + c"}, extra=_FIT, joins=_STATE, digits=4, features=("value",))
feature("select_best", [comp.SelectBest((feat.MultiplyBy(2.0, "twice"), feat.MultiplyBy(3.0, "thrice")), "thrice")], {"value": "r"}, {"r": "value * 3"}, features=("value",))
feature("add_features_of_two", [feat.AddFeatures((("value", "value2"), F.hypot))], {"value-value2~hypot": "r"}, {"r": "sqrt(value * value + value2 * value2)"}, features=("value", "value2"))
feature("window_fillna", [feat.AddWindowFeatures(("value_n", 3, "max"), fillna=True, output_dtype="long")], {"value_n~max_3": "r"}, {"r": "trunc(coalesce(max(value_n) OVER (PARTITION BY t.split_id ORDER BY t.rid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0.0))"}, 3, digits=None, cast="long", features=("value_n",))
feature("expanding_extremes", [feat.AddWindowFeatures([("value", None, "min"), ("value", None, "max")])], {"value~min_expanding": "lo", "value~max_expanding": "hi"}, {"lo": "min(value) OVER w", "hi": "max(value) OVER w"})
for _name, _step, _to in (("multiply", feat.MultiplyBy(2.5), "y * 2.5"), ("positive", sc.TurnPositive(), "y + 50"), ("minmax", sc.MinMaxScaler((0.0, 1.0)), "y / 7")):
    # least squares go along with any shift and scale of the target, so the inverse must bring back the plain model
    feature(f"transform_target_{_name}", [comp.TransformTarget([mod.LinearRegression()], (_step,))], {"predictions_LinearRegression": "p"}, {"p": "m * value + c"}, extra=_FIT, joins=_STATE, digits=4, features=("value",))


@query("forward_shifted", f"WITH {E} SELECT rid, round(sum(y) OVER (ORDER BY rid ROWS BETWEEN 3 FOLLOWING AND 6 FOLLOWING), 6) AS label FROM b QUALIFY count(*) OVER (ORDER BY rid ROWS BETWEEN 3 FOLLOWING AND 6 FOLLOWING) = 4")
def forward_shifted(spark, d):
    labeler = ev.FixedForwardHorizon(4, aggregate_function="sum", shift_by=2, truncate=False)
    return _with_events(spark, d, labeler).where("event_label IS NOT NULL").select("rid", F.round("event_label", 6).alias("label"))


@query("backtest_from_timestamp", f"""WITH {D}, a AS (SELECT rid AS p, (SELECT count(*) FROM b) AS n FROM b WHERE ts = (SELECT ts FROM b WHERE rid = 100)),
raw AS (SELECT k AS split_id, p + 200 + k * 300 AS te0, least(n, p + 500 + k * 300) AS te1, n FROM a, (SELECT unnest(range(0, 200)) AS k) WHERE p + 200 + k * 300 < n),
last AS (SELECT max(split_id) AS kk, max_by(te1 - te0, split_id) AS len, any_value(n) AS n FROM raw),
s AS (SELECT CASE WHEN kk > 0 AND len <= CAST(floor(0.1::DOUBLE * last.n) AS BIGINT) AND split_id = kk THEN kk - 1 ELSE split_id END AS split_id, te0, te1 FROM raw, last)
SELECT s.split_id, b.rid, 1.0::DOUBLE AS p FROM b JOIN s ON b.rid >= s.te0 AND b.rid < s.te1""")
def backtest_from_timestamp(spark, d):
    df = daily_series(spark, d)
    start = df.where("rid = 100").first()["ts"]
    splitter = sp.ExpandingWindowSplitter(200, 300, start=str(start))
    return engine.train_backtest([mod.DummyRegressor(1)], df, splitter, ("rev",)).select("split_id", "rid", F.col("predictions_DummyRegressor").alias("p"))


# --- many series in one table: each user's events


def _users(spark, d):
    df = _table(spark, d, "events").select(F.col("user_id").alias("unique_id"), F.col("ts").alias("ds"), "event_id", "value")
    return panel.with_next(df, "value", order=("ds", "event_id"))


def _panel_sql(sliding: bool, columns: str, joins: str = "") -> str:
    return f"""WITH e AS (SELECT user_id AS unique_id, ts AS ds, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM events),
b AS (SELECT *, row_number() OVER o - 1 AS rid, count(*) OVER (PARTITION BY unique_id) AS n, avg(value) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, lag(value, 2) OVER o AS l FROM e WHERE y IS NOT NULL WINDOW o AS (PARTITION BY unique_id ORDER BY ds, event_id)),
cfg AS (SELECT DISTINCT unique_id, n, CAST(floor(0.4::DOUBLE * n) AS BIGINT) AS w, greatest(CAST(floor(0.1::DOUBLE * n) AS BIGINT), 1) AS s FROM b),
raw AS (SELECT *, w + k * s AS te0, least(n, w + (k + 1) * s) AS te1, max(k) OVER (PARTITION BY unique_id) AS kk FROM cfg, (SELECT unnest(range(0, 200)) AS k) WHERE w + k * s < n),
lastk AS (SELECT unique_id, kk > 0 AND te1 - te0 <= floor(0.1::DOUBLE * n) AS merged FROM raw WHERE k = kk),
splits AS (SELECT unique_id, k AS split, {"greatest(te0 - w, 0)" if sliding else "0"} AS tr0, te0, CASE WHEN merged AND k = kk - 1 THEN n ELSE te1 END AS te1 FROM raw JOIN lastk USING (unique_id) WHERE NOT (merged AND k = kk)),
fit AS (SELECT s.unique_id, s.split, CASE WHEN max(m) > min(m) THEN regr_slope(y, m) ELSE 0 END AS slope, avg(m) AS mx, avg(y) AS my FROM splits s JOIN b ON b.unique_id = s.unique_id AND b.rid >= s.tr0 AND b.rid < s.te0 GROUP BY ALL)
SELECT s.unique_id, s.split, b.rid, {columns} FROM splits s JOIN b ON b.unique_id = s.unique_id AND b.rid >= s.te0 AND b.rid < s.te1 {joins}"""


@query("panel_lags", _panel_sql(False, "l AS lagged"))
def panel_lags(spark, d):
    out = panel.backtest([feat.AddLagsX(("value", 2))], _users(spark, d), EXPANDING, ("value",), ("ds", "event_id"))
    return out.select("unique_id", "split", "rid", c("value~lag_2").alias("lagged"))


@query("panel_ols", _panel_sql(False, "round(my + slope * (m - mx), 3) + 0::DOUBLE AS p", "LEFT JOIN fit f ON f.unique_id = s.unique_id AND f.split = s.split"))
def panel_ols(spark, d):
    steps = [feat.AddWindowFeatures(("value", 3, "mean"), keep_original=False), sc.StandardScaler(), mod.LinearRegression()]
    out = panel.backtest(steps, _users(spark, d), EXPANDING, ("value",), ("ds", "event_id"))
    return out.select("unique_id", "split", "rid", F.round("predictions_LinearRegression", 3).alias("p"))
