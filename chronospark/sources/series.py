"""Reading a series, putting it in order, and making its target."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import c
from ..functions.rows import block_window, blocked
from ..functions.scalar import nan_to_null
from .tables import saved


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A Parquet, ORC, JSON or CSV file or folder, by the end of its name; CSV files have a header."""
    kind = next((k for k in ("csv", "json", "orc") if path.rstrip("/").endswith(k)), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).option("inferSchema", schema is None).csv(path) if kind == "csv" else reader.format(kind).load(path)


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").parquet(path)


def with_rid(df: DataFrame, order: list[str], name: str = "rid") -> DataFrame:
    """df with row numbers from 0 in the order of the columns, which must be a total one.

    Rows are dealt by ranges and numbered within them; only the ranges' sizes,
    a row a partition, reach the driver. The dealt rows are written, as sampling
    fixes the ranges.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before = [0, *itertools.accumulate(n for _, n in sizes)]
    offsets = df.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sizes, before)], "_range int, _before long")
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_at") + F.col("_before")).drop("_range", "_at", "_before")


def clean(df: DataFrame) -> DataFrame:
    """NaN as null in all float columns: Spark counts NaN as a value."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[nan_to_null(c(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else c(f.name) for f in df.schema])


def deduplicate(df: DataFrame, ts: str, tie: str, keep: str = "first") -> DataFrame:
    """One row for each timestamp: the first or last by tie. A grouped aggregate, so that no timestamp's rows are sorted in one task."""
    pick = F.min_by if keep == "first" else F.max_by
    whole = F.struct(*[c(x) for x in df.columns if x != ts])
    return df.groupBy(ts).agg(pick(whole, c(tie)).alias("_row")).select(ts, "_row.*").select(*df.columns)


def resample_last(df: DataFrame, ts: str, tie: str, every: str) -> DataFrame:
    """A regular grid of every (an interval such as "1 hour"): each bucket's last known value of each column, null in empty buckets."""
    values = [x for x in df.columns if x not in (ts, tie)]
    window = F.window(c(ts), every)
    order = F.struct(c(ts), c(tie))
    last = [F.max_by(c(x), F.when(c(x).isNotNull(), order)).alias(x) for x in values]
    found = df.groupBy(window["start"].alias("_bucket")).agg(*last)
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    start = window["start"]
    ends = df.agg(F.min(start).alias("_first"), F.min(micros(start)).alias("a"), F.max(micros(start)).alias("b"), F.min(micros(window["end"]) - micros(start)).alias("step"))
    a, b, step = ends.select("a", "b", "step").first()  # one row
    # the grid's places come from a range, dealt over tasks, not from one row's array
    places = df.sparkSession.range(0 if a is None else (b - a) // step + 1)
    grid = places.crossJoin(F.broadcast(ends)).select(F.expr("timestampadd(MICROSECOND, id * step, _first)").cast(df.schema[ts].dataType).alias("_bucket"))
    return grid.join(found, "_bucket", "left").select(F.col("_bucket").alias(ts), *[c(x) for x in values])


def shorten(df: DataFrame, rows: int) -> DataFrame:
    """The first rows + 1 rows by rid."""
    return df.where(F.col("rid") <= rows)


def with_target(df: DataFrame, column: str, ahead: int = 1) -> DataFrame:
    """df with y, the column's value ahead rows later; rows without one go.

    The value comes from a window over blocks of rows, so that the whole series
    isn't one window's partition.
    """
    w = block_window()
    dealt = blocked(df, 0, ahead).withColumns({"y": F.lead(c(column).cast("double"), ahead).over(w), "_later": F.lead("rid", ahead).over(w)})
    return dealt.where(~F.col("_halo") & F.col("_later").isNotNull()).drop("_block", "_halo", "_later")


def require_columns(df: DataFrame, needed: list[str]) -> None:
    missing = [x for x in needed if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def preprocessed(spark: SparkSession, path: str, target: str, ts: str, tie: str, resample: str | None = None, keep: str | None = None, rows: int | None = None) -> DataFrame:
    """Read, deduplicate, resample, number, shorten, and add the target."""
    df = clean(read(spark, path))
    require_columns(df, [ts, tie, target])
    df = deduplicate(df, ts, tie, keep) if keep else df
    if resample:
        df, order = resample_last(df, ts, tie, resample), [ts]
    else:
        order = [ts, tie]
    df = with_rid(df, order)
    return with_target(shorten(df, rows) if rows is not None else df, target)


def _generated(spark: SparkSession, n: int, value) -> DataFrame:
    start = F.to_timestamp_ntz(F.lit("2022-01-01 00:00:00"))
    df = spark.range(n + 1).select(F.col("id").alias("rid"), (start + F.make_dt_interval(mins=(F.col("id") - n).cast("int"))).alias("ts"), value(F.col("id")).alias("x"))
    return with_target(df, "x")


def sine(spark: SparkSession, n: int = 1000, cycles: int = 2) -> DataFrame:
    return _generated(spark, n, lambda i: F.round(F.sin(i / n * (2 * 3.141592653589793 * cycles)), 4))


def zeros(spark: SparkSession, n: int = 1000) -> DataFrame:
    return _generated(spark, n, lambda i: F.lit(0.0))


def zeros_and_ones(spark: SparkSession, n: int = 1000, ones: float = 0.5, seed: int = 1) -> DataFrame:
    return _generated(spark, n, lambda i: F.when(F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(1_000_000)) < ones * 1_000_000, 1.0).otherwise(0.0))


def monotonous(spark: SparkSession, n: int = 1000) -> DataFrame:
    return _generated(spark, n, lambda i: i / n)

