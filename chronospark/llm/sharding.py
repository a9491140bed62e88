"""Shards that all hold the same mixture, by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked. A row's place
is its rank as a fraction of its source's rows, (rank + phase) / rows, so that any
stretch of places holds each source in proportion to its size; the phase, a
seeded number from 0 to 1 for each source, keeps small sources from meeting at one
place. Rows are sorted by place and cut into shards of equal counts.

Both orders come from range partitionings and the ranges' counts, so a source or
a group of equal rows of any size is dealt over many tasks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.series import with_rid
from .common import documents, ranked, saved, unused

#: Steps of a source's phase.
PHASES = 1 << 20


def interleaved(rows: DataFrame, shards: int = 16, by: str = "source", keys: list[str] | None = None, seed: int = 17) -> DataFrame:
    """rows with shard (from 0), slot (place in its shard, gapless from 0) and, if more than one shard, sizes at most one apart.

    by is the column of the strata; a null is a stratum of its own. keys are the
    columns whose hash shuffles rows (all others than by if not given); rows that
    agree in them keep the order in which they were read, so results only depend on
    the rows as a set if keys tell unlike rows apart. With fewer rows than shards
    some shards are empty; an empty table gives no rows. All columns of rows stay,
    whatever their names; columns named shard and slot are replaced.
    """
    kept = [x for x in rows.columns if x.lower() not in ("shard", "slot")]
    row, group, mixed, rank, size, place, at = (unused(x, rows.columns) for x in ("_row", "_group", "_mixed", "_rank", "_size", "_place", "_position"))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    columns = [F.col(f"`{x}`") for x in (keys if keys is not None else [x for x in kept if x != by])]
    shuffled = rows.select(*[F.col(f"`{x}`") for x in kept], stratum.alias(group), F.xxhash64(F.lit(seed), *columns).alias(mixed), F.monotonically_increasing_id().alias(row))
    shuffled = saved(shuffled)  # the order in which rows were read is fixed from here on
    n = shuffled.count()
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), group), F.lit(PHASES)) + 0.5) / PHASES
    placed = ranked(shuffled, group, [mixed, row], rank, size).withColumn(place, (F.col(rank) + phase) / F.col(size))
    sorted_rows = with_rid(placed, [place, group, rank], at)
    shard = F.expr(f"((`{at}` + 1) * {shards} - 1) div {max(n, 1)}")
    out = sorted_rows.withColumn("shard", shard.cast("int"))
    return out.withColumn("slot", F.col(at) - F.expr(f"({max(n, 1)} * cast(shard as bigint)) div {shards}")).drop(row, group, mixed, rank, size, place, at)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Rows of interleaved() as Parquet, a folder for each shard, in each file by slot."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir):
    """Law rows: 16 shards of documents, counts at most one apart, each with the sources in proportion.

    Equal texts needn't meet: a group that holds a third of the rows can't be in one shard of a sixteenth.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    narrow = documents(spark, sf_dir).select("doc_id", "source", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = interleaved(narrow, keys=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
