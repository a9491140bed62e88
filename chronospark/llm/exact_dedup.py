"""Exact duplicates by deterministic block naming.

A text's bytes are cut into blocks of fixed size. All distinct blocks are sorted
and numbered; a block's number is its name. Adjacent names are then paired and
the distinct pairs are sorted and numbered again, until one name is left of each
text. Two texts get the same (level, name) exactly when they are identical.

Only names travel after the first level: occurrences find their block's name by
a 96-bit key of its content. For every key the least and the greatest block are
compared when names are given, so a key that two blocks share is seen, and the
naming starts over with other keys. Hence no identity rests on a hash; a row finds
its identity by its id and a 64-bit hash of its text, which only matters where an
id repeats with other texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, unused


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024) -> DataFrame:
    """(id, hash, level, name) for each distinct id and text; hash is xxhash64 of the text's bytes.

    A null text is empty, and an empty text is one empty block. A null id is an
    id of its own. Rows that repeat an id and its text have one identity.
    """
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    whole = whole.select("id", "bytes", F.xxhash64("bytes").alias("hash"), F.greatest(F.lit(1), F.ceil(F.length("bytes") / block_bytes)).cast("int").alias("n"))
    cut = F.expr(f"transform(sequence(0, n - 1), k -> substring(bytes, k * {block_bytes} + 1, {block_bytes}))")
    blocks = whole.select("id", "hash", "n", F.posexplode(cut).alias("place", "block"))

    salt, names = 0, None
    while names is None:
        key = (F.xxhash64("block", F.lit(salt)).alias("k1"), F.hash("block", F.lit(salt + 1)).alias("k2"))
        found = blocks.select("block", *key).groupBy("k1", "k2").agg(F.min("block").alias("low"), F.max("block").alias("high"))
        found = found.sortWithinPartitions("k1", "k2").select("k1", "k2", F.monotonically_increasing_id().alias("name"), (F.col("low") != F.col("high")).alias("shared"))
        names = saved(found)
        if not names.where("shared").isEmpty():
            salt, names = salt + 2, None

    now = blocks.select("id", "hash", "n", "place", *key).join(names.drop("shared"), ["k1", "k2"]).select("id", "hash", "n", "place", "name")
    now, level, done = saved(now), 0, None
    most = now.agg(F.max("n")).first()[0] or 1
    while True:
        ended = now.where("n = 1").select("id", "hash", F.lit(level).alias("level"), "name").distinct()
        done = ended if done is None else done.union(ended)
        if most <= 1:
            return done
        half = F.floor(F.col("place") / 2).cast("int").alias("place")
        side = lambda odd: F.coalesce(F.max(F.when(F.col("place") % 2 == odd, F.col("name"))), F.lit(-1))
        pairs = now.where("n > 1").groupBy("id", "hash", "n", half).agg(side(0).alias("left"), side(1).alias("right"))
        # the names of pairs that end here and of those that go on come from one numbering
        pairs = saved(pairs.select("id", "hash", F.ceil(F.col("n") / 2).cast("int").alias("n"), "place", "left", "right"))
        found = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
        names = saved(found.select("left", "right", F.monotonically_increasing_id().alias("name")))
        now = saved(pairs.join(names, ["left", "right"]).select("id", "hash", "n", "place", "name"))
        level, most = level + 1, (most + 1) // 2


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Rows with identical texts form a group (null text: empty); the row with the
    largest id stays. group_size counts rows. Null ids lose to any other id and
    stay only in a group that has no other. Rows that repeat an id and its text
    are one document and share its mark. An empty table gives no rows; columns
    other than the two named play no part.
    """
    same = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(same.cast("binary")).alias("hash"), F.sha2(same.cast("binary"), 256).alias("text_sha256"))
    own = identities(docs, id_col, text_col, block_bytes).select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), "level", "name")
    rows = rows.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")))
    rows = saved(rows.select("id", "level", "name", "text_sha256"))
    # written, so that both sides of the join are dealt anew and a hot group can be split
    groups = saved(rows.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    out = rows.join(groups, ["level", "name"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of identical texts, all columns as they were.

    The row of largest id stays, a null id only where there is no other; of rows
    that repeat it with that text any one does.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = identities(docs, id_col, text_col)
    # one (id, hash) for each identity, so that ids that repeat with other texts and null ids stay apart
    kept_id, kept_hash, own_hash = (unused(x, docs.columns) for x in ("_kept_id", "_kept_hash", "_own_hash"))
    keep = own.groupBy("level", "name").agg(F.max("id").alias(kept_id), F.min("hash").alias(kept_hash)).select(kept_id, kept_hash)
    hashed = docs.withColumn(own_hash, F.xxhash64(text(F.col(text_col)).cast("binary")))
    left = hashed.join(keep, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    return left.dropDuplicates([id_col, own_hash]).drop(own_hash)


def op6_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = {
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """
}
