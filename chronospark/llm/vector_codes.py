"""Codes of vectors by the filtering form of Lloyd's algorithm.

A vector is cut into parts, and each part's position has a codebook of entries.
Every partition builds kd-trees over its parts, one a position, whose nodes keep the
box, sum and count of what lies below. A round sends the codebooks down the trees:
of a node's candidate entries, one is nearest to the box's middle, and another goes
if no place of the box is nearer to it. Where one candidate is left, the whole
subtree is its, by the cached sum and count; a leaf's points are compared with the
candidates that are left. Ties go to the lower entry, exactly.

All numbers are integers: components are floor(scale * x). Trees are built once, over
chunks of vectors, and written; each round is a map over them and a sum of one row
a component, entry and task. Only codebooks, whose size is fixed, reach the driver.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components that one set of trees covers, and points in a leaf, at most.
CHUNK, LEAF = 1 << 18, 16
#: Greatest size of a component, and of an error; beyond it they are held there.
MOST, LONG = 1 << 61, (1 << 63) - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in the smallest type that holds all."""
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)
    most = max(-int(whole.min(initial=0)), int(whole.max(initial=0)))
    return whole.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def exact(points: np.ndarray, books: np.ndarray) -> type:
    """64-bit integers where squared distances of whole vectors and keys of them fit; else Python's."""
    most = max(abs(int(f(initial=0))) for x in (points, books) for f in (x.min, x.max))
    return np.int64 if (4 * most) ** 2 * points.shape[0] * points.shape[2] * max(books.shape[1], 1) < 1 << 62 else object


def halves(n: int) -> list[np.ndarray]:
    """Borders of the nodes on each level of a tree over n points, halved by count; the last level's nodes are leaves."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        b = levels[-1]
        levels.append(np.sort(np.r_[b, (b[:-1] + b[1:]) // 2]))
    return levels


def planted(points: np.ndarray) -> np.ndarray:
    """The order of points (vector, component) in a kd-tree's leaves: each node is halved across its widest side."""
    points, order = points.astype(np.int64), np.arange(len(points), dtype=np.int32)
    for borders in halves(len(points))[:-1]:
        now = points[order]
        side = (np.maximum.reduceat(now, borders[:-1]) - np.minimum.reduceat(now, borders[:-1])).argmax(1)
        node = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        order = order[np.lexsort((now[np.arange(len(now)), side[node]], node))]
    return order


class Trees:
    """kd-trees over the parts of some vectors: points (part, vector, component) in each tree's order, and its nodes' boxes and sums."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.arrays = arrays

    @staticmethod
    def of(vectors: np.ndarray, parts: int) -> Trees:
        points = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2)
        order = np.stack([planted(p) for p in points])
        points = np.take_along_axis(points, order[:, :, None].astype(np.int64), 1)
        firsts = [b[:-1] for b in halves(len(vectors))]
        over = lambda f, x: np.concatenate([f.reduceat(x, b, axis=1) for b in firsts], 1)
        # sums of up to so many components of size MOST don't fit
        sums = points.astype(np.int64 if max(abs(int(points.min())), abs(int(points.max()))) < 1 << 44 else object)
        return Trees(points=points, order=order, low=over(np.minimum, points), high=over(np.maximum, points), **({"sums": over(np.add, sums)} if sums.dtype != object else {}))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Trees:
        return Trees(**np.load(io.BytesIO(data)))

    def filtered(self, part: int, book: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(subtrees, their runs of points, their entries, single points, their entries): each point is in one of them."""
        points, low, high, book = (x.astype(kind) for x in (self.points[part], self.low[part], self.high[part], book))
        levels, k = halves(len(points)), len(book)
        nodes, left, first, found = np.array([0]), np.ones((1, k), bool), 0, []
        for depth, borders in enumerate(levels):
            if not len(nodes):
                break
            a, z = low[first + nodes][:, None], high[first + nodes][:, None]
            off = 2 * book - (a + z)
            middle = (off * off).sum(2)
            best = np.where(left, middle, middle.max() + 1).argmin(1)
            star = book[best][:, None]
            corner = np.where(book > star, z, a)  # where in the box an entry does best against the one nearest to the middle
            gain = ((corner - book) ** 2).sum(2) - ((corner - star) ** 2).sum(2)
            left &= (gain < 0) | ((gain == 0) & (np.arange(k) < best[:, None]))
            left[np.arange(len(nodes)), best] = True
            alone = left.sum(1) == 1
            found.append(np.stack([first + nodes[alone], borders[nodes[alone]], borders[nodes[alone] + 1], best[alone]]))
            nodes, left, first = nodes[~alone], left[~alone], first + len(borders) - 1
            if depth + 1 < len(levels):
                nodes, left = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(left, 2, axis=0)
        trees, start, end, entries = np.concatenate(found, 1).astype(np.int64)
        sizes = levels[-1][nodes + 1] - levels[-1][nodes]
        at = np.repeat(levels[-1][nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pair, entry = np.nonzero(np.repeat(left, sizes, axis=0))
        d = ((points[at[pair]] - book[entry]) ** 2).sum(1)
        chosen = np.minimum.reduceat(d * k + entry, np.flatnonzero(np.diff(pair, prepend=-1))) % k if len(at) else at
        return trees, np.stack([start, end]), entries, at, chosen.astype(np.int64)

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the parts nearest to each entry: sums (part, entry, component) and counts."""
        kind = exact(self.points, books)
        sums, counts = np.zeros(books.shape, kind), np.zeros(books.shape[:2], np.int64)
        for part, book in enumerate(books):
            trees, (start, end), entries, at, chosen = self.filtered(part, book, kind)
            if "sums" in self.arrays:
                np.add.at(sums[part], entries, self.sums[part][trees].astype(kind))
            else:
                for a, z, e in zip(start, end, entries):
                    sums[part, e] += self.points[part, a:z].astype(object).sum(0)
            np.add.at(counts[part], entries, end - start)
            np.add.at(sums[part], chosen, self.points[part][at].astype(kind))
            np.add.at(counts[part], chosen, 1)
        return sums, counts

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector, in the order given: its entries (vector, part), and its error."""
        kind, (parts, n, _) = exact(self.points, books), self.points.shape
        out, error = np.zeros((n, parts), np.uint8), np.zeros(n, kind)
        for part, book in enumerate(books):
            _, (start, end), entries, at, chosen = self.filtered(part, book, kind)
            own = np.zeros(n, np.int64)
            own[at] = chosen
            for a, z, e in zip(start, end, entries):
                own[a:z] = e
            out[self.order[part], part] = own
            error[self.order[part]] += ((self.points[part].astype(kind) - book.astype(kind)[own]) ** 2).sum(1)
        return out, error


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            piece = batch.slice(start, rows - n)
            held, n, start = [*held, piece], n + piece.num_rows, start + piece.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one width, shorter ones with zeros behind."""
    lists = lists.combine_chunks()
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code array<int>, error), codebooks as (part, entry, component)).

    Rows go whose vector is null or holds a null, NaN or infinity. Vectors of unlike
    lengths, or of lengths that parts don't divide, count as having zeros behind, up to
    the longest; an empty vector is all zeros. Codebooks start with the vectors of the
    smallest ids (nulls last; of equal ids the lesser vector first), fewer than entries
    if there are fewer rows, none of an empty table. Repeated rows count each. Components
    over 2^61 and errors over 2^63 - 1 are held there. Columns not named play no part.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    vector = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    known = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = rows.where(F.col("vector").isNotNull() & known)
    width = max(1, -(-(kept.agg(F.max(F.size("vector"))).first()[0] or 1) // parts)) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.zeros((len(first), width))
    for i, r in enumerate(first):
        start[i, : len(r["vector"])] = r["vector"]
    books = integers(start, scale).astype(np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)

    def planted_chunks(batches):
        for t in chunks(batches, max(1, CHUNK // width)):
            tree = Trees.of(integers(matrix(t["vector"], width), scale), parts).packed()
            lists = lambda c: pa.array([t[c].to_pylist()], pa.list_(t.schema.field(c).type))  # noqa: E731, B023
            yield pa.record_batch({"ids": lists("id"), "labels": lists("label"), "tree": pa.array([tree], pa.binary())})

    ids, labels = (kept.schema[x].dataType.simpleString() for x in ("id", "label"))
    forest = saved(kept.mapInArrow(planted_chunks, f"ids array<{ids}>, labels array<{labels}>, tree binary"))
    for _ in range(rounds):
        books = moved(forest, books)

    def coded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes, error = Trees.unpacked(batch["tree"][i].as_py()).codes(books)
                n = len(error)
                lists = pa.ListArray.from_arrays(np.arange(0, parts * n + 1, parts, dtype=np.int32), codes.astype(np.int32).ravel())
                yield pa.record_batch({"id": batch["ids"][i].values, "label": batch["labels"][i].values, "code": lists, "error": pa.array([min(int(x), LONG) for x in error], pa.int64())})

    return forest.mapInArrow(coded, f"id {ids}, label {labels}, code array<int>, error long"), books


def moved(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: entries at the floor of their parts' means, unused ones as they were."""

    def task(batches):
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for data in batch["tree"]:
                s, n = Trees.unpacked(data.as_py()).totals(books)
                sums, counts = sums + s, counts + n
        part, entry = np.nonzero(counts)
        width = books.shape[2]
        each = lambda x: pa.array(np.repeat(x, width).astype(np.int32))
        total = pa.array([Decimal(int(x)) for x in sums[part, entry].ravel()], pa.decimal128(38, 0))
        yield pa.record_batch({"part": each(part), "entry": each(entry), "component": pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))), "total": total, "n": pa.array(np.repeat(counts[part, entry], width))})

    made = forest.mapInArrow(task, "part int, entry int, component int, total decimal(38,0), n long")
    out = books.copy()
    for r in made.groupBy("part", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"], r["entry"], r["component"]] = int(r["total"]) // r["n"]
    return out


def op12_vector_codes(spark, sf_dir):
    found, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books_sha256 = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    found = saved(found)
    # written, so that both sides of the join are dealt anew and a hot label can be split
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LONG)).cast("decimal(38,0)")).cast("long")
    sums = saved(found.groupBy(F.col("label").alias("of")).agg(whole.alias("label_error")))
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books_sha256).alias("codebooks_sha256"), "label")


def _sql() -> str:
    """Lloyd's two rounds by plain nearest entries, in SQL."""
    near = lambda books: f"""
        SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
            SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d
            FROM cells c JOIN {books} b USING (part, place) GROUP BY ALL) GROUP BY ALL"""  # noqa: E731
    move = lambda old, near: f"""
        SELECT b.part, b.place, b.entry, coalesce(m.x, b.x) AS x FROM {old} b LEFT JOIN (
            SELECT c.part, c.place, n.entry, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x
            FROM cells c JOIN {near} n USING (vec_id, part) GROUP BY ALL) m USING (part, place, entry)"""  # noqa: E731
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding AS e FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        flat AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS k, unnest(e) AS v, len(e) // 16 AS w FROM kept),
        cells AS MATERIALIZED (SELECT vec_id, k // w AS part, k % w AS place, floor(256 * v::DOUBLE)::BIGINT AS x FROM flat),
        firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
        books0 AS MATERIALIZED (SELECT part, place, entry, x FROM cells JOIN firsts USING (vec_id)),
        near0 AS MATERIALIZED ({near("books0")}),
        books1 AS MATERIALIZED ({move("books0", "near0")}),
        near1 AS MATERIALIZED ({near("books1")}),
        books2 AS MATERIALIZED ({move("books1", "near1")}),
        near2 AS MATERIALIZED ({near("books2")}),
        sha AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM books2),
        codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256, label
        FROM codes JOIN kept USING (vec_id) CROSS JOIN sha
    """


ORACLE = {"op12_vector_codes": _sql()}
