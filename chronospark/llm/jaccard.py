"""N-gram Jaccard join by PartEnum signatures.

A document is a set of word shingles. Sets whose sizes fall in a band can differ
in at most k members if they are similar enough. The domain of members is cut
into groups of partitions, so many groups that two such sets differ by at most
d members in some group; there, all but d of its partitions are alike. Each
choice of that many partitions of each group is a signature, so that similar
sets share at least one. Sets that share a signature are candidates. Families of
candidates are compared exactly: small ones by counting common members with
matrix products; large ones, which unlike sets may chain together, by bands of
sizes that a link can span, where only sets are compared that share one of their
rarest members and may differ in few enough (connected). A set travels once or
twice, whatever its family; only groups of over GROUP bytes are compared block
by block. Only links that join classes are put out.

How many partitions a group has depends on the band (SCHEMES), so that a
signature holds several members: one that holds hardly any is shared by unlike
sets. In bands of sets of more than 63 members, choices with no member (over 255:
with less than three) are therefore left out. Linked sets of such sizes agree in
about two in five of their groups even at the threshold, 20 groups or more from
256 members on, so the chance that every shared signature is left out is under
1 in 10,000 there at the threshold itself and falls steeply above it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import components, documents, key_filter, may_hold, saved, unused
from .textnum import Words, distinct, mix, runs

_U = np.uint64
BITS = 1 << 24  # of the broadcast filter of candidate sets, 2 MB
BLOCK = 96  # sets that are compared side by side
GROUP = 16 << 20  # bytes of sets that one task holds at once; of two such blocks each pair
FEW = 12  # sets that share a rare member: so many at most are compared pair by pair, in more what is connected isn't compared again


class Bands:
    """Bands of set sizes for links of 100 * intersection >= percent * union."""

    def __init__(self, percent: int, widen: float = 1.35):
        self.percent, self.low, self.high = percent, [1], []
        while self.high[-1:] < [1 << 40]:
            self.high.append(max(self.low[-1], int(self.low[-1] * widen)))
            self.low.append(self.high[-1] + 1)
        self.low, self.high = np.array(self.low[:-1]), np.array(self.high)
        #: most members that linked sets of sizes up to high can differ in
        self.differ = 2 * self.high * (100 - percent) // (100 + percent)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, size)

    def pairs(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, bands): each size's own band, and those after it where a larger partner may be; bands of equal sets only are left out."""
        own = self.of(size)
        rows, bands, step = [np.arange(len(size))], [own], 1
        while len(up := np.flatnonzero(100 * size >= self.percent * self.low[own + step])):
            rows.append(up)
            bands.append(own[up] + step)
            step += 1
        rows, bands = np.concatenate(rows), np.concatenate(bands)
        keep = (size[rows] > 0) & (self.differ[bands] > 0)
        return rows[keep], bands[keep]


def shingle_sets(column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes and their borders; fewer words than a shingle are one, and no words none."""
    return distinct(*runs(Words(column), shingle, short=True))


def fingerprints(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A hash of each set, as a signed integer."""
    total = np.append(_U(0), np.cumsum(mix(values ^ _U(0x5851F42D4C957F2D)), dtype=_U))
    return mix((total[borders[1:]] - total[borders[:-1]]) ^ mix(np.diff(borders).astype(_U))).view(np.int64)


#: (sets up to so many members, differences left in a group, partitions of a group, members a chosen subset must have)
SCHEMES = [(63, 4, 8, 0), (255, 2, 5, 1), (1 << 62, 1, 3, 3)]


def signatures(values: np.ndarray, borders: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all signatures of a batch of sets."""
    size = np.diff(borders)
    rows, band = bands.pairs(size)
    out_rows, out = [np.empty(0, np.int64)], [np.empty(0, _U)]
    low = 0
    for high, spare, parts, least in SCHEMES:
        some = (bands.high[band] > low) & (bands.high[band] <= high)
        low = high
        if some.any():
            r, s = _enumerated(values, borders, rows[some], band[some], bands.differ[band[some]] // (spare + 1) + 1, spare, parts, least)
            out_rows.append(r)
            out.append(s)
    return np.concatenate(out_rows), np.concatenate(out)


def _enumerated(values, borders, rows, band, groups, spare, parts, least):
    """Signatures of rows in bands: all subsets of parts - spare of each group's partitions, if they have at least least members."""
    base = np.append(0, np.cumsum(parts * groups))
    count = np.diff(borders)[rows]
    member = np.repeat(borders[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    v = values[member]
    part = (mix(v + _U(0x2545F4914F6CDD1D)) % np.repeat(parts * groups, count).astype(_U)).astype(np.int64)
    place = np.repeat(base[:-1], count) + part
    held = np.zeros(base[-1], _U)
    np.add.at(held, place, mix(v ^ _U(0x9FB21C651E98DF25)))
    held = held.reshape(-1, parts)
    many = np.bincount(place, minlength=base[-1]).reshape(-1, parts)
    at = np.repeat(np.arange(len(rows)), groups)
    group = np.arange(len(at)) - np.repeat(np.cumsum(groups) - groups, groups)
    name = mix(band[at].astype(_U) * _U(1 << 32) + group.astype(_U))
    out_rows, out = [], []
    for n, subset in enumerate(combinations(range(parts), parts - spare)):
        made = name + _U(n)
        for p in subset:
            made = mix(made) ^ held[:, p]
        keep = many[:, subset].sum(axis=1) >= least
        out_rows.append(rows[at[keep]])
        out.append(mix(made[keep]))
    return np.concatenate(out_rows), np.concatenate(out)


def linked(values: list[np.ndarray], percent: int, first: int | None = None) -> np.ndarray:
    """Pairs (i, j) of sets with 100 * intersection >= percent * union; first: only pairs across that border."""
    sizes = np.array([len(v) for v in values])
    members, back, often = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(values)), sizes)
    number = np.cumsum(often > 1) - 1  # only members of two sets or more count
    shared = often[back] > 1
    owner, column = owner[shared], number[back[shared]]
    a, b = (slice(None), slice(None)) if first is None else (slice(0, first), slice(first, None))
    common = np.zeros((len(values), len(values)), np.float32)[a, b]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    cut = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 8192, 8192))
    for k in range(len(cut) - 1):
        x = np.zeros((len(values), 8192), np.float32)
        x[owner[cut[k] : cut[k + 1]], column[cut[k] : cut[k + 1]] - 8192 * k] = 1
        common += x[a] @ x[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common
    i, j = np.nonzero(100 * common.astype(np.float64) >= percent * union)
    if first is None:
        return np.column_stack([i, j])[i < j]
    return np.column_stack([i, j + first])


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs enough to connect what pairs connect."""
    root, kept = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def connected(values: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs enough to connect what the pairs of linked() connect, for many sets; first: only pairs across that border.

    Linked sets share one of their rarest members, of each so many that a partner
    can't lack them all. Of sets that share one, those are compared whose sizes, and
    bits that are odd in how many members they stand for, differ by no more than
    links may, and that nothing connects so far.
    """
    m, size = len(values), np.array([len(v) for v in values])
    flat, owner, borders = np.concatenate(values).view(_U), np.repeat(np.arange(m), size), np.append(0, np.cumsum(size))
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    rank, often = rank[number], np.sort(often)
    rank = rank[np.argsort(owner * len(often) + rank)]
    rare = (np.arange(len(flat)) - np.repeat(borders[:-1], size) < (size + percent * -size // 100 + 1)[owner]) & (often[rank] > 1)
    key, own = rank[rare], owner[rare]
    turn = np.lexsort((size[own], key))
    key, own = key[turn], own[turn]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    many = np.diff(np.append(start, len(key)))
    bit = mix(flat)
    odd = np.zeros((m, 8), _U)
    np.bitwise_xor.at(odd, (owner, (bit >> _U(61)).astype(np.int64)), _U(1) << ((bit >> _U(55)) & _U(63)))
    seen, root, kept = np.zeros(len(often), bool), list(range(m)), []

    def near(i, j):
        """Whether sets may be linked, by what is known of them at once."""
        a, b = size[i], size[j]
        ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        ok &= (100 + percent) * np.bitwise_count(odd[i] ^ odd[j]).sum(axis=-1).astype(np.int64) <= (100 - percent) * (a + b)
        return ok if first is None else ok & ((i < first) != (j < first))

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        seen[number[borders[i] : borders[i + 1]]] = True
        count = size[others]
        begin = np.cumsum(count) - count
        common = np.add.reduceat(seen[number[np.repeat(borders[others] - begin, count) + np.arange(count.sum())]].astype(np.int64), begin)
        seen[number[borders[i] : borders[i + 1]]] = False
        return 100 * common >= percent * (size[i] + count - common)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((min(i, j), max(i, j)))

    some, at, codes = np.repeat(many, many), np.arange(len(own)) - np.repeat(start, many), [np.empty(0, np.int64)]
    for step in range(1, FEW):
        x = np.flatnonzero((some <= FEW) & (at + step < some))
        for part in np.array_split(x, -(-len(x) // 100_000) or 1):
            i, j = own[part], own[part + step]
            ok = near(i, j)
            codes.append(np.minimum(i, j)[ok] * m + np.maximum(i, j)[ok])
    codes = np.unique(np.concatenate(codes))
    left, right = codes // m, codes % m
    edges = np.flatnonzero(np.append(True, left[1:] != left[:-1])[: len(left)])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(left)]):
        i, others = int(left[a]), np.array([j for j in right[a:b].tolist() if find(j) != find(int(left[a]))], np.int64)
        for j in others[alike(i, others)].tolist() if len(others) else []:
            join(i, j)
    for k in np.flatnonzero(many > FEW).tolist():
        sets = own[start[k] : start[k] + many[k]]
        part, sizes = np.array([find(x) for x in sets.tolist()]), size[sets]
        last = np.searchsorted(sizes, 100 * sizes // percent, "right")
        for n, i in enumerate(sets.tolist()):
            others = n + 1 + np.flatnonzero(part[n + 1 : last[n]] != part[n])
            others = others[near(i, sets[others])] if len(others) else others
            others = others[alike(i, sets[others])] if len(others) else others
            if len(others):
                for j in sets[others].tolist():
                    join(i, j)
                part[np.isin(part, part[others])] = part[n]
            if (n == 0 or len(others)) and (part == part[0]).all():
                break
    return kept


def links(values: list[np.ndarray], percent: int, first: int | None = None) -> list[tuple[int, int]]:
    """Pairs enough to connect what is linked: a few sets by matrix products, many by rare members."""
    return forest(len(values), linked(values, percent, first)) if len(values) <= BLOCK else connected(values, percent, first)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, hash_col: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs; with hash_col, also xxhash64 of its text.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set has
    all runs of shingle words, or all words as one if they are fewer. Rows link
    when 100 * intersection >= percent * union, and component_id is the least id
    reachable by links, a row's own included. Rows without words or text (null)
    have no shingles, link with nothing and keep their own id. Rows that repeat
    an id count each. A null id reaches others as any row does but names a
    component only where there is no other. An empty table gives no rows; other
    columns play no part.
    """
    spark = docs.sparkSession
    bands = Bands(percent)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    id_kind = rows.schema["id"].dataType.simpleString()
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def describe(batches):
        for big in batches:
            for batch in slices(big):
                values, borders = shingle_sets(batch.column(2), shingle)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(borders)), pa.array(fingerprints(values, borders))], ["id", "hash", "n", "set"])

    def sign(batches):
        seen: set[int] = set()
        for big in batches:
            for batch in slices(big):
                values, borders = shingle_sets(batch.column(0), shingle)
                prints = fingerprints(values, borders)
                row, signature = signatures(values, borders, bands)
                # copies within a task are put out once
                fresh = np.zeros(len(prints), bool)
                for i, f in enumerate(prints.tolist()):
                    if f not in seen:
                        seen.add(f)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                keep = fresh[row]
                row, signature = row[keep], signature[keep]
                to = (signature % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                pairs = np.column_stack([signature[order].view(np.int64), prints[row[order]]])
                some, at = np.unique(to[order], return_index=True)
                cut = [*at.tolist(), len(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([pairs[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["bucket", "pairs"])

    def stars(found: pd.DataFrame) -> pd.DataFrame:
        """Each set that shares a signature with another, and the least set of that signature."""
        pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found["pairs"]])
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        signature, own = pairs[order, 0], pairs[order, 1]
        start = np.append(True, signature[1:] != signature[:-1])
        least = own[np.flatnonzero(start)[np.cumsum(start) - 1]]
        edges = np.unique(np.column_stack([least, own])[own != least], axis=0)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    sets = saved(rows.mapInArrow(describe, f"id {id_kind}, hash long, n long, set long"))
    edges = rows.select("text").mapInArrow(sign, "bucket long, pairs binary").groupBy("bucket").applyInPandas(stars, "a long, b long").distinct()
    families = components(edges).withColumnsRenamed({"node": "set", "component": "family"})
    families = saved(families)
    sized = sets.groupBy("set").agg(F.first("n").alias("n")).join(families, "set")
    sized = sized.join(sized.groupBy("family").agg(F.count("*").alias("rows")), "family").select("set", "family", "n", (F.col("rows") > BLOCK).alias("large"))

    def place(batches):
        """Sets of a large family by the bands of sizes in which they may meet another."""
        for batch in batches:
            large, n = batch.column(3).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            row, band = bands.pairs(np.where(large, n, 0))
            row, band = np.append(row, np.flatnonzero(~large)), np.append(band, np.full(int((~large).sum()), -1))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(row)) for i in range(3)], pa.array(band, pa.int64())], ["set", "family", "n", "band"])

    placed = saved(sized.mapInArrow(place, "set long, family long, n long, band long"))
    groups = placed.groupBy("family", "band").agg(F.count("*").alias("rows"), F.ceil(8 * F.sum("n") / GROUP).cast("int").alias("blocks")).where("rows > 1").drop("rows")

    # a filter of fixed size spares other sets the way to the join; the join is exact
    shared = spark.sparkContext.broadcast(key_filter(families.select(F.col("set").alias("key")), BITS))

    def with_members(batches):
        seen: set[int] = set()
        for big in batches:
            for batch in slices(big):
                values, borders = shingle_sets(batch.column(0), shingle)
                prints = fingerprints(values, borders)
                some = np.flatnonzero(may_hold(shared.value, prints) & (np.diff(borders) > 0)).tolist()
                some = [i for i in some if (f := int(prints[i])) not in seen and not seen.add(f)]
                if len(seen) > 200_000:
                    seen.clear()
                data = pa.array([values[borders[i] : borders[i + 1]].tobytes() for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(prints[some], pa.int64()), data], ["set", "data"])

    members = rows.select("text").mapInArrow(with_members, "set long, data binary").join(placed.join(groups, ["family", "band"]), "set")
    members = members.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("set", "data", "family", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def verify(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.drop_duplicates("set").sort_values(["own", "set"])
        values = [np.frombuffer(x, _U) for x in found["data"]]
        first = None if key[2] == key[3] else int((found["own"] == key[2]).sum())
        if len(values) < 2 or first in (0, len(values)):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        name = found["set"].to_numpy()
        kept = links(values, percent, first)
        return pd.DataFrame({"a": [name[i] for i, _ in kept], "b": [name[j] for _, j in kept]}, dtype="int64")

    # by number, as what few bytes hold may take long to compare
    key = ["family", "band", "low", "high"]
    alike = members.repartition(buckets // 4, *key).groupBy(*key).applyInPandas(verify, "a long, b long")
    roots = components(alike).withColumnsRenamed({"node": "set", "component": "root"})
    named = sets.where("n > 0").groupBy("set").agg(F.min("id").alias("least")).join(roots, "set", "left")
    named = saved(named.select("set", "least", F.coalesce("root", "set").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # written, so that a set with very many rows can be split in the last join
    named = saved(named.join(least, "root").select("set", "component_id"))
    out = sets.withColumn("set", F.when(F.col("n") > 0, F.col("set"))).join(named, "set", "left")
    extra = [F.col("hash").alias(hash_col)] if hash_col else []
    return out.select(F.col("id").alias(id_col), *extra, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with the row of least id of each component, all columns as they were.

    Rows that repeat its id and text stay with it. Rows with a null id stay only
    if nothing with an id is in their component.
    """
    kept_id, kept_hash = (unused(x, docs.columns) for x in ("_kept_id", "_kept_hash"))
    least = similar_classes(docs, id_col, text_col, shingle, percent, kept_hash)
    keep = least.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(kept_id), kept_hash).distinct()
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col(kept_id)) & (own == F.col(kept_hash)), "left_semi")


def op5_jaccard(spark, sf_dir):
    return similar_classes(documents(spark, sf_dir))


ORACLE = {
    "op5_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ),
        s AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
                WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingle
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = w.doc_id
    """
}
