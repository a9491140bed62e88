"""Merkle manifests, vector codes and shards against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospark.llm import common, merkle, sharding, vector_codes
from chronospark.llm.vector_codes import Trees, exact

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, fanout, tampered):
    """{row number: (leaf, subroot, root, proof, folded)} by a tree of lists; rows are tuples of FIELDS."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // fanout * fanout
            out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
            at //= fanout
        return out

    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[r[1]].append(k)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k]))) for g in order}
    trees = {g: tree([leaf(rows[k]) for k in own[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = {}
    for i, g in enumerate(order):
        for at, k in enumerate(own[g]):
            whole = path(trees[g], at) + path(top, i)
            node = leaf(tampered(rows[k]))
            for a, b in whole:
                node = h(a + node + b)
            out[k] = (leaf(rows[k]), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in whole)), node)
    return out


def documents_of(n, seed=1):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "z", *["hot"] * 5, *[f"s{i}" for i in range(30)]]
    rows = [(rng.choice([i, i, i, None, 3]), rng.choice(sources), rng.choice([None, "en", ""]), rng.choice([None, 1, 12]), rng.choice([None, "", "Ab", "É" * 5, "x" * 3000])) for i in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("fanout, n", [(2, 300), (16, 900), (3, 1), (2, 40)])
def test_manifest_by_brute_force(spark, fanout, n):
    rows = documents_of(n)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_of(*[F.col(x) for x in FIELDS[:-1]], F.translate("text", merkle.UPPER, merkle.LOWER)))
    made = merkle.manifest(df, fanout=fanout, other=changed)
    got = Counter(tuple(r) for r in made.checked().collect())
    lower = lambda r: (*r[:-1], r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])) if r[0] is not None and r[0] % 2 == 0 else r
    want = plain_manifest(rows, fanout, lower)
    # rows that are the same may change places
    assert sorted((str(r[0]), *r[1:4], r[5], r[6]) for r in got.elements()) == sorted((str(rows[k][0]), *w[:3], w[4], w[4] == w[2]) for k, w in want.items())
    assert Counter(r[4] for r in got.elements()) == Counter(w[3] for w in want.values())
    assert made.root == want[0][2]
    for r in made.proofs().collect():
        assert merkle.fold(r["leaf"].encode(), [(bytes(p["left"]), bytes(p["right"])) for p in r["path"]]).decode() == made.root


def test_manifest_edges(edges, empty):
    got = merkle.manifest(edges).checked()
    assert got.count() == edges.count() and got.where("NOT verified OR root IS NULL").isEmpty()
    assert merkle.manifest(empty).checked().count() == 0 and merkle.manifest(empty).root is None
    assert merkle.manifest(edges.repartition(7)).root == merkle.manifest(edges.coalesce(1)).root


def test_manifest_of_all_documents(spark):
    from support import DATA

    rows = [tuple(r[x] for x in FIELDS) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    import zlib

    lower = lambda r: (*r[:-1], r[4] and "".join(c.lower() if c.isascii() else c for c in r[4])) if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
    want = plain_manifest(rows, 16, lower)
    got = merkle.op11_merkle(spark, DATA).collect()
    assert {tuple(r) for r in got} == {(rows[k][0], *w, w[4] == w[2]) for k, w in want.items()} and len(got) == len(rows)


def plain_codes(rows, parts, entries, rounds, scale=256):
    """(codes, errors, books) by all distances, in Python's integers; rows are (id, label, vector), kept ones."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = max(1, -(-max(len(r[2]) for r in kept) // parts))
    cut = lambda v: [[math.floor(scale * x) for x in [*v, *[0.0] * (width * parts - len(v))][p * width : (p + 1) * width]] for p in range(parts)]
    points = [cut(r[2]) for r in kept]
    firsts = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    books = [[points[i][p] for i in firsts] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(v, p) for p in range(parts)] for v in points]
        new = [list(b) for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(points, codes) if c[p] == e]
                if own:
                    new[p][e] = [sum(x) // len(own) for x in zip(*own)]
        books = new
    codes = [[near(v, p) for p in range(parts)] for v in points]
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(points, codes)]
    return Counter((r[0], r[1], *c, min(e, vector_codes.LONG)) for r, c, e in zip(kept, codes, errors)), books


def vectors_of(n, size, seed, big=1.0):
    rng = random.Random(seed)
    grid = lambda: rng.randint(-8, 8) / 256 * big
    rows = [(i if i % 7 else rng.choice([None, 3, i]), rng.choice([None, 1, 2]), [grid() for _ in range(size)]) for i in range(n)]
    rows += [(n + i, 5, list(rows[0][2])) for i in range(n // 2)]  # a hot vector
    rows += [(9, 1, None), (8, 2, [None] * size), (7, 1, [float("nan")] + [0.0] * (size - 1)), (6, None, [float("inf")] * size), (5, 1, [0.5]), (4, 1, []), (2, 2, [1.0] * (size + 1))]
    return rows


@pytest.mark.parametrize("n, size, parts, entries, big", [(150, 8, 4, 16, 1.0), (60, 6, 2, 64, 1.0), (40, 4, 4, 5, 1e16), (30, 3, 16, 8, 100.0)])
def test_codes_by_brute_force(spark, n, size, parts, entries, big):
    rows = vectors_of(n, size, n, big)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    found, books = vector_codes.vector_codes(df, parts=parts, entries=entries)
    want, want_books = plain_codes(rows, parts, entries, 2)
    assert books.tolist() == want_books
    assert Counter((r["id"], r["label"], *r["code"], r["error"]) for r in found.collect()) == want


def test_codes_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code int, id string, tree int")
    assert vector_codes.vector_codes(none)[0].count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(bad)[0].count() == 0
    other = spark.createDataFrame([(1, [0.5, 1.0], "a"), (1, [0.5, 1.0], "a"), (2, [3.4e38, -3.4e38], None)], "vec_id long, embedding array<float>, label string")
    assert sorted(r["error"] for r in vector_codes.vector_codes(other, parts=2)[0].collect()) == [0, 0, 0]


@pytest.mark.parametrize("n", [1, 15, 17, 700])
def test_filtering_prunes_and_is_exact(n):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-30, 30, (n, 8)).astype(np.int16)
    tree = Trees.unpacked(Trees.of(vectors, 2).packed())
    books = rng.integers(-30, 30, (2, 9, 4))
    books[:, 5] = books[:, 2]  # equal entries: the lower one is taken
    codes, error = tree.codes(books)
    parts = vectors.reshape(n, 2, 1, 4).astype(np.int64)
    d = ((parts - books[None]) ** 2).sum(3)
    assert (codes == d.argmin(2)).all() and (error == d.min(2).sum(1)).all()
    sums, counts = tree.totals(books)
    for p in range(2):
        for e in range(9):
            own = parts[d.argmin(2)[:, p] == e, p, 0]
            assert counts[p, e] == len(own) and (sums[p, e] == own.sum(0)).all()
    # points near one entry are taken whole
    far = np.zeros((1, 2, 4), np.int64)
    far[0, 1] = 1000
    subtrees, _, _, single, _ = tree.filtered(0, far[0], np.int64)
    assert len(subtrees) == 1 and len(single) == 0
    assert exact(tree.points, books) is np.int64 and exact(tree.points, books * 2**40) is object


def plain_shards(rows, shards, seed):
    """{row number: (shard, slot)}; rows are (order of reading, source, hash, phase)."""
    groups = defaultdict(list)
    for k, (row, source, mixed, _) in enumerate(rows):
        groups["" if source is None else "=" + source].append((mixed, row, k))
    placed = []
    for g, own in groups.items():
        for rank, (_, _, k) in enumerate(sorted(own)):
            placed.append(((rank + rows[k][3]) / len(own), g, rank, k))
    n, out = len(rows), {}
    for at, (*_, k) in enumerate(sorted(placed)):
        shard = max(j for j in range(shards) if at >= n * j // shards)
        out[k] = (shard, at - n * shard // shards)
    return out


@pytest.mark.parametrize("n, shards", [(700, 16), (9, 16), (50, 1)])
def test_shards_by_brute_force(spark, n, shards):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "", *["hot"] * 6, *[f"s{k}" for k in range(8)]]), rng.choice("abc")) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, shard string").repartition(5)
    got = sharding.interleaved(df.withColumn("_rank", F.lit(1)), shards, keys=["doc_id"]).collect()
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    phase = (F.pmod(F.xxhash64(F.lit(17), F.lit("phase"), group), F.lit(sharding.PHASES)) + 0.5) / sharding.PHASES
    read = df.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id").alias("mixed"), phase.alias("phase")).collect()
    want = plain_shards([(k, r["source"], r["mixed"], r["phase"]) for k, r in enumerate(read)], shards, 17)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == {r["doc_id"]: want[k] for k, r in enumerate(read)}
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == n and max(sizes.values()) - min(sizes.get(j, 0) for j in range(shards)) <= 1
    for source, total in Counter(r["source"] for r in got).items():
        for shard in range(shards):
            own = sum(r["source"] == source and r["shard"] == shard for r in got)
            assert abs(own - total / shards) <= 3


def test_shards_edges(spark, edges, empty, tmp_path):
    got = sharding.interleaved(edges.withColumn("slot", F.lit("x")), 4)
    assert got.count() == edges.count() and sorted(Counter(r["shard"] for r in got.collect()).values()) == [3, 3, 3, 4]
    assert set(edges.columns) < set(got.columns) and sharding.interleaved(empty).count() == 0
    same = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"))
    assert sorted(r["count"] for r in sharding.interleaved(same, 3).groupBy("shard").count().collect()) == [333, 333, 334]
    sharding.write_shards(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 4 and back.count() == edges.count()


def test_shards_do_not_depend_on_the_partitioning(spark):
    from support import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "n_chars")
    one, many = (sharding.interleaved(docs.repartition(k), keys=["doc_id"]).select("doc_id", "shard", "slot") for k in (1, 9))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}


def test_ranked(spark):
    rows = [("a" if i % 3 else "b", i * 7919 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, _n int").repartition(6)
    got = common.ranked(df, "g", ["x", "_n"], "rank", "size").collect()
    for g in "ab":
        own = sorted((r["x"], r["_n"], r["rank"], r["size"]) for r in got if r["g"] == g)
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}
