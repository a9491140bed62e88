"""A Merkle manifest of a table: a tree for each source, and one over the sources' roots.

A leaf is the digest of a row's fields; digests are lowercase hex of SHA-256, and
an inner node is the digest of its children's texts in a row. Leaves are numbered
within their source and cut into aligned blocks of fanout ** HEIGHT, so a block's
nodes can be raised HEIGHT levels by themselves. In a block the leaves are one
contiguous numpy matrix of 64-byte rows: it is reshaped by fanout, its rows are
hashed, and the digests are the next level's matrix. Blocks' top nodes are leaves of
the next stage, until one is left of each source.

Proofs come down the same way: a block's path to the root is joined with its nodes,
whose siblings are slices of the level matrices by index arithmetic. A source of any
size is many blocks, and no block grows with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.series import with_rid
from .common import documents, ranked, saved

#: Levels that a block is raised at once.
HEIGHT = 3
HEX = 64
_PATH = "array<struct<left:binary,right:binary>>"


def digest(text: bytes) -> bytes:
    """Lowercase hex of SHA-256, as bytes."""
    return hashlib.sha256(text).hexdigest().encode()


def leaf_of(*fields: Column) -> Column:
    """The digest of a row: of each field its byte count, a colon and its text, or - for null, all in a row."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def depth_of(n: int, fanout: int) -> int:
    """Levels from n nodes to one."""
    depth = 0
    while n > 1:
        n, depth = -(-n // fanout), depth + 1
    return depth


def matrices(leaves: bytes, depth: int, fanout: int) -> list[np.ndarray]:
    """Level by level the digests as rows of 64 bytes; the first level is leaves, digests in a row."""
    levels = [np.frombuffer(leaves, np.uint8).reshape(-1, HEX)]
    for _ in range(depth):
        now = levels[-1]
        whole = len(now) // fanout * fanout
        runs = [r.data for r in now[:whole].reshape(-1, fanout * HEX)] + ([now[whole:].reshape(-1).data] if whole < len(now) else [])
        levels.append(np.frombuffer(b"".join(map(digest, runs)), np.uint8).reshape(-1, HEX))
    return levels


def siblings(levels: list[np.ndarray], at: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """Of the node at a place of the first level: its run's nodes on the left and right, for each level below the top."""
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append((level[first:at].tobytes(), level[at + 1 : first + fanout].tobytes()))
        at //= fanout
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _levels(nodes: pa.Table, fanout: int) -> tuple[pa.Table, list[np.ndarray]]:
    """A block's nodes in order, and its matrices."""
    nodes = nodes.sort_by("place")
    depth = min(HEIGHT, depth_of(nodes["n"][0].as_py(), fanout))
    return nodes, matrices(b"".join(nodes["digest"].to_pylist()), depth, fanout)


def _whole_paths(nodes: pa.Table, levels: list[np.ndarray], path: list, fanout: int) -> pa.Array:
    """Each node's siblings up to the root."""
    whole = [[{"left": a, "right": b} for a, b in (*siblings(levels, i, fanout), *path)] for i in range(len(nodes))]
    return pa.array(whole, pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))


def _path(above: pa.Table) -> list[tuple[bytes, bytes]]:
    return [(p["left"], p["right"]) for p in above["path"][0].as_py()]


def _blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {fanout**HEIGHT}"))


def raised(nodes: DataFrame, fanout: int) -> DataFrame:
    """(group, place, n, digest) of the nodes HEIGHT levels above (fewer where a group's root is nearer)."""

    def top(nodes: pa.Table) -> pa.Table:
        nodes, levels = _levels(nodes, fanout)
        n = nodes["n"][0].as_py()
        return pa.table({"group": nodes["group"].slice(0, 1), "place": nodes["block"].slice(0, 1), "n": pa.array([-(-n // fanout**HEIGHT)], pa.int64()), "digest": pa.array([levels[-1][0].tobytes()], pa.binary())})

    blocks = _blocks(nodes.select("group", "place", "n", "digest"), fanout)
    return saved(blocks.groupBy("group", "block").applyInArrow(top, "group string, place long, n long, digest binary"))


def stages(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """nodes and those above, stage by stage, until each group has one; the last holds the roots."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(raised(found[-1], fanout))
    return found


def _down(nodes: DataFrame, above: DataFrame, fanout: int, schema: str, answer: Callable) -> DataFrame:
    """answer(nodes of a block in order, its matrices, the block's path, the row of above) for each block; above: (group, place, path, subroot)."""

    def one(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, levels = _levels(nodes, fanout)
        return answer(nodes, levels, _path(above), above)

    blocks = _blocks(nodes, fanout).groupBy("group", "block")
    return blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("group", "block")).applyInArrow(one, schema)


def paths(found: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """(group, place, path, subroot) of the nodes of found[1]; top has those of the last stage's nodes."""

    def each(nodes, levels, path, above):
        return pa.table({"group": nodes["group"], "place": nodes["place"], "path": _whole_paths(nodes, levels, path, fanout), "subroot": pa.array([above["subroot"][0].as_py()] * len(nodes), pa.binary())})

    for nodes in reversed(found[1:-1]):
        top = saved(_down(nodes, top, fanout, f"group string, place long, path {_PATH}, subroot binary", each))
    return top


@dataclass
class Manifest:
    """leaves: (id, group, place, n, digest, other); subroots: (group, digest); root: None of an empty table."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None
    above: DataFrame
    fanout: int

    def proofs(self) -> DataFrame:
        """(id, leaf, path): the siblings of each leaf up to the root, on its left and right, level by level."""
        fanout = self.fanout

        def each(nodes, levels, path, above):
            return pa.table({"id": nodes["id"], "leaf": nodes["digest"].cast(pa.string()), "path": _whole_paths(nodes, levels, path, fanout)})

        return _down(self.leaves, self.above, fanout, f"id {self._id()}, leaf string, path {_PATH}", each)

    def checked(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's other leaf, or its leaf where that is null, folded up with its siblings."""
        fanout, root = self.fanout, self.root

        def each(nodes, levels, path, above):
            tail = b"".join(a + b for a, b in path)
            proof, folded = [], []
            for i, (leaf, other) in enumerate(zip(nodes["digest"].to_pylist(), nodes["other"].to_pylist())):
                own = siblings(levels, i, fanout)
                proof.append(digest(b"".join(a + b for a, b in own) + tail).decode())
                folded.append(fold(leaf if other is None else other, [*own, *path]).decode())
            n, subroot = len(nodes), above["subroot"][0].as_py().decode()
            return pa.table({"id": nodes["id"], "leaf": nodes["digest"].cast(pa.string()), "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

        return _down(self.leaves, self.above, fanout, f"id {self._id()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", each)

    def _id(self) -> str:
        return self.leaves.schema["id"].dataType.simpleString()


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = 16, other: Column | None = None) -> Manifest:
    """The tree of rows, leaves ascending by id within each group, groups in bytewise order of their text.

    Nulls count: a null id comes first, and so does the null group, which is a group
    of its own; a null field is - in the leaf's text. Rows of equal ids are in the
    order of their leaves, and rows that are the same share what they get. other, if
    given, is a leaf to check in the place of the row's own where it isn't null. An
    empty table has no root and no rows. Texts of any length are hashed whole, by the
    JVM; columns that aren't named play no part, whatever they are called.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    other = F.lit(None).cast("string") if other is None else other
    own = rows.select(F.col(id_col).alias("id"), group.alias("group"), leaf_of(*[F.col(f) for f in fields]).cast("binary").alias("digest"), other.cast("binary").alias("other"))
    own = saved(own.withColumn("row", F.monotonically_increasing_id()))
    leaves = saved(ranked(own, "group", ["id", "digest", "row"], "place", "n").select("id", "group", "place", "n", "digest", "other"))
    trees = stages(leaves, fanout)
    if len(trees) == 1:  # groups of one row each, or none
        trees.append(raised(leaves, fanout))
    subroots = trees[-1].select("group", "digest")
    n = subroots.count()
    if not n:
        return Manifest(leaves, subroots, None, leaves.select("group", "place", F.lit(None).cast(_PATH).alias("path"), F.col("digest").alias("subroot")), fanout)
    numbered = with_rid(subroots, ["group"], "place").select(F.lit("").alias("group"), "place", F.lit(n).cast("long").alias("n"), "digest", F.col("group").alias("own"))
    joint = stages(saved(numbered), fanout)
    if len(joint) == 1:
        joint.append(raised(joint[0], fanout))
    top = joint[-1]
    root = top.first()["digest"].decode()
    nothing = top.select("group", "place", F.expr(f"cast(array() as {_PATH})").alias("path"), F.col("digest").alias("subroot"))

    def each(nodes, levels, path, above):
        return pa.table({"group": nodes["own"], "place": pa.array([0] * len(nodes), pa.int64()), "path": _whole_paths(nodes, levels, path, fanout), "subroot": nodes["digest"]})

    above = saved(_down(joint[0], paths(joint, nothing, fanout), fanout, f"group string, place long, path {_PATH}, subroot binary", each))
    return Manifest(leaves, subroots, root, paths(trees, above, fanout), fanout)


#: Lower-cased where a text is tampered with.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fields = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, leaf_of(*fields, F.translate("text", UPPER, LOWER)))
    return manifest(docs, other=tampered).checked().withColumnRenamed("id", "doc_id")
