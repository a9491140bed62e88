"""Boosted trees for all splits in one plan.

Trees of all splits grow together. A level is one job: rows find their node by an
expression over their split's unfinished tree, gradients are summed by split, node,
feature and bin, and of each node the best cut is picked from running sums over its
bins; only that, a row a node, reaches the driver. So the number of jobs depends on
trees and depth, not on splits or rows. Where bins have few combinations, rows of one
split and the same bins are put together first: they have one prediction, so sums of their
gradients follow from their count and mean target. A split's state is an array of trees,
which are arrays of nodes, and scores rows by an expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import PREDICTION, PROBABILITY, c
from ..plans.blocks import Block, Frame, Run
from ..sources.tables import saved
from .models import CLASS_WEIGHTS, weight_of

_NODE = "struct<feature:int,bin:int,cut:double,value:double,gain:double>"
_TREES = f"array<array<{_NODE}>>"
#: Trees after which rows are written with their predictions so far.
WRITTEN = 8
#: Rows that a combination of bins must have, on the average, for rows to be put together.
ALIKE = 8


def _at(tree: Column, goes_left, depth: int) -> Column:
    """The place in a tree, node k's children at 2k + 1 and 2k + 2, that a row reaches after depth levels; a node without a cut is where it stays."""
    place = F.lit(0)
    for _ in range(depth):
        node = F.get(tree, place)
        place = F.when(node["feature"].isNull(), place).when(goes_left(node), 2 * place + 1).otherwise(2 * place + 2)
    return place


def _sum(trees: Column, goes_left, depth: int) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda total, tree: total + F.get(tree, _at(tree, goes_left, depth))["value"])


@dataclass(frozen=True)
class BoostedTrees(Block):
    """Gradient boosting of trees with histograms, as second-order boosting does it.

    objective: "regression" (squared error) or "classification" (two classes, 0 and
    1, by logistic loss). A feature is cut at quantiles of its train rows, at most
    bins - 1 of them; nulls go right at every cut. A cut must gain more than
    min_gain and leave min_weight of second derivatives on both sides; of equal cuts the
    first feature's lowest is taken. class_weights: how a class's rows weigh
    ("none", "balanced", "balanced_sqrt": class 1 by what class 0 has more). Rows
    without a target aren't learnt from; a split without any predicts null.
    """

    trees: int = 20
    depth: int = 3
    learning_rate: float = 0.3
    bins: int = 32
    l2: float = 1.0
    min_weight: float = 1.0
    min_gain: float = 0.0
    objective: str = "regression"
    class_weights: str = "none"
    name: str = "BoostedTrees"

    def fit(self, frame: Frame, run: Run, path: str) -> None:
        run.labels[path] = f"{self.name}_feature_importances"
        run.state(path, lambda: self._grown(frame))

    def _grown(self, frame: Frame) -> DataFrame:
        spark, names = frame.df.sparkSession, list(frame.features)
        rows = frame.train_rows().where("y IS NOT NULL").select("split_id", F.col("y").cast("double").alias("y"), weight_of(frame).cast("double").alias("w"), F.array(*[c(f).cast("double") for f in names]).alias("x"))
        marks = F.array(*[F.lit((i + 1) / self.bins) for i in range(self.bins - 1)])
        cuts = [F.array_distinct(F.percentile_approx(F.col("x")[i], marks, 10_000)).alias(f"c{i}") for i in range(len(names))]
        one = F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0))
        heavier = CLASS_WEIGHTS[self.class_weights](one, F.count("*") - one) if self.objective == "classification" else F.lit(1.0)
        seen = rows.groupBy("split_id").agg(heavier.alias("heavier"), F.count("*").alias("rows"), F.sum("w").alias("all"), F.sum(F.col("w") * F.col("y")).alias("sum"), *cuts).collect()  # a row a split
        heavy = {r["split_id"]: float(r["heavier"] or 1.0) for r in seen}
        base = {r["split_id"]: self._start(r["sum"], r["all"], heavy[r["split_id"]]) for r in seen}
        cut = {r["split_id"]: [list(r[f"c{i}"] or []) for i in range(len(names))] for r in seen}
        start = spark.createDataFrame([(s, heavy[s], base[s], cut[s]) for s in base], "split_id long, heavier double, at double, cuts array<array<double>>")
        # a value's bin is the number of cuts under it
        binned = F.transform("x", lambda v, i: F.when(v.isNull(), F.lit(self.bins)).otherwise(F.size(F.filter(F.get("cuts", i), lambda b: b < v))).cast("short"))
        weight = F.when(F.col("y") == 1, F.col("w") * F.col("heavier")).otherwise(F.col("w")) if self.objective == "classification" else F.col("w")
        rows = rows.join(F.broadcast(start), "split_id").select("split_id", "y", weight.alias("w"), binned.alias("bins"), "at")
        # bins of a feature: one more than its cuts, and that of nulls
        if ALIKE * sum(math.prod(len(x) + 2 for x in own) for own in cut.values()) <= sum(r["rows"] for r in seen):
            rows = self._together(rows)
        rows = saved(rows)
        grown = {s: [] for s in base}
        done = 0
        for k in range(self.trees):
            if k - done == WRITTEN:
                rows, done = saved(self._with_trees(rows, grown, done)), k
            self._grow(rows, grown, cut, done)
        out = []
        for s in base:
            gains = [0.0] * len(names)
            for node in (n for tree in grown[s] for n in tree if n[0] is not None):
                gains[node[0]] += node[4]
            order = sorted(range(len(names)), key=lambda i: -gains[i])
            out.append((s, base[s], grown[s], [(names[i], gains[i]) for i in order]))
        return spark.createDataFrame(out, f"split_id long, _base double, _trees {_TREES}, _importances array<struct<feature:string,gain:double>>")

    def _together(self, rows: DataFrame) -> DataFrame:
        """A row for each split's rows of the same bins (and class), with their weight and mean target."""
        key = F.struct("bins", "y") if self.objective == "classification" else F.struct("bins")
        total = F.sum("w")
        sums = rows.groupBy("split_id", key.alias("key")).agg(F.coalesce(F.sum(F.col("w") * F.col("y")) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("mean"), total.alias("w"), F.any_value("at").alias("at"))
        return sums.select("split_id", (F.col("key.y") if self.objective == "classification" else F.col("mean")).alias("y"), "w", F.col("key.bins").alias("bins"), "at")

    def _start(self, total: float, weight: float, heavier: float) -> float:
        if self.objective == "regression":
            return total / weight if weight else 0.0
        one, zero = total * heavier, weight - total
        return math.log(one / zero) if one > 0 and zero > 0 else 20.0 if one > 0 else -20.0

    def _with_trees(self, rows: DataFrame, grown: dict[int, list], done: int) -> DataFrame:
        """rows with their split's trees since done added to their prediction."""
        state = rows.sparkSession.createDataFrame([(s, trees[done:]) for s, trees in grown.items()], f"split_id long, _trees {_TREES}")  # a row a split
        more = _sum(F.col("_trees"), lambda n: F.get("bins", n["feature"]) <= n["bin"], self.depth)
        return rows.join(F.broadcast(state), "split_id").withColumn("at", F.col("at") + more).drop("_trees")

    def _grow(self, rows: DataFrame, grown: dict[int, list], cuts: dict[int, list], done: int) -> None:
        """Adds a tree to each split's."""
        size = 2 ** (self.depth + 1) - 1
        now = {s: [(None, None, None, 0.0, None)] * size for s in grown}
        rows = self._with_trees(rows, grown, done) if any(len(t) > done for t in grown.values()) else rows
        if self.objective == "regression":
            g, h = F.col("w") * (F.col("at") - F.col("y")), F.col("w")
        else:
            p = 1 / (1 + F.exp(-F.col("at")))
            g, h = F.col("w") * (p - F.col("y")), F.col("w") * p * (1 - p)
        rows = rows.select("split_id", "bins", g.alias("g"), h.alias("h"))
        for level in range(self.depth):
            state = rows.sparkSession.createDataFrame([(s, tree[: 2**level - 1]) for s, tree in now.items()], f"split_id long, _tree array<{_NODE}>")  # a row a split
            first = 2**level - 1
            place = F.lit(0)
            for _ in range(level):
                node = F.get("_tree", place)
                # under a leaf no place counts
                place = F.when(node["feature"].isNull(), F.lit(-1)).when(F.get("bins", node["feature"]) <= node["bin"], 2 * place + 1).otherwise(2 * place + 2)
            placed = rows.join(F.broadcast(state), "split_id").select("split_id", place.alias("node"), "bins", "g", "h").where(F.col("node") >= first)
            each = placed.select("split_id", "node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
            sums = each.groupBy("split_id", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            key = Window.partitionBy("split_id", "node", "feature")
            so_far = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            left = sums.select("split_id", "node", "feature", "bin", *[f(x).over(w).alias(n) for n, f, x, w in (("gl", F.sum, "g", so_far), ("hl", F.sum, "h", so_far), ("g", F.sum, "g", key), ("h", F.sum, "h", key))])
            part = lambda a, b: F.coalesce(a * a / F.nullif(b + self.l2, F.lit(0.0)), F.lit(0.0))
            gl, hl, gr, hr = F.col("gl"), F.col("hl"), F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
            gain = (part(gl, hl) + part(gr, hr) - part(F.col("g"), F.col("h"))) / 2
            allowed = (hl >= self.min_weight) & (hr >= self.min_weight) & (gain > self.min_gain)
            best = F.max_by(F.struct("feature", "bin", "gl", "hl", "g", "h", "gain"), F.struct(F.col("allowed").cast("int"), F.when(F.col("allowed"), F.round("gain", 9)), -F.col("feature"), -F.col("bin")))
            chosen = left.withColumns({"gain": gain, "allowed": allowed}).groupBy("split_id", "node").agg(best.alias("b"), F.bool_or("allowed").alias("cut"))
            for r in chosen.collect():  # a row a node
                s, k, b = r["split_id"], r["node"], r["b"]
                value = lambda g, h: -self.learning_rate * g / (h + self.l2) if h + self.l2 else 0.0
                if r["cut"]:
                    own = cuts[s][b["feature"]]
                    now[s][k] = (b["feature"], b["bin"], own[b["bin"]] if b["bin"] < len(own) else float("inf"), value(b["g"], b["h"]), b["gain"])
                    now[s][2 * k + 1] = (None, None, None, value(b["gl"], b["hl"]), None)
                    now[s][2 * k + 2] = (None, None, None, value(b["g"] - b["gl"], b["h"] - b["hl"]), None)
                else:
                    now[s][k] = (None, None, None, value(b["g"], b["h"]), None)
        for s in grown:
            grown[s].append(now[s])

    def process(self, frame, run, path):
        if run.fitting:
            self.fit(frame, run, path)
        df = frame.df.join(F.broadcast(run.states[path]), "split_id", "left")  # a row a split
        x = F.array(*[c(f).cast("double") for f in frame.features])
        df = df.withColumn("_x", x)
        goes_left = lambda n: F.coalesce(F.get("_x", n["feature"]) <= n["cut"], F.lit(False))
        score = F.col("_base") + _sum(F.col("_trees"), goes_left, self.depth)
        # a filter on a score pushed below the join isn't bound rightly (Spark 4.1): a value that depends on the partition stops it
        frame = frame.on(df.withColumn("_score", F.when(F.spark_partition_id() >= 0, score)))
        if self.objective == "regression":
            return frame.add({PREDICTION + self.name: F.col("_score")}, [])
        one = 1 / (1 + F.exp(-F.col("_score")))
        return frame.add({PREDICTION + self.name: F.when(one >= 0.5, 1.0).when(one < 0.5, 0.0), f"{PROBABILITY}{self.name}_0": 1 - one, f"{PROBABILITY}{self.name}_1": one}, [])
