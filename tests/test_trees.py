"""Boosted trees against a plain version, and artifacts from inside composites."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospark.operators import composites as comp
from chronospark.operators import features as feat
from chronospark.operators import models as mod
from chronospark.operators import scaling as sc
from chronospark.operators import trees
from chronospark.operators.trees import BoostedTrees
from chronospark.plans import engine
from chronospark.plans.splits import ExpandingWindowSplitter, plan_splits
from chronospark.sources.tables import saved

SPLITTER = ExpandingWindowSplitter(200, 100)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(500).select(F.col("id").alias("rid"), F.lit(None).cast("timestamp_ntz").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(9))).cast("double").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double").alias("b"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)).cast("double").alias("noise"))
    df = df.withColumn("a", F.when(F.col("rid") % 11 != 0, F.col("a")))
    y = F.coalesce("a", F.lit(20.0)) * 2 + F.when(F.col("b") > 3, F.col("a")).otherwise(-1.0) + F.col("noise") / 10
    return df.withColumns({"y": F.when(F.col("rid") % 17 != 0, F.coalesce(y, F.lit(30.0))), "cls": F.when(F.coalesce(y, F.lit(30.0)) > 14, 1.0).otherwise(0.0)}).cache()


def plain(x, y, w, new, block):
    """The same boosting with loops: (scores of new rows, gains)."""
    logistic = block.objective == "classification"
    cuts = [sorted(set(v for v in col if not math.isnan(v))) for col in x.T]
    total, weight = (w * y).sum(), w.sum()
    base = math.log(total / (weight - total)) if logistic else total / weight
    at, out, gains = np.full(len(y), base), np.full(len(new), base), np.zeros(x.shape[1])
    for _ in range(block.trees):
        p = 1 / (1 + np.exp(-at)) if logistic else at
        g, h = w * (p - y), w * (p * (1 - p) if logistic else 1.0)

        def grow(own, mine, depth):
            part = lambda k: g[k].sum() ** 2 / (h[k].sum() + block.l2)
            best = None
            for f in range(x.shape[1]) if depth < block.depth else ():
                for cut in cuts[f]:
                    left, right = own & (x[:, f] <= cut), own & ~(x[:, f] <= cut)
                    if not left.any() or h[left].sum() < block.min_weight or h[right].sum() < block.min_weight:
                        continue
                    gain = (part(left) + part(right) - part(own)) / 2
                    if gain > block.min_gain and (best is None or round(gain, 9) > round(best[0], 9)):
                        best = (gain, f, cut)
            if best is None:
                value = -block.learning_rate * g[own].sum() / (h[own].sum() + block.l2)
                at[own] += value
                out[mine] += value
                return
            gain, f, cut = best
            gains[f] += gain
            grow(own & (x[:, f] <= cut), mine & (new[:, f] <= cut), depth + 1)
            grow(own & ~(x[:, f] <= cut), mine & ~(new[:, f] <= cut), depth + 1)

        grow(np.ones(len(y), bool), np.ones(len(new), bool), 0)
    return out, gains


@pytest.mark.parametrize("block, target", [(BoostedTrees(3, 2, 0.5), "y"), (BoostedTrees(10, 1, 0.9, l2=0.0), "y"), (BoostedTrees(2, 3, 0.4, objective="classification", class_weights="balanced_sqrt"), "cls")])
def test_trees_equal_a_plain_version(rows, block, target):
    df = rows.withColumn("y", F.col(target))
    trained = engine.train([block], df, SPLITTER, ("a", "b", "noise"), need_in_sample=False)
    got = engine.backtest(trained).toPandas()
    all_rows = df.orderBy("rid").toPandas()
    importances = {r["split_id"]: dict(zip(r["value"], r["numbers"])) for r in engine.artifacts(trained).collect()}
    for split in plan_splits(SPLITTER, 500):
        own = all_rows.iloc[split.train_rows()].dropna(subset=["y"])
        w = np.ones(len(own))
        if block.class_weights != "none":
            one = (own["y"] == 1).sum()
            w = np.where(own["y"] == 1, math.sqrt((len(own) - one) / one), 1.0)
        score, gains = plain(own[["a", "b", "noise"]].to_numpy(), own["y"].to_numpy(), w, all_rows.iloc[split.test_rows()][["a", "b", "noise"]].to_numpy(), block)
        mine = got[got["split_id"] == split.split_id].sort_values("rid")
        value = mine["predictions_BoostedTrees"] if target == "y" else mine["probabilities_BoostedTrees_1"]
        assert np.abs(value.to_numpy() - (score if target == "y" else 1 / (1 + np.exp(-score)))).max() < 1e-7
        assert np.abs(np.array([importances[split.split_id][f] for f in ("a", "b", "noise")]) - gains).max() < 1e-6 * max(1, gains.max())


def test_saved_trees_predict_alike_and_jobs_do_not_grow_with_splits(spark, rows, tmp_path):
    block, counts = [BoostedTrees(2, 2)], []
    for step in (150, 60):
        spark.sparkContext.setJobGroup(f"trees{step}", "")
        engine.train(block, rows, ExpandingWindowSplitter(200, step), ("a", "b"), n=500, need_in_sample=False)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees{step}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert counts[0] == counts[1] > 0
    trained = engine.train(block, rows, SPLITTER, ("a", "b"), need_in_sample=False)
    engine.save_states(trained, str(tmp_path))
    loaded = engine.with_states(trained, engine.load_states(spark, str(tmp_path), len(trained.run.states)))
    new = rows.select("rid", "ts", "a", "b")
    a, b = (engine.infer(t, new, ("a", "b")).orderBy("rid").toPandas() for t in (trained, loaded))
    assert a.equals(b) and a["predictions_BoostedTrees"].notna().all()


def test_trees_without_anything_to_learn(rows):
    none = rows.withColumn("y", F.lit(None).cast("double"))
    assert engine.train_backtest([BoostedTrees(1, 1)], none, SPLITTER, ("a",)).where("predictions_BoostedTrees IS NOT NULL").isEmpty()
    flat = rows.withColumns({"y": F.lit(3.0), "a": F.lit(None).cast("double")})
    out = engine.train_backtest([BoostedTrees(2, 2)], flat, SPLITTER, ("a",))
    assert {r[0] for r in out.select("predictions_BoostedTrees").distinct().collect()} == {3.0}


def test_artifacts_from_inside_composites(rows):
    pipeline = [
        comp.TransformColumn(["a", "b"], [sc.RemoveLowVariance(name="varying")]),
        feat.AddLagsX(("b", 1)),
        comp.Ensemble(([sc.SelectKBest(1, name="best"), mod.LinearRegression()], [comp.SkipNA([BoostedTrees(1, 1, name="stump")])])),
    ]
    found = engine.artifacts(engine.train(pipeline, rows, SPLITTER, ("a", "b", "noise"), need_in_sample=False)).collect()
    assert {(r["split_id"], r["artifact"], r["rid"]) for r in found} == {(k, x, 199 + 100 * k) for k in range(3) for x in ("selected_features_varying", "selected_features_best", "stump_feature_importances")}
    assert all(r["numbers"][0] > 0 and r["value"][0] == "a" for r in found if r["artifact"] == "stump_feature_importances")


@pytest.mark.parametrize("block, target", [(BoostedTrees(3, 2, 0.5), "y"), (BoostedTrees(2, 3, 0.4, objective="classification", class_weights="balanced"), "cls")])
def test_rows_of_the_same_bins_are_put_together(rows, block, target, monkeypatch):
    """Levels of trees read a row a combination of bins, not one a row, and grow the same trees."""
    df = rows.withColumn("y", F.col(target))
    written = []
    monkeypatch.setattr(trees, "saved", lambda df, *a: written.append(df.count()) or saved(df, *a))
    results = []
    for alike in (0, 1 << 40):
        monkeypatch.setattr(trees, "ALIKE", alike, raising=False)
        trained = engine.train([block], df, SPLITTER, ("b", "noise"), need_in_sample=False)
        results.append(engine.backtest(trained).orderBy("split_id", "rid").toPandas()["predictions_BoostedTrees"])
    assert written[0] <= 3 * 7 * 5 * 2 < written[1]
    assert len(results[0]) == 300 and (results[0] - results[1]).abs().max() < 1e-9
