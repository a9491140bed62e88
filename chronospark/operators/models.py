"""Models: blocks whose only features afterwards are predictions and probabilities."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import PREDICTION, PROBABILITY, c
from ..plans.blocks import Block, Frame
from ..sources.tables import saved
from .scaling import keep_selected

#: How much a class's rows weigh.
CLASS_WEIGHTS = {"none": lambda own, other: F.lit(1.0), "balanced": lambda own, other: other / own, "balanced_sqrt": lambda own, other: F.sqrt(other / own)}


def weight_of(frame: Frame) -> Column:
    return F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in frame.df.columns else F.lit(1.0)


@dataclass(frozen=True)
class DummyRegressor(Block):
    predicted_value: float
    name: str = "DummyRegressor"
    learns = False

    def process(self, frame, run, path):
        return frame.add({PREDICTION + self.name: F.lit(float(self.predicted_value))}, [])


@dataclass(frozen=True)
class DummyClassifier(Block):
    predicted_value: float
    all_classes: tuple
    predicted_probabilities: tuple
    name: str = "DummyClassifier"
    learns = False

    def process(self, frame, run, path):
        made = {PREDICTION + self.name: F.lit(float(self.predicted_value))}
        made |= {f"{PROBABILITY}{self.name}_{k}": F.lit(float(p)) for k, p in zip(self.all_classes, self.predicted_probabilities, strict=True)}
        return frame.add(made, [])


def _normal(center: Column, *key) -> Column:
    """A normal draw fixed by the row: the sum of twelve uniform numbers, less six, times a tenth."""
    uniform = lambda i: F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(1 << 30)) / (1 << 30)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), center + (reduce(lambda a, b: a + b, [uniform(i) for i in range(12)]) - 6) * 0.1))


@dataclass(frozen=True)
class RandomClassifier(Block):
    """A class and probabilities at random, the same for a row in every run."""

    all_classes: tuple
    probability_mean: float = 0.5
    seed: int = 1
    name: str = "RandomClassifier"
    learns = False

    def process(self, frame, run, path):
        n = len(self.all_classes)
        pick = F.pmod(F.xxhash64("rid", F.lit(self.seed)), F.lit(n)).cast("int")
        draws = [_normal(F.lit(self.probability_mean), F.col("rid"), F.lit(self.seed + 1 + i)) for i in range(n)]
        total = F.nullif(reduce(lambda a, b: a + b, draws), F.lit(0.0))
        made = {PREDICTION + self.name: F.element_at(F.array(*[F.lit(float(k)) for k in self.all_classes]), pick + 1)}
        made |= {f"{PROBABILITY}{self.name}_{k}": F.coalesce(d / total, F.lit(1.0 / n)) for k, d in zip(self.all_classes, draws, strict=True)}
        return frame.add(made, [])


@dataclass(frozen=True)
class RandomBinaryClassifier(Block):
    """Probabilities at random around half the mean of the weighted target (as +-1) plus a half."""

    seed: int = 1
    name: str = "RandomBinaryClassifier"

    def process(self, frame, run, path):
        sign = F.when(F.col("y") > 0, 1.0).otherwise(-1.0)
        fit = lambda: frame.train_rows().groupBy("split_id").agg((F.avg(sign * weight_of(frame)) / 2 + 0.5).alias("_center"))
        one = _normal(F.col("_center"), F.col("rid"), F.lit(self.seed))
        made = {PREDICTION + self.name: F.when(one >= 0.5, 1.0).otherwise(0.0), f"{PROBABILITY}{self.name}_0": 1 - one, f"{PROBABILITY}{self.name}_1": one}
        return frame.on(run.joined(path, frame, fit)).add(made, [])


@dataclass(frozen=True)
class LinearRegression(Block):
    """Weighted least squares, with a ridge, of all features.

    A split's state is the means and covariances of its train rows' columns:
    partial aggregates meet, never the rows. The small systems are then solved, one
    row a split. Rows with a null among features or target don't count.
    """

    ridge: float = 0.0
    name: str = "LinearRegression"
    needs_target = True

    def state_from(self, m) -> tuple:
        return (solved(m.spread / max(m.n[0], 1.0), m.mean, m.n[0], self.ridge),)

    def state_schema(self, k: int) -> str:
        return "_beta array<double>"

    def process(self, frame, run, path):
        x = [c(f).cast("double") for f in frame.features]

        def fit() -> DataFrame:
            known = reduce(lambda a, b: a & b, [v.isNotNull() for v in x], F.col("y").isNotNull())
            rows, w = frame.train_rows().where(known), weight_of(frame)
            column, total = [*x, F.col("y")], F.nullif(F.sum(w), F.lit(0.0))
            if "weight" not in frame.df.columns:  # these aggregates are kept about the mean and lose no digits
                second = lambda i, j: F.covar_pop(column[i], column[j])
            else:
                second = lambda i, j: F.sum(w * column[i] * column[j]) / total - F.sum(w * column[i]) / total * F.sum(w * column[j]) / total
            sums = [F.sum(w).alias("_n"), *[(F.sum(w * v) / total).alias(f"_m_{i}") for i, v in enumerate(column)]]
            sums += [second(i, j).alias(f"_{i}_{j}") for i in range(len(column)) for j in range(i, len(column))]
            return rows.groupBy("split_id").agg(*sums).mapInPandas(_solver(len(x), self.ridge), "split_id long, _beta array<double>")

        df = run.joined(path, frame, fit)
        value = reduce(lambda a, b: a + b, [F.col("_beta")[i + 1] * v for i, v in enumerate(x)], F.col("_beta")[0])
        return frame.on(df).add({PREDICTION + self.name: value}, [])


def solved(covariance: np.ndarray, mean: np.ndarray, n: float, ridge: float) -> list[float]:
    """Intercept and slopes from the covariances and means of features and, last, target."""
    k = len(mean) - 1
    a = covariance[:k, :k] + ridge / max(n, 1.0) * np.eye(k)
    # features of very different sizes are brought to one scale first
    unit = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    beta = np.linalg.lstsq(a / unit[:, None] / unit, covariance[:k, k] / unit, rcond=1e-12)[0] / unit
    return [float(mean[k] - beta @ mean[:k]), *beta.tolist()]


def _solver(k: int, ridge: float):
    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                gram = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        gram[i, j] = gram[j, i] = r[f"_{i}_{j}"] or 0.0
                mean = np.array([r[f"_m_{i}"] for i in range(k + 1)], float)
                out.append({"split_id": r["split_id"], "_beta": solved(gram, mean, r["_n"], ridge)})
            yield pd.DataFrame(out, columns=["split_id", "_beta"])

    return solve


def is_estimator(x) -> bool:
    return isinstance(x, (Estimator, Transformer))


def predicts(x) -> bool:
    """Whether a pyspark.ml stage learns a label."""
    return isinstance(x, Estimator) and x.hasParam("predictionCol") and x.hasParam("labelCol")


def _linear_state(model) -> list[list[float]] | None:
    """The rows (constant, slopes) of a linear model's scores, one a class beyond two; None for other models."""
    if isinstance(model, LogisticRegressionModel):
        if model.numClasses <= 2:
            return [[float(model.intercept), *map(float, model.coefficients)]]
        return [[float(a), *map(float, row)] for a, row in zip(model.interceptVector.toArray(), model.coefficientMatrix.toArray(), strict=True)]
    if isinstance(model, LinearRegressionModel):
        return [[float(model.intercept), *map(float, model.coefficients)]]
    return None


@dataclass(frozen=True)
class FromMl(Block):
    """A pyspark.ml regressor or classifier, fitted for each split: the one kind of block whose jobs grow with the splits.

    Linear and logistic models become a state of their coefficients, one row a
    split, and predict by an expression. Other models' predictions are written
    split by split and joined. Rows with a null feature have null predictions.
    Classes weigh as class_weights says ("none", "balanced", "balanced_sqrt").
    """

    estimator: object
    class_weights: str = "none"
    name: str = ""

    def _ready(self, frame: Frame) -> tuple[list[str], DataFrame]:
        from pyspark.ml.feature import VectorAssembler

        safe = [f"_f{i}" for i in range(len(frame.features))]
        key = list(dict.fromkeys(["split_id", *frame.by, "rid"]))
        plain = frame.df.select(*key, "train", "y", weight_of(frame).alias("_w"), *[c(f).cast("double").alias(s) for f, s in zip(frame.features, safe, strict=True)]).dropna(subset=safe)
        return key, VectorAssembler(inputCols=safe, outputCol="_x").transform(plain)

    @property
    def _classifies(self) -> bool:
        return "Classifier" in type(self.estimator).__name__ or "LogisticRegression" in type(self.estimator).__name__

    def fit(self, frame, run, path):
        run.models[path] = {}
        rows = saved(self._ready(frame)[1].where("train AND y IS NOT NULL"))  # every split's fit reads them again and again
        counts = rows.groupBy("split_id").agg(F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("one"), F.count("*").alias("n")).orderBy("split_id").collect()
        for count in counts:
            own_rows = rows.where(F.col("split_id") == count["split_id"])
            if self._classifies and self.class_weights != "none":
                heavier = CLASS_WEIGHTS[self.class_weights](F.lit(count["one"]), F.lit(count["n"] - count["one"]))
                own_rows = own_rows.withColumn("_w", F.col("_w") * F.when(F.col("y") == 1, heavier).otherwise(1.0))
            own = self.estimator.copy({self.estimator.featuresCol: "_x", self.estimator.labelCol: "y", self.estimator.predictionCol: "_p"})
            own = own.copy({own.weightCol: "_w"}) if own.hasParam("weightCol") else own
            run.models[path][count["split_id"]] = own.fit(own_rows)
        linear = {s: _linear_state(m) for s, m in run.models[path].items()}
        if all(linear.values()):
            spark = frame.df.sparkSession
            run.state(path, lambda: spark.createDataFrame(list(linear.items()), "split_id long, _rows array<array<double>>"))

    def process(self, frame, run, path):
        label = self.name or type(self.estimator).__name__
        if run.fitting:
            self.fit(frame, run, path)
        models = run.models[path]
        linear = {s: _linear_state(m) for s, m in models.items()}
        if all(linear.values()):
            return self._by_coefficients(frame, run, path, label, linear)
        key, ready = self._ready(frame)
        return self._by_transform(frame, ready, key, label, models)

    def _by_coefficients(self, frame, run, path, label, linear):
        df = frame.df.join(F.broadcast(run.states[path]), "split_id", "left")  # a row a split
        x = [c(f).cast("double") for f in frame.features]
        known = reduce(lambda a, b: a & b, [v.isNotNull() for v in x])
        scores = F.transform("_rows", lambda r: reduce(lambda a, b: a + b, [r[i + 1] * v for i, v in enumerate(x)], r[0]))
        frame = frame.on(df.withColumn("_scores", F.when(known, scores)))
        first = F.col("_scores")[0]
        if not self._classifies:
            return frame.add({PREDICTION + label: first}, [])
        n = max(len(v) for v in linear.values())
        if n == 1:
            one = 1 / (1 + F.exp(-first))
            return frame.add({PREDICTION + label: F.when(one > 0.5, 1.0).when(one <= 0.5, 0.0), f"{PROBABILITY}{label}_0": 1 - one, f"{PROBABILITY}{label}_1": one}, [])
        top = F.array_max("_scores")
        total = F.aggregate("_scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
        made = {PREDICTION + label: (F.array_position("_scores", top) - 1).cast("double")}
        return frame.add(made | {f"{PROBABILITY}{label}_{k}": F.exp(F.col("_scores")[k] - top) / total for k in range(n)}, [])

    def _by_transform(self, frame, ready, key, label, models):
        from pyspark.ml.functions import vector_to_array

        found = []
        for split_id, model in models.items():
            out = model.transform(ready.where(F.col("split_id") == split_id))
            extra = [vector_to_array(F.col(model.getProbabilityCol())).alias("_pp")] if self._classifies else []
            found.append(saved(out.select(*key, "_p", *extra)))
        joined = frame.df.join(reduce(DataFrame.union, found), key, "left")
        made = {PREDICTION + label: F.col("_p")}
        if self._classifies:
            made |= {f"{PROBABILITY}{label}_{k}": F.col("_pp")[k] for k in range(next(iter(models.values())).numClasses)}
        return frame.on(joined).add(made, [])


@dataclass(frozen=True)
class FromMlTransformation(Block):
    """A pyspark.ml transformer, or an estimator of one (as PCA), fitted for each split on its train rows.

    It sees the features as one vector. A stage that selects features keeps
    those columns; the output of another has the features' names if it is as
    wide, else name_0, name_1 and so on. Rows with a null feature have nulls.
    inverse, a function of (fitted model, column), turns predictions back.
    """

    stage: object
    inverse_function: object = None
    output_dtype: str | None = None
    name: str = ""

    def process(self, frame, run, path):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        label = self.name or type(self.stage).__name__
        safe = [f"_f{i}" for i in range(len(frame.features))]
        key = list(dict.fromkeys(["split_id", *frame.by, "rid"]))
        plain = frame.df.select(*key, "train", "y", *[c(f).cast("double").alias(s) for f, s in zip(frame.features, safe, strict=True)]).dropna(subset=safe)
        ready = VectorAssembler(inputCols=safe, outputCol="_x").transform(plain)
        into = lambda stage: stage.copy({getattr(stage, k): v for k, v in (("inputCol", "_x"), ("featuresCol", "_x"), ("labelCol", "y"), ("outputCol", "_o")) if stage.hasParam(k)})
        if run.fitting:
            run.models[path] = {}
            for row in ready.where("train").select("split_id").distinct().orderBy("split_id").collect():
                stage = into(self.stage)
                own = ready.where(F.col("train") & (F.col("split_id") == row["split_id"]))
                run.models[path][row["split_id"]] = stage.fit(own.where("y IS NOT NULL") if stage.hasParam("labelCol") else own) if isinstance(stage, Estimator) else stage
        models = run.models[path]
        if all(hasattr(m, "selectedFeatures") for m in models.values()):
            rows = [(s, [frame.features[i] for i in sorted(m.selectedFeatures)]) for s, m in models.items()]
            run.labels[path] = f"selected_features_{label}"
            return keep_selected(frame, run.state(path, lambda: frame.df.sparkSession.createDataFrame(rows, "split_id long, selected array<string>")))
        found = [saved(m.transform(ready.where(F.col("split_id") == s)).select(*key, vector_to_array("_o").alias("_o"))) for s, m in models.items()]
        outputs = reduce(DataFrame.union, found)
        # as wide as the widest split's
        width = outputs.agg(F.max(F.size("_o"))).first()[0] or 0
        names = list(frame.features) if width == len(frame.features) else [f"{label}_{i}" for i in range(width)]
        value = lambda i: F.get("_o", F.lit(i)).cast(self.output_dtype or "double")
        return frame.on(frame.df.join(outputs, key, "left")).add({n: value(i) for i, n in enumerate(names)}, [])

    def inverse(self, frame, run, path, names):
        if self.inverse_function is None:
            raise ValueError(f"{self.name or type(self.stage).__name__} has no inverse")
        back = lambda n: F.coalesce(*[F.when(F.col("split_id") == s, self.inverse_function(m, c(n))) for s, m in run.models[path].items()])
        return frame.add({n: back(n) for n in names})


def importances(run, path: str, features: list[str]) -> dict:
    """{split_id: [(feature, importance)]}, greatest first, of a fitted tree model."""
    return {s: sorted(zip(features, map(float, m.featureImportances.toArray()), strict=True), key=lambda x: -x[1]) for s, m in run.models[path].items()}
