"""Text quality by a factorisation machine.

A document's features are its distinct words, hashed to buckets; statistics of
its structure, each put into one of a few bins; and its length as metadata. The
machine adds, to a linear part, pairwise interactions of low rank: features f
and g interact by the product of their factor vectors. All pairs together cost
linear time, as half of (sum of vectors)^2 less the sum of squared vectors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import documents, unused
from .labelled import held_out, sample
from .textnum import Words, distinct, utf8

BINS = 12
STATS = 15


def structure(raw: np.ndarray, borders: np.ndarray, words: Words) -> np.ndarray:
    """STATS numbers in 0..1 for each row."""
    n = np.maximum(np.diff(borders), 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return (total[borders[1:]] - total[borders[:-1]]) / n

    def of(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table

    count = np.diff(words.first)
    some = np.maximum(count, 1)
    size = (words.end - words.start).astype(np.float64)
    by_row = lambda v: np.bincount(words.row, v, len(count))
    value, place = distinct(words.hash, words.first)
    kinds = np.diff(place)
    again = np.zeros(len(words.hash))
    twice = np.zeros(len(words.hash))
    if len(words.hash) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        pair = words.hash[1:] * np.uint64(31) + words.hash[:-1]
        _, back, times = np.unique(pair ^ (words.row[1:].astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
        twice[1:] = times[back] > 1
    mean = by_row(size) / some
    spread = np.sqrt(np.maximum(by_row(size * size) / some - mean * mean, 0))
    letters = of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
    return np.column_stack([
        kinds / some, by_row(again) / some, by_row(twice) / some, np.minimum(mean / 20, 1), np.minimum(spread / 10, 1),
        share(letters), share(of(bytes(range(65, 91)))), share(of(b"0123456789")), share(of(b" \t")), share(of(b"\n\r")) * 10,
        share(of(b".,;:'\"")) * 4, share(of(b"!?")) * 4, share(of(b"|#*%$&@<>{}[]_=+~^\\/")) * 4, np.minimum(np.log1p(count) / 10, 1),
        np.minimum(np.log1p(np.diff(borders)) / 14, 1),
    ])


def features(column, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, their values, and each row's borders in them."""
    words = Words(column)
    raw, borders = utf8(column)
    stats = np.clip(structure(raw, borders, words), 0, 1)
    binned = (buckets + np.arange(STATS) * BINS + np.minimum(np.sqrt(stats) * BINS, BINS - 1).astype(np.int64)).astype(np.int32)
    bucket, place = distinct(words.hash % np.uint64(buckets), words.first)
    count = np.diff(place)
    at = np.repeat(place[1:], STATS)
    number = np.insert(bucket.astype(np.int32), at, binned.reshape(-1))
    value = np.insert(np.repeat(1 / np.sqrt(np.maximum(count, 1)), count), at, 0.5)
    return number, value.astype(np.float32), place + STATS * np.arange(len(place))


def raw_score(model: dict, number: np.ndarray, value: np.ndarray, borders: np.ndarray) -> np.ndarray:
    starts = borders[:-1]  # no row is without features
    vx = model["v"][number] * value[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    return model["w0"] + np.add.reduceat(model["w"][number] * value, starts) + 0.5 * ((total * total).sum(axis=1) - squares)


def fit(number: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, size: int, rank: int = 8, epochs: int = 8, step: float = 0.1, ridge: float = 2e-5) -> dict:
    """Logistic loss by AdaGrad in batches, in an order fixed by a seed."""
    rng = np.random.default_rng(7)
    model = {"w0": 0.0, "w": np.zeros(size, np.float32), "v": (0.01 * rng.standard_normal((size, rank))).astype(np.float32)}
    if not len(label):
        return model
    rate = np.clip(label.mean(), 0.01, 0.99)
    model["w0"] = float(np.log(rate / (1 - rate)))
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-2, np.float32)
    for _ in range(max(epochs, -(-200 * 128 // len(label)))):  # few rows are seen more often
        order = rng.permutation(len(label))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            sizes = np.array([len(number[i]) for i in rows])
            borders = np.concatenate([[0], np.cumsum(sizes)])
            num, val = np.concatenate([number[i] for i in rows]), np.concatenate([value[i] for i in rows])
            p = 1 / (1 + np.exp(-np.clip(raw_score(model, num, val, borders), -30, 30)))
            error = np.repeat((p - label[rows]) / len(rows), sizes).astype(np.float32) * val
            vx = model["v"][num] * val[:, None]
            total = np.repeat(np.add.reduceat(vx, borders[:-1], axis=0), sizes, axis=0)
            used, back = np.unique(num, return_inverse=True)
            dw = np.bincount(back, error, len(used)) + ridge * model["w"][used]
            each = error[:, None] * (total - vx)
            dv = np.column_stack([np.bincount(back, each[:, j], len(used)) for j in range(rank)]) + ridge * model["v"][used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            model["w"][used] -= step * dw / np.sqrt(gw[used])
            model["v"][used] -= step * dv / np.sqrt(gv[used])
            model["w0"] -= step * 0.1 * float((p - label[rows]).mean())
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 12_000, buckets: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model learnt in one task from at most rows labelled documents; the bound holds at any size of docs."""

    def describe(batches):
        for big in batches:
            for batch in slices(big):
                number, value, borders = features(batch.column(1), buckets)
                spans = pa.array(borders.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(spans, pa.array(number)), pa.ListArray.from_arrays(spans, pa.array(value)), batch.column(2)], ["id", "number", "value", "label"])

    def learn(data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("id")
        model = fit(list(data["number"]), list(data["value"]), data["label"].to_numpy(np.float64), buckets + STATS * BINS)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    chosen = sample(docs, labels, label, rows, id_col, text_col)
    described = chosen.mapInArrow(describe, f"id {chosen.schema['id'].dataType.simpleString()}, number array<int>, value array<float>, label int")
    found = described.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(learn, "model binary").first()
    model = pickle.loads(found["model"]) if found else fit([], [], np.empty(0), buckets + STATS * BINS)
    return model | {"buckets": buckets}


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs and a column name: the probability of good quality of each whole text.

    A null text counts as empty, which has a score too. Rows stand alone, so
    repeated rows get equal scores and null ids are kept. The new column takes
    the place of one of its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        for big in batches:
            for batch in slices(big):
                text = batch.column(at).cast(pa.string())
                p = 1 / (1 + np.exp(-np.clip(raw_score(own, *features(text, own["buckets"])), -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs whose quality is at least least, all columns as they were."""
    name = unused("_quality", docs.columns)
    return score(docs, train(docs, labels, text_col=text_col), text_col, name).where(F.col(name) >= least).drop(name)


def op9_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = score(docs.select("doc_id", "text"), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
