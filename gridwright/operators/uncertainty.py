"""Ensembles of small networks: predictions and how far the members disagree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that each member is trained on at most, drawn by a hash; predictions are made for all rows.
TRAINING_ROWS = 20_000


class Network:
    """A regression network with two hidden layers (64 and 32 units), trained by Adam on batches."""

    def __init__(self, seed: int, hidden: tuple[int, int] = (64, 32), epochs: int = 60, rate: float = 0.005, batch: int = 64):
        self.seed, self.hidden, self.epochs, self.rate, self.batch = seed, hidden, epochs, rate, batch

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        self.y_mean, self.y_scale = float(y.mean()), float(y.std()) or 1.0
        x, y = (x - self.mean) / self.scale, (y - self.y_mean) / self.y_scale
        sizes = [x.shape[1], *self.hidden, 1]
        w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        b = [np.zeros(n) for n in sizes[1:]]
        params = w + b
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(self.epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), self.batch):
                at = order[start : start + self.batch]
                layers = [x[at]]
                for k in range(2):
                    layers.append(np.maximum(layers[-1] @ w[k] + b[k], 0))
                error = (layers[-1] @ w[2] + b[2])[:, 0] - y[at]
                delta = error[:, None] / len(at)
                grads_w, grads_b = [], []
                for k in (2, 1, 0):
                    grads_w.insert(0, layers[k].T @ delta)
                    grads_b.insert(0, delta.sum(0))
                    delta = (delta @ w[k].T) * (layers[k] > 0)
                step += 1
                for i, (p, g) in enumerate(zip(params, grads_w + grads_b)):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    p -= self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.b = w, b
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        h = (x - self.mean) / self.scale
        for k in range(2):
            h = np.maximum(h @ self.w[k] + self.b[k], 0)
        return (h @ self.w[2] + self.b[2])[:, 0] * self.y_scale + self.y_mean


def ensemble(df: DataFrame, key: str, features: str, target: str, members: int = 5, seed: int = 0) -> DataFrame:
    """``key, mean_prediction, std_prediction``: members differ by their start and their resample of the training rows.

    Members train side by side, a task each, on a sample of bounded size; the models (some kilobytes) go out to all rows in
    a broadcast variable. Rows without target are predicted too, rows without features are left out.
    """
    spark = df.sparkSession
    rows = df.where(F.col(features).isNotNull())
    train = rows.where(F.col(target).isNotNull()).select(F.col(features).alias("x"), F.col(target).cast("double").alias("y"), F.xxhash64(key, F.lit(seed)).alias("o"))
    train = train.orderBy("o").limit(TRAINING_ROWS)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        import pickle

        number = int(group["member"].iloc[0])
        rng = np.random.default_rng([seed, number])
        group = group.sort_values("o", kind="stable")
        x, y = np.stack(group["x"].to_numpy()).astype(float), group["y"].to_numpy(dtype=float)
        at = rng.integers(0, len(x), len(x))
        return pd.DataFrame({"member": [number], "model": [pickle.dumps(Network(seed + number).fit(x[at], y[at]))]})

    dealt = train.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    models = [r["model"] for r in dealt.groupBy("member").applyInPandas(fit, "member int, model binary").orderBy("member").collect()]
    spread = spark.sparkContext.broadcast([bytes(m) for m in models])

    @F.pandas_udf("mean_prediction double, std_prediction double")
    def predict(values: pd.Series) -> pd.DataFrame:
        import pickle

        x = np.stack(values.to_numpy()).astype(float) if len(values) else np.empty((0, 1))
        p = np.array([pickle.loads(m).predict(x) for m in spread.value]) if len(x) and spread.value else np.zeros((1, len(x)))
        return pd.DataFrame({"mean_prediction": p.mean(0), "std_prediction": p.std(0)})

    return rows.select(key, predict(F.col(features)).alias("p")).select(key, "p.*")


def uncertainty_summary(predictions: DataFrame) -> DataFrame:
    """``mean_value, mean_std, p95_std``"""
    return predictions.agg(F.avg("mean_prediction").alias("mean_value"), F.avg("std_prediction").alias("mean_std"), F.expr("percentile(std_prediction, 0.95)").alias("p95_std"))
