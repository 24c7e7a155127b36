"""Models of sessions from MLlib, and a hidden Markov chain for each symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators.features import FEATURES, KEY
from marketlens.operators.states import split_day


def _assembled(rows: DataFrame, learned: str = "true") -> DataFrame:
    """rows with `features`, scaled as those rows are that are learned from."""
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(rows)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(wide.filter(learned)).transform(wide)


def _split(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Sessions with a state and a label, `up`, and whether they are held out: those of the last fifth of days."""
    rows = features.filter("state is not null").join(labels.filter("label is not null"), KEY).withColumn("up", (F.col("label") > 0).cast("double"))
    return rows.join(F.broadcast(split_day(features))).withColumn("held_out", F.col("session") > F.col("until")).drop("until")


def label_model(features: DataFrame, labels: DataFrame) -> DataFrame:
    """symbol, session, label, held_out, p_up by a logistic regression, for all; neither its weights nor the scale of the features see the held-out fifth."""
    rows = _assembled(_split(features, labels), "not held_out")
    model = LogisticRegression(labelCol="up", regParam=0.01, maxIter=50).fit(rows.filter("not held_out"))
    return model.transform(rows).select(*KEY, "label", "held_out", vector_to_array("probability")[1].alias("p_up"))


def label_model_quality(features: DataFrame, labels: DataFrame) -> DataFrame:
    """held_out, n, accuracy, brier, log_loss of label_model, on the sessions that it learned from and on the rest."""
    rows = label_model(features, labels).withColumn("up", (F.col("label") > 0).cast("double"))
    right = ((F.col("p_up") >= 0.5).cast("double") == F.col("up")).cast("double")
    loss = -F.log(F.when(F.col("up") == 1, F.col("p_up")).otherwise(1 - F.col("p_up")))
    return rows.groupBy("held_out").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg((F.col("p_up") - F.col("up")) ** 2).alias("brier"), F.avg(loss).alias("log_loss"))


def state_prediction(features: DataFrame, labels: DataFrame) -> DataFrame:
    """model, n, accuracy, brier on held-out sessions: the share of rises before, of all sessions (`base`) and by state (`state`), smoothed by one of each outcome."""
    rows = _split(features, labels)
    known, later = rows.filter("not held_out"), rows.filter("held_out")
    out = []
    for model, by in (("base", F.lit("any")), ("state", F.col("state"))):
        rate = known.groupBy(by.alias("by")).agg(((F.sum("up") + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
        told = later.withColumn("by", by).join(rate, "by", "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
        right = ((F.col("p") >= 0.5).cast("double") == F.col("up")).cast("double")
        out.append(told.agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg((F.col("p") - F.col("up")) ** 2), 6).alias("brier")))
    return out[0].unionByName(out[1])


def state_mixture(features: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """symbol, session, cluster, likelihood by a Gaussian mixture over the features: the emissions of a state model."""
    rows = _assembled(features)
    model = GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows)
    return model.transform(rows).select(*KEY, F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("likelihood"))


def baum_welch(x: np.ndarray, k: int = 2, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each state at each step, log likelihood by round) of a chain with Gaussian emissions, states in the order of their means."""
    x = (x - x.mean()) / (x.std() or 1)
    mean = np.quantile(x, (np.arange(k) + 0.5) / k)
    var, start, move, said = np.full(k, 1.0), np.full(k, 1 / k), np.full((k, k), 0.2 / max(k - 1, 1)), []
    np.fill_diagonal(move, 0.8 if k > 1 else 1.0)
    for _ in range(rounds):
        emit = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        ahead, scale, back = np.empty((len(x), k)), np.empty(len(x)), np.ones((len(x), k))
        for t in range(len(x)):
            a = (start if t == 0 else ahead[t - 1] @ move) * emit[t]
            scale[t] = a.sum()
            ahead[t] = a / scale[t]
        for t in range(len(x) - 2, -1, -1):
            back[t] = move @ (emit[t + 1] * back[t + 1]) / scale[t + 1]
        post = ahead * back
        post /= post.sum(1, keepdims=True)
        said.append(float(np.log(scale).sum()))
        if len(x) > 1:
            pair = sum(np.outer(ahead[t], emit[t + 1] * back[t + 1]) * move / scale[t + 1] for t in range(len(x) - 1))
            move = pair / pair.sum(1, keepdims=True)
        start, weight = post[0], post.sum(0)
        mean = (post * x[:, None]).sum(0) / weight
        var = np.maximum((post * (x[:, None] - mean) ** 2).sum(0) / weight, 1e-3)
    order = np.argsort(mean, kind="stable")
    return post[:, order], np.array(said)


def hidden_states(features: DataFrame, column: str = "va_width", k: int = 2) -> DataFrame:
    """symbol, session, hidden, posterior: the likeliest state of a chain fitted to each symbol's sessions, one group a symbol."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("session")
        post, _ = baum_welch(rows["x"].to_numpy(float), k)
        return pd.DataFrame({"symbol": rows["symbol"].to_numpy(), "session": rows["session"].to_numpy(), "hidden": post.argmax(1).astype("int32"), "posterior": post.max(1)})

    return features.select(*KEY, F.col(column).cast("double").alias("x")).groupBy("symbol").applyInPandas(fit, "symbol string, session date, hidden int, posterior double")
