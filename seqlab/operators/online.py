"""Online multi-class perceptron (sigmoid units, squared-error gradient).

Per instance ``x`` (features) with class ``y``, for every class ``c``:
``p_c = sigmoid(w_c . x + b_c)``, ``delta_c = ([c == y] - p_c) p_c (1 - p_c)``,
``w_c += lr delta_c x``, ``b_c += lr delta_c``. The prediction is the first
class with the largest normalised vote ``p_c / sum(p)``.

Two distributed forms:

* :func:`gradient` / :func:`minibatch_step`: the gradient of a whole batch is
  one aggregation over ``(class, feature)`` (map-side combined), and the small
  ``C x F`` model is updated once per batch.
* :func:`perceptron_keyed`: one model per key, strictly sequential inside the
  key in event order (the reference's test-then-train loop). Rows reach the
  Python worker in Arrow batches of a sorted partition, so memory does not
  grow with the size of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest model (classes x features) inlined into expressions.
MAX_MODEL_CELLS = 1_000_000


def _lit_matrix(W: Sequence[Sequence[float]]) -> Column:
    if sum(len(r) for r in W) > MAX_MODEL_CELLS:
        raise ValueError("model too large to inline")
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in W])


def _x(x_col: str | Column) -> Column:
    c = F.col(x_col) if isinstance(x_col, str) else x_col
    return c.cast(T.ArrayType(T.DoubleType()))


def class_scores(x_col: str | Column, W: Sequence[Sequence[float]], b: Sequence[float]) -> Column:
    """``array<double>`` of ``sigmoid(w_c . x + b_c)`` for every class."""
    x = _x(x_col)
    # cast: without classes the literals have no type
    Wl = _lit_matrix(W).cast("array<array<double>>")
    bl = F.array(*[F.lit(float(v)) for v in b]).cast("array<double>")
    return F.transform(Wl, lambda w, c: F.lit(1.0) / (F.lit(1.0) + F.exp(-(
        F.aggregate(F.zip_with(w, x, lambda a, v: a * v), F.lit(0.0), lambda acc, v: acc + v)
        + F.element_at(bl, c + 1)))))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise_votes(scores: Column) -> Column:
    return _once(scores, lambda s: _once(F.aggregate(s, F.lit(0.0), lambda a, y: a + y),
                                         lambda total: F.transform(s, lambda v: v / total)))


def predict_class(scores: Column) -> Column:
    """0-based index of the first largest score."""
    return _once(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))


def gradient(df: DataFrame, x_col: str, y_col: str, W: Sequence[Sequence[float]], b: Sequence[float],
             n_features: int, bias_mode: str = "plain") -> DataFrame:
    """Summed update directions ``(class, j, g)`` of one batch; ``j ==
    n_features`` is the bias. ``bias_mode='compat'`` also adds ``delta * y``
    to the bias (the reference's loop runs one slot too far, into the label)."""
    C = len(W)
    scores = class_scores(x_col, W, b)
    y = F.col(y_col).cast("int")
    deltas = F.transform(scores, lambda p, c: (F.when(c == y, 1.0).otherwise(0.0) - p) * p * (F.lit(1.0) - p))
    # the bias is one more feature, so one pass over the batch gives the whole gradient
    bias_w = (F.lit(1.0) + y.cast("double")) if bias_mode == "compat" else F.lit(1.0)
    features = F.concat(F.slice(_x(x_col), 1, n_features), F.array(bias_w))
    base = df.select(features.alias("__x"), deltas.alias("__d"))
    both = (base.select("__d", F.posexplode("__x").alias("j", "xj"))
            .groupBy("j").agg(*[F.sum(F.col("__d")[c] * F.col("xj")).alias(f"g{c}") for c in range(C)]))
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"g{c}").alias("g")) for c in range(C)]))
    return both.select("j", stacked.alias("s")).select(F.col("s.cls").alias("class"), "j", F.col("s.g").alias("g"))


def minibatch_step(df: DataFrame, x_col: str, y_col: str, W: np.ndarray, b: np.ndarray, lr: float = 1.0,
                   bias_mode: str = "plain") -> tuple[np.ndarray, np.ndarray]:
    """New ``(W, b)`` after one batch. Only the ``C x (F+1)`` gradient table
    reaches the driver."""
    C, Fn = W.shape
    g = gradient(df, x_col, y_col, W.tolist(), b.tolist(), Fn, bias_mode).collect()
    W2, b2 = W.astype(float).copy(), b.astype(float).copy()
    for r in g:
        if r["g"] is None:
            continue
        if r["j"] == Fn:
            b2[r["class"]] += lr * r["g"]
        else:
            W2[r["class"], r["j"]] += lr * r["g"]
    return W2, b2


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-z))


def learn_sequence(X: np.ndarray, y: np.ndarray, W: np.ndarray, b: np.ndarray, lr: float,
                   bias_mode: str = "plain") -> tuple[np.ndarray, np.ndarray]:
    """Test-then-train over rows in order; returns (predictions, correct)
    and updates ``W``/``b`` in place. Plain numpy helper of one key."""
    preds = np.empty(len(X), dtype=np.int32)
    for i in range(len(X)):
        p = _sigmoid(W @ X[i] + b)
        votes = p / p.sum()
        preds[i] = int(np.argmax(votes))
        target = np.zeros(len(b))
        target[int(y[i])] = 1.0
        d = (target - p) * p * (1.0 - p)
        W += lr * np.outer(d, X[i])
        b += lr * d * ((1.0 + float(y[i])) if bias_mode == "compat" else 1.0)
    return preds, preds == y.astype(np.int32)


def perceptron_keyed(df: DataFrame, key_col: str, order_cols: Sequence[str], x_col: str, y_col: str,
                     n_classes: int, n_features: int, lr: float = 1.0, bias_mode: str = "plain",
                     init_seed: int | None = None, emit: str = "predictions") -> DataFrame:
    """Per key, in order: predict each instance, then learn from it.

    ``emit='predictions'`` returns ``key, *order_cols, predicted, correct``;
    ``emit='weights'`` returns ``key, W array<array<double>>, b
    array<double>`` after the last instance of each key. Weights start at
    zero or uniform in ``[-0.1, 0.1)`` from ``init_seed`` (same start for
    every key). Partitioned by key and sorted inside partitions; a key's rows
    stream through in Arrow batches with its weights kept between batches.
    """
    if init_seed is None:
        W0 = np.zeros((n_classes, n_features))
        b0 = np.zeros(n_classes)
    else:
        rng = np.random.default_rng(init_seed)
        init = rng.uniform(-0.1, 0.1, size=(n_classes, n_features + 1))
        W0, b0 = init[:, :n_features], init[:, n_features]
    fields = df.select(key_col, *order_cols).schema.fields
    if emit == "weights":
        schema = T.StructType([fields[0], T.StructField("W", T.ArrayType(T.ArrayType(T.DoubleType()))),
                               T.StructField("b", T.ArrayType(T.DoubleType()))])
    else:
        schema = T.StructType([*fields, T.StructField("predicted", T.IntegerType()),
                               T.StructField("correct", T.BooleanType())])
    keep = [key_col, *order_cols]

    def finished(key, W, b):
        return pd.DataFrame({key_col: [key], "W": [W.tolist()], "b": [b.tolist()]})

    def run(batches):
        # Rows arrive sorted by key (NULL keys are one key): only the model of
        # the key being read is held.
        key, W, b = None, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            for k, g in pdf.groupby(key_col, sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if W is None or k != key:
                    if W is not None and emit == "weights":
                        yield finished(key, W, b)
                    key, W, b = k, W0.copy(), b0.copy()
                X = np.stack([np.asarray(v, dtype=float) for v in g[x_col]])
                preds, ok = learn_sequence(X, g[y_col].to_numpy(), W, b, lr, bias_mode)
                part = g[keep].copy()
                part["predicted"] = preds
                part["correct"] = ok
                out.append(part)
            if emit != "weights":
                yield pd.concat(out, ignore_index=True)
        if emit == "weights" and W is not None:
            yield finished(key, W, b)

    ordered = df.select(*keep, x_col, y_col).repartition(key_col).sortWithinPartitions(key_col, *order_cols)
    return ordered.mapInPandas(run, schema)


def holdout_accuracy(weights: DataFrame, test: DataFrame, key_col: str, x_col: str, y_col: str) -> DataFrame:
    """Accuracy (percent) of each key's final weights on its test rows; the
    weights table (one model per key) is joined on the key."""
    j = test.join(weights, key_col)
    x = _x(x_col)
    scores = F.transform("W", lambda w, c: F.lit(1.0) / (F.lit(1.0) + F.exp(-(
        F.aggregate(F.zip_with(w, x, lambda a, v: a * v), F.lit(0.0), lambda acc, v: acc + v)
        + F.element_at(F.col("b"), c + 1)))))
    ok = (predict_class(normalise_votes(scores)) == F.col(y_col).cast("int")).cast("double")
    return j.groupBy(key_col).agg((F.lit(100.0) * F.avg(ok)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def prequential_accuracy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percent of correct test-then-train predictions (per ``by`` group)."""
    agg = [(F.lit(100.0) * F.avg(F.col("correct").cast("double"))).alias("accuracy"),
           F.count(F.lit(1)).alias("n")]
    return pred.groupBy(*by).agg(*agg) if by else pred.agg(*agg)
