"""Structured Streaming jobs: per-batch word counts and online learners.

Every job reads new text files of a folder (or a socket, for interactive
use), keeps its progress in a checkpoint folder, and writes each micro-batch
idempotently: results land in the ``batch_id=<n>`` partition of a Parquet
table with dynamic partition overwrite, so a batch re-run after a failure
replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from seqlab.operators.online import learn_sequence, minibatch_step, prequential_accuracy
from seqlab.operators.text import word_count


def stream_lines(spark: SparkSession, source: str, *, fmt: str = "text", host: str | None = None,
                 port: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines of new files in a folder (each file read once), or of a socket
    (``fmt='socket'``; not fault tolerant, for interactive use only)."""
    if fmt == "socket":
        return spark.readStream.format("socket").option("host", host).option("port", port).load()
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source)


def parse_instances(lines: DataFrame, n_features: int, on_bad: str = "error") -> DataFrame:
    """``x1,...,xF,class`` lines into ``x array<double>, y int`` (the last
    field is the class). A line with other than ``n_features + 1`` numbers
    fails the job (``on_bad='error'``) or is left out (``'drop'``)."""
    f = F.split("value", ",", -1)
    numbers = F.transform(f, lambda v: F.trim(v).try_cast("double"))
    good = (F.size(f) == n_features + 1) & F.forall(numbers, lambda v: v.isNotNull())
    if on_bad == "drop":
        lines = lines.where(F.coalesce(good, F.lit(False)))
        x = numbers
    else:
        x = F.when(good, numbers).otherwise(F.raise_error(F.concat(F.lit("not an instance line: "), F.coalesce("value", F.lit("NULL")))))
    return lines.select(F.slice(x, 1, n_features).alias("x"), F.element_at(numbers, -1).cast("int").alias("y"),
                        *[c for c in lines.columns if c != "value"])


def _write_batch(df: DataFrame, out: str, epoch: int) -> None:
    (df.withColumn("batch_id", F.lit(epoch)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))


def start_word_count(lines: DataFrame, out: str, checkpoint: str, *, trigger: dict | None = None,
                     peek: int = 0):
    """Word count of every micro-batch on its own (not a running total).

    ``peek`` prints the first rows of each batch's counts (console check).
    Empty batches write nothing.
    """
    def per_batch(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        counts = word_count(batch, "value")
        _write_batch(counts, out, epoch)
        if peek:
            counts.limit(peek).show(peek, truncate=False)

    w = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def start_replayed_word_count(lines: DataFrame, rows_per_batch: int, out: str, checkpoint: str, *,
                              position: str = "line", text_col: str = "value"):
    """Word count of the next ``rows_per_batch`` lines of a numbered line table
    (``position`` 0, 1, 2, ...): a line feed without a port.

    The stream's offsets are line positions, kept in the checkpoint folder, so
    batch ``k`` is lines ``k * rows_per_batch`` onwards whatever the cluster
    does; a batch that failed is read again from the table, and its counts
    replace what it wrote. Every start takes one batch; a start beyond the last
    line writes nothing. The table should be laid out by position (sorted
    Parquet): a batch's range is a filter on it.
    """
    def per_batch(batch: DataFrame, epoch: int) -> None:
        first, last = batch.agg(F.min("value"), F.max("value")).first()
        own = lines.where(F.col(position).between(first, last)) if first is not None else lines.limit(0)
        if not own.isEmpty():
            _write_batch(word_count(own, text_col), out, epoch)

    feed = (lines.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch)
            .option("startTimestamp", 0).load())
    return (feed.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _latest_weights(spark: SparkSession, state: str, n_classes: int, n_features: int, before: int):
    """Weights written by the last batch before ``before``: first the
    previous batch's partition only (partition pruning, the usual case), else
    the newest earlier partition."""
    W, b = np.zeros((n_classes, n_features)), np.zeros(n_classes)
    try:
        tab = spark.read.parquet(state)
    except AnalysisException as e:  # only a missing or still empty folder means "nothing written yet"
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return W, b
    rows = tab.where(F.col("batch_id") == before - 1).collect()  # C x (F+1) cells
    if not rows:
        last = tab.where(F.col("batch_id") < before).agg(F.max("batch_id").alias("b")).first()["b"]
        if last is None:
            return W, b
        rows = tab.where(F.col("batch_id") == last).collect()
    for r in rows:
        if r["j"] == n_features:
            b[r["class"]] = r["w"]
        else:
            W[r["class"], r["j"]] = r["w"]
    return W, b


def start_minibatch_learner(instances: DataFrame, state: str, report: str, checkpoint: str, *, n_classes: int,
                            n_features: int, lr: float = 1.0, bias_mode: str = "plain",
                            trigger: dict | None = None):
    """Online learner, one update per micro-batch: score the batch with the
    current weights (test), then add the batch gradient (train). Weights of
    every batch are kept in ``state`` (``batch_id, class, j, w``) and the
    per-batch accuracy in ``report``; a restarted query continues from the
    last weights written before its batch."""
    from seqlab.operators.online import class_scores, normalise_votes, predict_class

    def per_batch(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        W, b = _latest_weights(spark, state, n_classes, n_features, epoch)
        scored = batch.select((predict_class(normalise_votes(class_scores("x", W.tolist(), b.tolist())))
                               == F.col("y")).alias("correct"))
        _write_batch(prequential_accuracy(scored), report, epoch)
        W2, b2 = minibatch_step(batch, "x", "y", W, b, lr, bias_mode)
        rows = [(c, j, float(W2[c, j])) for c in range(n_classes) for j in range(n_features)]
        rows += [(c, n_features, float(b2[c])) for c in range(n_classes)]
        _write_batch(spark.createDataFrame(rows, "class int, j int, w double"), state, epoch)

    w = instances.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def keyed_learner_stream(instances: DataFrame, key_col: str, order_col: str, *, n_classes: int, n_features: int,
                         lr: float = 1.0, bias_mode: str = "plain") -> DataFrame:
    """Exact sequential learner per key on a stream: the weights of each key
    live in Spark's state store; inside a batch a key's rows are learned in
    ``order_col`` order (test-then-train). Output: ``key, order, predicted,
    correct``."""
    out_schema = T.StructType([
        T.StructField(key_col, instances.schema[key_col].dataType),
        T.StructField(order_col, instances.schema[order_col].dataType),
        T.StructField("predicted", T.IntegerType()), T.StructField("correct", T.BooleanType())])
    state_schema = T.StructType([T.StructField("w", T.ArrayType(T.DoubleType()))])

    def fn(key, pdfs, state):
        if state.exists:
            flat = np.asarray(state.get[0], dtype=float)
        else:
            flat = np.zeros(n_classes * (n_features + 1))
        W = flat[: n_classes * n_features].reshape(n_classes, n_features).copy()
        b = flat[n_classes * n_features:].copy()
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(order_col, kind="stable")
        X = np.stack([np.asarray(v, dtype=float) for v in rows["x"]])
        preds, ok = learn_sequence(X, rows["y"].to_numpy(), W, b, lr, bias_mode)
        state.update((np.concatenate([W.ravel(), b]).tolist(),))
        yield pd.DataFrame({key_col: rows[key_col].to_numpy(), order_col: rows[order_col].to_numpy(),
                            "predicted": preds, "correct": ok})

    return instances.groupBy(key_col).applyInPandasWithState(
        fn, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
