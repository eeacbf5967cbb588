"""Word counts, the online learner (batch, keyed, streaming) and the stream
jobs' restart behaviour."""

import os

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from seqlab.operators.online import gradient, learn_sequence, minibatch_step, perceptron_keyed
from seqlab.operators.text import word_count
from seqlab.streaming.jobs import (keyed_learner_stream, parse_instances, start_minibatch_learner, start_replayed_word_count,
                                   start_word_count, stream_lines)


def test_word_count_counts_empty_words(spark):
    df = spark.createDataFrame([("a a  b",), ("c",)], "text string")
    got = {r.word: r.n for r in word_count(df, "text").collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "": 1}


def test_one_learner_step_golden(spark):
    df = spark.createDataFrame([([2.0], 1)], "x array<double>, y int")
    W, b = minibatch_step(df, "x", "y", np.zeros((2, 1)), np.zeros(2), 1.0)
    assert np.allclose(W[:, 0], [-0.25, 0.25]) and np.allclose(b, [-0.125, 0.125])
    _, bc = minibatch_step(df, "x", "y", np.zeros((2, 1)), np.zeros(2), 1.0, bias_mode="compat")
    assert np.allclose(bc, [-0.25, 0.25])
    W2, b2 = np.zeros((2, 1)), np.zeros(2)
    learn_sequence(np.array([[2.0]]), np.array([1]), W2, b2, 1.0)
    assert np.allclose(W2, W) and np.allclose(b2, b)


def test_gradient_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X, y = rng.normal(size=(50, 4)), rng.integers(0, 3, 50)
    W, b = rng.normal(size=(3, 4)) * 0.1, rng.normal(size=3) * 0.1
    df = spark.createDataFrame([(X[i].tolist(), int(y[i])) for i in range(50)], "x array<double>, y int")
    g = {(r["class"], r["j"]): r["g"] for r in gradient(df, "x", "y", W.tolist(), b.tolist(), 4).collect()}
    p = 1 / (1 + np.exp(-(X @ W.T + b)))
    d = (np.eye(3)[y] - p) * p * (1 - p)
    assert np.allclose([[g[(c, j)] for j in range(4)] for c in range(3)], d.T @ X)
    assert np.allclose([g[(c, 4)] for c in range(3)], d.sum(axis=0))


def test_keyed_perceptron_equals_numpy_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(i), rng.normal(size=3).tolist(), int(rng.integers(0, 3))) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, x array<double>, y int").repartition(4)
    got = {(r.k, r.i): r.predicted for r in perceptron_keyed(df, "k", ["i"], "x", "y", 3, 3).collect()}
    for k in range(3):
        mine = sorted([r for r in rows if r[0] == k], key=lambda r: r[1])
        W, b = np.zeros((3, 3)), np.zeros(3)
        preds, _ = learn_sequence(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), W, b, 1.0)
        assert [got[(k, r[1])] for r in mine] == preds.tolist()


def test_stream_word_count_per_batch_and_restart(spark, tmp_dir):
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    os.makedirs(src)
    with open(f"{src}/1.txt", "w") as f:
        f.write("a a  b\nc\n")
    start_word_count(stream_lines(spark, src), out, ck, trigger={"availableNow": True}).awaitTermination()
    with open(f"{src}/2.txt", "w") as f:
        f.write("a\n")
    start_word_count(stream_lines(spark, src), out, ck, trigger={"availableNow": True}).awaitTermination()
    got = sorted((r.batch_id, r.word, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, "", 1), (0, "a", 2), (0, "b", 1), (0, "c", 1), (1, "a", 1)]


def test_replayed_lines_have_fixed_batches_and_repeat_nothing(spark, tmp_dir):
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"
    lines = spark.createDataFrame([(i, f"w{i} all") for i in range(10)] + [(10, None), (11, "")], "line long, value string")
    broken = lines.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    start_replayed_word_count(lines, 5, out, ck).awaitTermination()
    with pytest.raises(StreamingQueryException):
        start_replayed_word_count(broken, 5, out, ck).awaitTermination()
    for _ in range(4):  # the failed batch again, the last lines, and nothing beyond them
        start_replayed_word_count(lines, 5, out, ck).awaitTermination()
    got = sorted((r.batch_id, r.word, r.n) for r in spark.read.parquet(out).collect())
    assert got == sorted([(i // 5, f"w{i}", 1) for i in range(10)] + [(0, "all", 5), (1, "all", 5), (2, "", 1)])


def test_stream_learners(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    rng = np.random.default_rng(3)
    lines = [f"{i / 10:.4f},{rng.normal():.4f},{int(rng.integers(0, 2))}" for i in range(30)]
    with open(f"{src}/a.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    inst = parse_instances(stream_lines(spark, src), 2)
    q = start_minibatch_learner(inst, f"{tmp_dir}/state", f"{tmp_dir}/report", f"{tmp_dir}/ck", n_classes=2,
                                n_features=2, trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/report").first().n == 30
    assert spark.read.parquet(f"{tmp_dir}/state").count() == 2 * 3

    # Order of the instances: their first feature is increasing here.
    ordered = inst.withColumn("k", F.lit(0)).withColumn("i", F.col("x")[0])
    keyed = keyed_learner_stream(ordered, "k", "i", n_classes=2, n_features=2)
    q2 = (keyed.writeStream.format("memory").queryName("keyed_out").outputMode("append")
          .option("checkpointLocation", f"{tmp_dir}/ck2").trigger(availableNow=True).start())
    q2.awaitTermination()
    got = [r.predicted for r in spark.sql("SELECT * FROM keyed_out ORDER BY i").collect()]
    X = np.array([[float(v) for v in ln.split(",")[:2]] for ln in lines])
    y = np.array([int(ln.split(",")[2]) for ln in lines])
    preds, _ = learn_sequence(X, y, np.zeros((2, 2)), np.zeros(2), 1.0)
    assert got == preds.tolist()


def test_holdout_weights_equal_numpy(spark):
    from seqlab.operators.online import holdout_accuracy
    rng = np.random.default_rng(5)
    rows = [(0, i, rng.normal(size=3).tolist(), int(rng.integers(0, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, x array<double>, y int")
    w = perceptron_keyed(df.where("i < 40"), "k", ["i"], "x", "y", 3, 3, emit="weights").first()
    W, b = np.zeros((3, 3)), np.zeros(3)
    learn_sequence(np.array([r[2] for r in rows[:40]]), np.array([r[3] for r in rows[:40]]), W, b, 1.0)
    assert np.allclose(np.array(w.W), W) and np.allclose(np.array(w.b), b)
    acc = holdout_accuracy(spark.createDataFrame([(0, w.W, w.b)], "k int, W array<array<double>>, b array<double>"),
                           df.where("i >= 40"), "k", "x", "y").first()
    p = 1 / (1 + np.exp(-(np.array([r[2] for r in rows[40:]]) @ W.T + b)))
    expect = 100.0 * np.mean(np.argmax(p / p.sum(axis=1, keepdims=True), axis=1) == np.array([r[3] for r in rows[40:]]))
    assert abs(acc.accuracy - expect) < 1e-9 and acc.n == 20


def test_learner_stream_scores_later_batches_with_learned_weights(spark, tmp_dir):
    from seqlab.plans import streams
    rng = np.random.default_rng(8)
    X, y = rng.normal(size=(300, 64)).astype(np.float32) / 8, rng.integers(0, 10, 300)
    spark.createDataFrame([(i, X[i].tolist(), int(y[i])) for i in rng.permutation(300).tolist()],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    got = streams.q_learner_stream(spark, tmp_dir).collect()
    batches = streams.learner_batches(300)
    assert batches > 2 and len(got) == batches * 10 * 65
    W = np.zeros((10, 65))
    Z = np.hstack([X.astype(float), np.ones((300, 1))])
    for k in range(batches):
        own = np.arange(300) * batches // 300 == k
        p = 1 / (1 + np.exp(-(Z[own] @ W.T)))
        right = 100.0 * np.mean(np.argmax(p, axis=1) == y[own])
        W = W + ((np.eye(10)[y[own]] - p) * p * (1 - p)).T @ Z[own]
        rows = [r for r in got if r["batch_id"] == k]
        assert {(round(r["accuracy"], 9), r["n"]) for r in rows} == {(round(right, 9), int(own.sum()))}
        assert all(abs(r["w"] - W[r["class"], r["j"]]) < 1e-6 for r in rows)
    one = {(r["batch_id"], r["accuracy"], r["n"]) for r in streams.q_learner_stream(spark, tmp_dir, batches=1).collect()}
    assert one == {(0, 100.0 * float(np.mean(y == 0)), 300)}     # ONE_BATCH_SQL
