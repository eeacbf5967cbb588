"""Streaming queries over files written from the tables (file source,
``availableNow`` trigger), results read back from their sink tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from seqlab.functions.scan import global_rank
from seqlab.plans.docs import N_CLASSES, N_FEATURES, STREAM_ROWS
from seqlab.session import scratch_path
from seqlab.sources.tables import table
from seqlab.streaming.jobs import parse_instances, start_minibatch_learner, start_replayed_word_count, start_word_count, stream_lines

REPLAY_BATCHES = 4
FILE_ROWS = 100_000     # instances of a file; a range of more is several files


def _base(spark, name):
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")


def q_word_count_stream(spark, data_dir):
    """Document texts written as text files, counted by the streaming job
    (one micro-batch picks up all files present): ``batch_id, word, n``."""
    base = _base(spark, "wc")
    docs = table(spark, data_dir, "documents").select("text")
    if docs.isEmpty():  # a stream without files has no batch and writes no table
        return spark.createDataFrame([], "batch_id int, word string, n long")
    docs.write.mode("overwrite").text(f"{base}/in")
    q = start_word_count(stream_lines(spark, f"{base}/in"), f"{base}/out", f"{base}/ckpt",
                         trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("batch_id").cast("int").alias("batch_id"), "word", "n")


def q_word_count_replay(spark, data_dir, batches: int = REPLAY_BATCHES):
    """Document texts in id order as a line feed of ``batches`` equal batches,
    each counted after a start of its own: ``batch_id, word, n``."""
    base = _base(spark, "replay")
    docs = table(spark, data_dir, "documents").select("doc_id", "text")
    rows = docs.count()
    if not rows:
        return spark.createDataFrame([], "batch_id int, word string, n long")
    global_rank(docs, "doc_id", "text", name="line").select("line", F.col("text").alias("value")).write.parquet(f"{base}/in")
    size = -(-rows // batches)
    for _ in range(-(-rows // size)):
        start_replayed_word_count(spark.read.parquet(f"{base}/in"), size, f"{base}/out", f"{base}/ckpt").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("batch_id").cast("int").alias("batch_id"), "word", "n")


def learner_batches(rows: int) -> int:
    """Batches of the learner's stream: their number and their size both grow
    with the square root of the row count."""
    return math.ceil(math.sqrt(rows) / 8)


def q_learner_stream(spark, data_dir, batches: int | None = None):
    """Embeddings as instance lines (64 numbers, then the class), learned by
    the mini-batch stream learner in ordered ranges of ``vec_id``, one range a
    micro-batch; returns every batch's accuracy and the weights after it:
    ``batch_id, accuracy, n, class, j, w`` (``j = 64``: the bias)."""
    base = _base(spark, "learn")
    emb = table(spark, data_dir, "embeddings")
    rows = emb.count()
    if not rows:
        return spark.createDataFrame([], "batch_id int, accuracy double, n long, class int, j int, w double")
    batches = batches or learner_batches(rows)
    line = F.concat_ws(",", F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ","),
                       F.col("label").cast("string"))
    ranked = global_rank(emb.select("vec_id", line.alias("value")), "vec_id", "value")
    ranked = ranked.select("value", F.floor(F.col("rank") * batches / rows).alias("range"))
    ranked.repartition("range").write.partitionBy("range").text(f"{base}/ranges")
    files = -(-rows // max(1, batches) // FILE_ROWS) or 1
    for k in range(batches):  # the file source takes the oldest files first, of one age by path
        spark.read.text(f"{base}/ranges/range={k}").repartition(files).write.text(f"{base}/in/{k:09d}")
    inst = parse_instances(stream_lines(spark, f"{base}/in/*", max_files_per_trigger=files), N_FEATURES)
    q = start_minibatch_learner(inst, f"{base}/state", f"{base}/report", f"{base}/ckpt", n_classes=N_CLASSES,
                                n_features=N_FEATURES, trigger={"availableNow": True})
    q.awaitTermination()
    report, state = spark.read.parquet(f"{base}/report"), spark.read.parquet(f"{base}/state")
    return report.join(state, "batch_id").select(F.col("batch_id").cast("int").alias("batch_id"), "accuracy", "n",
                                                 "class", "j", "w")


def q_learner_stream_keyed(spark, data_dir):
    """Exact sequential learner on a stream of instance lines: one model per
    ``STREAM_ROWS`` consecutive ids, each learning its instances in ``vec_id``
    order, with the weights kept in Spark's state store."""
    from seqlab.streaming.jobs import keyed_learner_stream
    base = _base(spark, "keyed")
    emb = table(spark, data_dir, "embeddings")
    line = F.concat_ws(",", F.col("vec_id").cast("string"),
                       F.array_join(F.transform("embedding", lambda v: v.cast("string")), ","),
                       F.col("label").cast("string"))
    emb.select(line.alias("value")).write.mode("overwrite").text(f"{base}/in")
    lines = stream_lines(spark, f"{base}/in")
    f = F.split("value", ",", -1)
    inst = lines.select(F.element_at(f, 1).cast("long").alias("vec_id"),
                        F.transform(F.slice(f, 2, N_FEATURES), lambda v: v.cast("double")).alias("x"),
                        F.element_at(f, -1).cast("int").alias("y"))
    inst = inst.withColumn("group", F.floor(F.col("vec_id") / STREAM_ROWS))
    out = keyed_learner_stream(inst, "group", "vec_id", n_classes=N_CLASSES, n_features=N_FEATURES)
    q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


QUERIES = {
    "word_count_stream": q_word_count_stream,
    "word_count_replay": q_word_count_replay,
    "learner_stream": q_learner_stream,
    "learner_stream_keyed": q_learner_stream_keyed,
}

def _keyed_learner_oracle() -> str:
    from seqlab.plans.docs import _STREAM, _learner_sql
    return _learner_sql(key=_STREAM) + """
SELECT k AS "group", vec_id, predicted, correct FROM s WHERE i > 0"""


# All instances as one micro-batch: scored with the starting (zero) weights,
# whose equal votes all go to class 0.
ONE_BATCH_SQL = """SELECT 0 AS batch_id,
  CAST(100.0 * AVG(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS accuracy, COUNT(*) AS n
FROM embeddings"""


def _learner_stream_oracle() -> str:
    """Batch by batch: scored with the weights so far, then the summed gradient added."""
    return f"""WITH RECURSIVE e AS (
  SELECT CAST(embedding AS DOUBLE[]) AS x, label AS y, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS i, COUNT(*) OVER () AS n
  FROM embeddings),
r AS (SELECT i * CAST(ceil(sqrt(n) / 8) AS BIGINT) // n AS k, list(x ORDER BY i) AS X, list(y ORDER BY i) AS Y FROM e GROUP BY k),
s(k, W, acc, n) AS (
  SELECT -1::BIGINT, list_transform(range({N_CLASSES}), lambda c: list_transform(range({N_FEATURES + 1}), lambda j: 0.0::DOUBLE)),
         NULL::DOUBLE, NULL::BIGINT
  UNION ALL
  SELECT r.k,
         list_transform(s.W, lambda w, c: list_transform(w, lambda v, j: v + list_sum(list_transform(pp.P, lambda p, i:
           ((CASE WHEN r.Y[i] = c - 1 THEN 1.0 ELSE 0.0 END) - p[c]) * p[c] * (1.0 - p[c])
           * CASE WHEN j > {N_FEATURES} THEN 1.0 ELSE r.X[i][j] END)))),
         100.0 * list_avg(list_transform(pp.P, lambda p, i: CASE WHEN list_position(p, list_max(p)) - 1 = r.Y[i] THEN 1.0 ELSE 0.0 END)),
         len(r.Y)
  FROM s JOIN r ON r.k = s.k + 1,
  LATERAL (SELECT list_transform(r.X, lambda x: list_transform(s.W, lambda w:
             1.0 / (1.0 + exp(-(list_dot_product(w[1:{N_FEATURES}], x) + w[{N_FEATURES + 1}]))))) AS P) AS pp)
SELECT CAST(k AS INTEGER) AS batch_id, acc AS accuracy, n, CAST(c AS INTEGER) AS class, CAST(j AS INTEGER) AS j, W[c + 1][j + 1] AS w
FROM s, range({N_CLASSES}) AS cs(c), range({N_FEATURES + 1}) AS js(j) WHERE k >= 0"""


ORACLES = {
    # One micro-batch holds every instance; each stream learns its instances
    # in vec_id order.
    "learner_stream_keyed": _keyed_learner_oracle(),
    "learner_stream": _learner_stream_oracle(),
    "word_count_stream": """SELECT 0 AS batch_id, word, COUNT(*) AS n FROM (
  SELECT unnest(string_split(line, ' ')) AS word
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l) w GROUP BY word""",
    "word_count_replay": f"""WITH d AS (
  SELECT text, ROW_NUMBER() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) - 1 AS i, COUNT(*) OVER () AS n FROM documents),
b AS (SELECT text, i // CAST(ceil(n / {REPLAY_BATCHES}.0) AS BIGINT) AS k FROM d)
SELECT CAST(k AS INTEGER) AS batch_id, word, COUNT(*) AS n FROM (
  SELECT k, unnest(string_split(line, ' ')) AS word
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM b) l) w GROUP BY k, word""",
}
