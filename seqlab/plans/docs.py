"""Word counts, line filters, hold-out error and the online learner on the
``documents``, ``labels`` and ``embeddings`` tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqlab.operators.online import (class_scores, gradient, holdout_accuracy, normalise_votes, perceptron_keyed,
                                     predict_class, prequential_accuracy)
from seqlab.operators.text import contains_count, word_count
from seqlab.sources.tables import table

N_CLASSES = 10
N_FEATURES = 64
MAX_MODEL_CELLS = 1_000_000


def q_word_count(spark, data_dir):
    return word_count(table(spark, data_dir, "documents").select("text"), "text")


def q_contains_count(spark, data_dir):
    """Lines of all documents containing ``a`` and containing ``b``."""
    lines = table(spark, data_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.agg(contains_count("line", "a").alias("lines_a"), contains_count("line", "b").alias("lines_b"))


def q_error_rate(spark, data_dir):
    """Hold-out style error of a fixed rule (long documents are good) against
    the quality labels; label and prediction stay side by side per row."""
    docs = table(spark, data_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, data_dir, "labels").select("doc_id", "quality")
    pred = labels.join(docs, "doc_id").select(
        F.col("quality").cast("double").alias("label"),
        F.when(F.col("n_chars") >= 1000, 1.0).otherwise(0.0).alias("prediction"))
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.avg((F.col("label") != F.col("prediction")).cast("double")).alias("test_error"))


def centroid_model(spark, data_dir):
    """Class centroids of the embeddings as a weight matrix. Classes and
    features are counted in the table; ``C x F`` cells reach the driver, and
    more than ``MAX_MODEL_CELLS`` of them are refused before that."""
    emb = table(spark, data_dir, "embeddings")
    size = emb.agg((F.max("label") + 1).alias("c"), F.max(F.size("embedding")).alias("f")).first()
    n_classes, n_features = size["c"] or 0, size["f"] or 0
    if n_classes * n_features > MAX_MODEL_CELLS:
        raise ValueError("model too large")
    per = (emb.select("label", F.posexplode("embedding").alias("j", "x"))
           .groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("w")))
    W = np.zeros((n_classes, n_features))
    for r in per.where(F.col("label").isNotNull()).collect():
        W[r["label"], r["j"]] = r["w"]
    return W, np.zeros(n_classes)


def _round6(c):
    return F.transform(c, lambda v: F.round(v, 6))


def q_class_scores(spark, data_dir):
    W, b = centroid_model(spark, data_dir)
    emb = table(spark, data_dir, "embeddings")
    return emb.select("vec_id", _round6(class_scores("embedding", W.tolist(), b.tolist())).alias("scores"))


def q_predict_class(spark, data_dir):
    W, b = centroid_model(spark, data_dir)
    emb = table(spark, data_dir, "embeddings")
    s = class_scores("embedding", W.tolist(), b.tolist())
    votes = normalise_votes(s)
    return emb.select("vec_id", "label", predict_class(votes).alias("predicted"),
                      F.round(F.array_max(votes), 6).alias("top_vote"))


def q_gradient_step(spark, data_dir):
    """One mini-batch step from zero weights, learning rate 1, over all
    embeddings: ``(class, j, w)``; ``j = 64`` is the bias."""
    emb = table(spark, data_dir, "embeddings")
    g = gradient(emb, "embedding", "label", np.zeros((N_CLASSES, N_FEATURES)).tolist(), [0.0] * N_CLASSES,
                 N_FEATURES)
    return g.select(F.col("class").cast("int").alias("class"), F.col("j").cast("int").alias("j"),
                    F.round("g", 6).alias("w"))


# Consecutive ids that make one learner's stream: the number of streams grows
# with the table, and no stream is ever a large share of it.
STREAM_ROWS = 50


def _streams(spark, data_dir):
    return table(spark, data_dir, "embeddings").withColumn("stream", F.floor(F.col("vec_id") / STREAM_ROWS))


def q_perceptron_keyed(spark, data_dir):
    """Test-then-train over all embeddings, one model per stream of
    ``STREAM_ROWS`` consecutive ids, in ``vec_id`` order."""
    emb = _streams(spark, data_dir)
    return perceptron_keyed(emb, "stream", ["vec_id"], "embedding", "label", N_CLASSES, N_FEATURES, lr=1.0)


def q_holdout_accuracy(spark, data_dir):
    """Reference's offline test per stream: one sequential pass over 70 % of
    its embeddings (hash split of ``vec_id``, in ``vec_id`` order), accuracy of
    the final weights on the other 30 %."""
    from seqlab.operators.encode import hash_split
    emb, flag = _streams(spark, data_dir), hash_split("vec_id", 70)
    models = perceptron_keyed(emb.where(flag), "stream", ["vec_id"], "embedding", "label", N_CLASSES, N_FEATURES,
                              emit="weights")
    return holdout_accuracy(models, emb.where(~flag), "stream", "embedding", "label")


def q_prequential_accuracy(spark, data_dir):
    return prequential_accuracy(q_perceptron_keyed(spark, data_dir), by=["stream"])


QUERIES = {
    "word_count": q_word_count,
    "contains_count": q_contains_count,
    "error_rate": q_error_rate,
    "class_scores": q_class_scores,
    "predict_class": q_predict_class,
    "gradient_step": q_gradient_step,
    "perceptron_keyed": q_perceptron_keyed,
    "prequential_accuracy": q_prequential_accuracy,
    "holdout_accuracy": q_holdout_accuracy,
}

_CENTROIDS = """c AS (
  SELECT label AS cls, j, avg(CAST(x AS DOUBLE)) AS w
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) u
  GROUP BY label, j),
xs AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
z AS (
  SELECT xs.vec_id, c.cls, 1.0 / (1.0 + exp(-SUM(c.w * CAST(xs.x AS DOUBLE)))) AS p
  FROM xs JOIN c ON xs.j = c.j GROUP BY xs.vec_id, c.cls)"""

def _learner_sql(where: str = "TRUE", key: str = "0") -> str:
    """The sequential test-then-train learner as a recursive CTE over the
    instances of each ``key`` in ``vec_id`` order (state: the weight lists)."""
    return f"""WITH RECURSIVE r AS (
  SELECT {key} AS k, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY vec_id) AS i, vec_id,
         CAST(embedding AS DOUBLE[]) AS x, label AS y
  FROM embeddings WHERE {where}),
s(k, i, W, b, vec_id, predicted, correct) AS (
  SELECT DISTINCT k, 0, [list_transform(range({N_FEATURES}), lambda j: 0.0::DOUBLE) FOR c IN range({N_CLASSES})],
         list_transform(range({N_CLASSES}), lambda c: 0.0::DOUBLE), NULL::BIGINT, NULL::INTEGER, NULL::BOOLEAN
  FROM r
  UNION ALL
  SELECT r.k, r.i,
         [list_transform(list_zip(s.W[c + 1], r.x), lambda t: t[1] + dd.d[c + 1] * t[2]) FOR c IN range({N_CLASSES})],
         [s.b[c + 1] + dd.d[c + 1] FOR c IN range({N_CLASSES})], r.vec_id, dd.pr, dd.pr = r.y
  FROM s JOIN r ON r.k = s.k AND r.i = s.i + 1,
  LATERAL (SELECT [1.0 / (1.0 + exp(-(list_dot_product(s.W[c + 1], r.x) + s.b[c + 1]))) FOR c IN range({N_CLASSES})]
           AS p) AS pp,
  LATERAL (SELECT CAST(list_position(pp.p, list_max(pp.p)) - 1 AS INTEGER) AS pr,
                  [(CASE WHEN c = r.y THEN 1.0 ELSE 0.0 END - pp.p[c + 1]) * pp.p[c + 1] * (1.0 - pp.p[c + 1])
                   FOR c IN range({N_CLASSES})] AS d) AS dd)"""


_STREAM = f"CAST(vec_id // {STREAM_ROWS} AS BIGINT)"
_TRAIN = "(vec_id * 7919 + 104729) % 100 < 70"

ORACLES = {
    "perceptron_keyed": _learner_sql(key=_STREAM) + """
SELECT k AS stream, vec_id, predicted, correct FROM s WHERE i > 0""",
    "prequential_accuracy": _learner_sql(key=_STREAM) + """
SELECT k AS stream, CAST(100.0 * AVG(CAST(correct AS DOUBLE)) AS DOUBLE) AS accuracy, COUNT(*) AS n
FROM s WHERE i > 0 GROUP BY k""",
    "holdout_accuracy": _learner_sql(_TRAIN, _STREAM) + f""",
final AS (SELECT k, max_by(W, i) AS W, max_by(b, i) AS b FROM s GROUP BY k),
t AS (
  SELECT f.k, e.label, [1.0 / (1.0 + exp(-(list_dot_product(f.W[c + 1], CAST(e.embedding AS DOUBLE[])) + f.b[c + 1])))
                   FOR c IN range({N_CLASSES})] AS p
  FROM embeddings e JOIN final f ON f.k = CAST(e.vec_id // {STREAM_ROWS} AS BIGINT)
  WHERE NOT ({_TRAIN.replace('vec_id', 'e.vec_id')}))
SELECT k AS stream, CAST(100.0 * AVG(CASE WHEN list_position(p, list_max(p)) - 1 = label THEN 1.0 ELSE 0.0 END) AS DOUBLE)
  AS accuracy, COUNT(*) AS n
FROM t GROUP BY k""",
    "word_count": """SELECT word, COUNT(*) AS n FROM (
  SELECT unnest(string_split(line, ' ')) AS word
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l) w GROUP BY word""",
    "contains_count": """SELECT COUNT(*) FILTER (WHERE contains(line, 'a')) AS lines_a,
       COUNT(*) FILTER (WHERE contains(line, 'b')) AS lines_b
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l""",
    "error_rate": """SELECT COUNT(*) AS n,
  AVG(CASE WHEN CAST(l.quality AS DOUBLE) <> CASE WHEN d.n_chars >= 1000 THEN 1.0 ELSE 0.0 END THEN 1.0 ELSE 0.0 END)
    AS test_error
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "class_scores": f"""WITH {_CENTROIDS}
SELECT vec_id, list(round(p, 6) ORDER BY cls) AS scores FROM z GROUP BY vec_id""",
    "predict_class": f"""WITH {_CENTROIDS},
v AS (SELECT vec_id, cls, p / SUM(p) OVER (PARTITION BY vec_id) AS vote FROM z),
r AS (SELECT vec_id, cls, vote, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY vote DESC, cls) AS rk FROM v)
SELECT r.vec_id, e.label, CAST(r.cls AS INTEGER) AS predicted, round(r.vote, 6) AS top_vote
FROM r JOIN embeddings e ON r.vec_id = e.vec_id WHERE rk = 1""",
    "gradient_step": """WITH xs AS (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
cls AS (SELECT range AS cls FROM range(10)),
d AS (SELECT label, CASE WHEN label = cls THEN 0.125 ELSE -0.125 END AS delta, cls FROM embeddings, cls)
SELECT CAST(cls AS INTEGER) AS class, CAST(j AS INTEGER) AS j, round(w, 6) AS w FROM (
  SELECT c.cls, xs.j, SUM(CASE WHEN xs.label = c.cls THEN 0.125 ELSE -0.125 END * CAST(xs.x AS DOUBLE)) AS w
  FROM xs, cls c GROUP BY c.cls, xs.j
  UNION ALL
  SELECT cls, 64 AS j, SUM(CAST(delta AS DOUBLE)) AS w FROM d GROUP BY cls) t""",
}
