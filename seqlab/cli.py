"""Command line: the reference's batch and streaming jobs on files.

    python -m seqlab.cli etl LOGS WEATHER OUT [--period YYYYMM] [--weather-columns 8|4] [--no-carry-over]
    python -m seqlab.cli dataset OUT [--order lexical|natural]
    python -m seqlab.cli train OUT --algorithm tree|forest|logistic|gbt [--trees 20] [--depth 10] [--bins 32]
    python -m seqlab.cli rules MODEL_DIR OUT [--text]
    python -m seqlab.cli wordcount IN_DIR OUT_DIR CHECKPOINT [--once]
    python -m seqlab.cli learn IN_DIR OUT_DIR CHECKPOINT --features 110 --classes 5 [--rate 1.0] [--once]

``etl`` writes ``OUT/sessions`` (sized sessions) and ``OUT/joined`` (with the
nearest weather, sorted by user and start) as comma-separated text, plus
Parquet copies used by the next steps; ``dataset`` writes the dataset lines,
the label dictionary, LibSVM rows and the one-hot dataset; ``train`` fits,
evaluates on a 70/30 hash split, refits on all rows, saves the model and its
rule table and appends a metrics row. Every output folder is overwritten.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqlab.functions.codes import FEATURE_COLS, NOMINAL_FEATURES, TARGET_COLS
from seqlab.operators.encode import assemble, hash_split, one_hot, one_hot_dataset
from seqlab.operators.groups import filter_min_group, sort_key
from seqlab.operators.labels import index_labels, label_dictionary, label_index
from seqlab.operators.models import error_rate, metrics_row, predict, save_model, train
from seqlab.operators.rules import rule_lines, tree_nodes, tree_rules
from seqlab.operators.sessionize import filter_min_events
from seqlab.plans.logs import SESSION_COLS, attach_weather, log_dataset, log_features, log_sessions
from seqlab.sinks.text import (append_metrics, dataset_line, dictionary_line, write_delimited, write_libsvm,
                               write_lines, write_table)
from seqlab.sources.logs import read_weather


def etl(spark: SparkSession, logs: str, weather: str, out: str, weather_columns: int = 8,
        carry_over: bool = True, period: str | None = None) -> None:
    """``period`` picks the ``period=YYYYMM`` folder of both inputs (one
    month of logs and its weather), as the reference picks its data set."""
    if period:
        logs, weather = f"{logs.rstrip('/')}/period={period}", f"{weather.rstrip('/')}/period={period}"
    sessions = filter_min_group(filter_min_events(log_sessions(spark, logs, carry_over=carry_over)), "user", k=3,
                                size_col="n_sessions")
    sized = sessions.select("n_sessions", *SESSION_COLS)
    write_delimited(sized, f"{out}/sessions")
    w = read_weather(spark, weather, columns=weather_columns)
    if weather_columns == 4:
        for c in ("w4", "w5", "w6", "w7"):
            w = w.withColumn(c, F.lit(None).cast("string"))
    joined = attach_weather(sized, w)
    write_table(joined, f"{out}/joined.parquet")
    joined = spark.read.parquet(f"{out}/joined.parquet")
    write_delimited(joined, f"{out}/joined", sort_by=[sort_key("user", "start")])


def dataset(spark: SparkSession, out: str, order: str = "lexical") -> None:
    joined = spark.read.parquet(f"{out}/joined.parquet")
    ds = log_dataset(log_features(joined, order=order))
    write_table(ds, f"{out}/dataset.parquet")
    ds = spark.read.parquet(f"{out}/dataset.parquet")
    idx = label_index(ds)
    write_table(idx, f"{out}/label_index.parquet")
    write_lines(index_labels(ds, index=idx), dataset_line(list(FEATURE_COLS), "label_index"), f"{out}/dataset")
    dic = label_dictionary(idx)
    write_lines(dic, dictionary_line("label_index", "label_text"), f"{out}/label_dictionary")
    write_libsvm(assemble(ds, list(FEATURE_COLS)).withColumn("label", F.col("label").cast("double")),
                 f"{out}/libsvm")
    enc = one_hot(ds, list(FEATURE_COLS), drop_last=False)
    oh = one_hot_dataset(enc, [f"{c}_vec" for c in FEATURE_COLS], list(TARGET_COLS))
    # Same zero-decimal number format as the dataset lines.
    write_lines(oh, F.array_join(F.transform("values", lambda v: F.bround(v, 0).cast("long").cast("string")), ","),
                f"{out}/onehot")


def train_model(spark: SparkSession, out: str, algorithm: str, trees: int = 20, depth: int = 10,
                bins: int = 32) -> None:
    ds = spark.read.parquet(f"{out}/dataset.parquet")
    idx = spark.read.parquet(f"{out}/label_index.parquet")
    n_classes = idx.count()
    rows = assemble(index_labels(ds, index=idx), list(FEATURE_COLS), nominal=NOMINAL_FEATURES)
    rows = rows.select("session_id", "features", F.col("label_index").cast("double").alias("label"))
    rows = rows.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": int(n_classes)}})
    params = dict(max_depth=depth, max_bins=bins, num_trees=trees)
    flag = hash_split(F.xxhash64("session_id"), 70)
    tr, te = rows.where(flag), rows.where(~flag)
    model = train(algorithm, tr, **params)
    err = predict(model, te).agg(error_rate().alias("e")).first()["e"]
    final = train(algorithm, rows, **params)
    save_model(final, f"{out}/model-{algorithm}")
    if algorithm in ("tree", "forest"):
        rules = tree_rules(spark, tree_nodes(spark, f"{out}/model-{algorithm}"))
        dic = label_dictionary(idx)
        named = rules.join(F.broadcast(dic), F.col("prediction") == F.col("label_index").cast("double"), "left")
        write_lines(rule_lines(named, F.col("label_text")), F.concat(F.lit("Tree"), F.col("tree").cast("string"),
                                                                     F.lit(":"), F.col("line")),
                    f"{out}/rules-{algorithm}", sort_by=["tree", "leaf"])
    report = metrics_row(spark, algorithm=algorithm, dataset=out, n_classes=n_classes, test_error=err,
                         n_train=tr.count(), n_test=te.count(),
                         n_trees=len(final.trees) if hasattr(final, "trees") else None,
                         model_summary=type(final).__name__)
    append_metrics(report, f"{out}/metrics")


def model_rules(spark: SparkSession, model_dir: str, out: str, text: bool = False) -> None:
    """Rule lines (``Tree<n>:cond:...:#label``, or readable ``cond -> ... ->
    Predict``) and the node table as JSON of any saved tree or forest."""
    from seqlab.operators.rules import nodes_json, rule_text, tree_documents
    nodes = tree_nodes(spark, model_dir)
    rules = rule_lines(tree_rules(spark, nodes))
    line = F.concat(F.lit("Tree"), F.col("tree").cast("string"), F.lit(":"), F.col("text" if text else "line"))
    write_lines(rule_text(rules) if text else rules, line, f"{out}/rules", sort_by=["tree", "leaf"])
    write_lines(nodes_json(nodes), F.col("json"), f"{out}/nodes_json", sort_by=["tree", "id"])
    write_lines(tree_documents(nodes), F.col("json"), f"{out}/tree_json", sort_by=["tree"])


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="seqlab")
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("etl")
    e.add_argument("logs"), e.add_argument("weather"), e.add_argument("out")
    e.add_argument("--weather-columns", type=int, default=8, choices=(4, 8))
    e.add_argument("--no-carry-over", action="store_true")
    e.add_argument("--period", default=None)
    d = sub.add_parser("dataset")
    d.add_argument("out"), d.add_argument("--order", default="lexical", choices=("lexical", "natural"))
    t = sub.add_parser("train")
    t.add_argument("out"), t.add_argument("--algorithm", default="forest")
    t.add_argument("--trees", type=int, default=20), t.add_argument("--depth", type=int, default=10)
    t.add_argument("--bins", type=int, default=32)
    r = sub.add_parser("rules")
    r.add_argument("model"), r.add_argument("out"), r.add_argument("--text", action="store_true")
    w = sub.add_parser("wordcount")
    w.add_argument("input"), w.add_argument("output"), w.add_argument("checkpoint"), w.add_argument("--once", action="store_true")
    le = sub.add_parser("learn")
    le.add_argument("input"), le.add_argument("output"), le.add_argument("checkpoint")
    le.add_argument("--features", type=int, required=True), le.add_argument("--classes", type=int, required=True)
    le.add_argument("--rate", type=float, default=1.0), le.add_argument("--once", action="store_true")
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName(f"seqlab-{a.cmd}").getOrCreate()
    if a.cmd == "etl":
        etl(spark, a.logs, a.weather, a.out, a.weather_columns, not a.no_carry_over, a.period)
    elif a.cmd == "dataset":
        dataset(spark, a.out, a.order)
    elif a.cmd == "train":
        train_model(spark, a.out, a.algorithm, a.trees, a.depth, a.bins)
    elif a.cmd == "rules":
        model_rules(spark, a.model, a.out, a.text)
    elif a.cmd == "wordcount":
        from seqlab.streaming.jobs import start_word_count, stream_lines
        trig = {"availableNow": True} if a.once else {"processingTime": "1 second"}
        start_word_count(stream_lines(spark, a.input), a.output, a.checkpoint, trigger=trig, peek=10).awaitTermination()
    elif a.cmd == "learn":
        from seqlab.streaming.jobs import parse_instances, start_minibatch_learner, stream_lines
        trig = {"availableNow": True} if a.once else {"processingTime": "3 seconds"}
        inst = parse_instances(stream_lines(spark, a.input), a.features)
        start_minibatch_learner(inst, f"{a.output}/state", f"{a.output}/report", a.checkpoint, n_classes=a.classes,
                                n_features=a.features, lr=a.rate, trigger=trig).awaitTermination()


if __name__ == "__main__":
    main()
