"""The command-line jobs end to end on logs written from the events table."""

import os

from pyspark.sql import functions as F

from seqlab import cli
from seqlab.plans.logs import write_event_logs, write_event_weather


def _read_lines(path):
    out = []
    for f in sorted(os.listdir(path)):
        if f.startswith("part-"):
            with open(os.path.join(path, f), encoding="utf-8") as fh:
                out += fh.read().splitlines()
    return out


def test_etl_dataset_train(spark, tmp_dir):
    data = "/root/testdata/sf0.01"
    write_event_logs(spark, data, f"{tmp_dir}/logs")
    write_event_weather(spark, data, f"{tmp_dir}/weather")
    out = f"{tmp_dir}/out"
    cli.etl(spark, f"{tmp_dir}/logs", f"{tmp_dir}/weather", out)
    joined = _read_lines(f"{out}/joined")
    keys = [ln.split(",")[1] + " " + ln.split(",")[4] for ln in joined]
    assert keys == sorted(keys) and len(joined) == spark.read.parquet(f"{out}/joined.parquet").count()
    assert all(len(ln.split(",")) == 20 for ln in joined)
    cli.dataset(spark, out)
    lines = _read_lines(f"{out}/dataset")
    assert lines and all(len(ln.split("#")[0].split(",")) == 13 for ln in lines)
    assert all(":{" in ln for ln in _read_lines(f"{out}/label_dictionary"))
    cli.train_model(spark, out, "tree", depth=5)
    m = spark.read.parquet(f"{out}/metrics").first()
    assert m.algorithm == "tree" and 0.0 <= m.test_error <= 1.0
    rules = _read_lines(f"{out}/rules-tree")
    assert rules and all(ln.startswith("Tree1:") and ":#" in ln for ln in rules)
    assert spark.read.parquet(f"{out}/dataset.parquet").where(F.col("label").isNull()).count() == 0

    cli.model_rules(spark, f"{out}/model-tree", f"{tmp_dir}/r", text=True)
    texts = _read_lines(f"{tmp_dir}/r/rules")
    assert texts and all(" -> " in t and "Predict: " in t for t in texts)
    assert len(_read_lines(f"{tmp_dir}/r/nodes_json")) >= len(texts)


def test_etl_picks_the_period_folder(spark, tmp_dir):
    data = "/root/testdata/sf0.001"
    write_event_logs(spark, data, f"{tmp_dir}/logs/period=202401")
    write_event_weather(spark, data, f"{tmp_dir}/weather/period=202401")
    cli.etl(spark, f"{tmp_dir}/logs", f"{tmp_dir}/weather", f"{tmp_dir}/out", period="202401")
    assert spark.read.parquet(f"{tmp_dir}/out/joined.parquet").count() > 0
