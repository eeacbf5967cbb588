"""Text/CSV sources, error modes, and plan properties (pushdown, pruning,
blocked partitioning, no cartesian products)."""

import os
import re

import pytest

from seqlab.sources.logs import bad_lines, parse_log_lines, read_csv_inferred, read_instances, read_lines_ordered, \
    read_weather

SF = "/root/testdata/sf0.001"


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_short_line_fails_or_is_kept_aside(spark, tmp_dir):
    _write(f"{tmp_dir}/l/1.csv", "ID:u1,None\n/,d,poweron,low\n/,d,poweroff,low,auto,cool,26,25,2016-12-01 08:00\n")
    lines = read_lines_ordered(spark, f"{tmp_dir}/l")
    with pytest.raises(Exception, match="short log line"):
        parse_log_lines(lines).collect()
    kept = parse_log_lines(lines, on_bad="keep")
    assert [r.line for r in bad_lines(kept).collect()] == ["/,d,poweron,low"]


def test_weather_corrupt_record_and_four_columns(spark, tmp_dir):
    _write(f"{tmp_dir}/w/a.txt", "上海,2016-12-01,08:00:00,5,a,b,c,d\nbroken line\n")
    w = read_weather(spark, f"{tmp_dir}/w")
    rows = {r.city: r for r in w.collect()}
    assert rows["上海"].weather_ts is not None and rows["上海"].temperature == "5"
    four = read_weather(spark, f"{tmp_dir}/w", columns=4)
    assert "w4" not in four.columns and "temperature" in four.columns


def test_instances_with_pipe_quotes(spark, tmp_dir):
    _write(f"{tmp_dir}/i/a.csv", "|1.5|,2,1\n0,|3|,0\n")
    got = sorted((tuple(r.x), r.y) for r in read_instances(spark, f"{tmp_dir}/i").collect())
    assert got == [((0.0, 3.0), 0), ((1.5, 2.0), 1)]


def test_csv_with_header(spark, tmp_dir):
    _write(f"{tmp_dir}/c/a.csv", "city,n\n上海,3\n包头,4\n")
    df = read_csv_inferred(spark, f"{tmp_dir}/c", ["city"])
    assert df.columns == ["city"] and df.count() == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_period_filter_reaches_scan(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["period_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_column_pruning_of_word_count(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["word_count"](spark, SF))
    assert "ReadSchema: struct<text:string>" in plan


def test_sessionize_scans_in_blocks(spark):
    from seqlab.plans.events import event_kinds
    from seqlab.operators.sessionize import sessionize
    from seqlab.sources.tables import table
    ev = event_kinds(table(spark, SF, "events"))
    s = sessionize(ev, file_col="user_id", order_cols=["ts", "event_id"], kind_col="kind", time_col="ts",
                   block_col="blk", checkpoint_runs=False)
    plan = _plan(s)
    assert "hashpartitioning(__pk" in plan and "blk" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cartesian_products_anywhere(spark):
    import __spark_entry__ as e
    for name in ["nearest_join", "nearest_join_scan", "session_features", "one_hot_dataset", "gradient_step",
                 "class_scores", "group_sorted", "sliding_features", "holdout_accuracy", "log_etl"]:
        plan = _plan(e.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_delimited_round_trip_keeps_blank_fields(spark, tmp_dir):
    from seqlab.sinks.text import write_delimited
    from seqlab.sources.logs import read_delimited
    df = spark.createDataFrame([("u1", None, "上海"), ("u2", "x", None)], "user string, a string, city string")
    write_delimited(df, f"{tmp_dir}/d", sort_by=["user"])
    lines = sorted(open(os.path.join(f"{tmp_dir}/d", f), encoding="utf-8").read() for f in os.listdir(f"{tmp_dir}/d")
                   if f.startswith("part-"))
    assert "".join(lines).splitlines() == ["u1,,上海", "u2,x,"]
    back = sorted(tuple(r) for r in read_delimited(spark, f"{tmp_dir}/d", ["user", "a", "city"]).collect())
    assert back == [("u1", None, "上海"), ("u2", "x", None)]


def test_log_dataset_scans_every_key_once(spark, tmp_dir):
    """Sessions and weather of one city and day: no window frame is computed anew from every row."""
    from pyspark.sql import functions as F

    from seqlab.plans.logs import q_log_dataset
    kind = F.element_at(F.array(*[F.lit(k) for k in ("click", "purchase", "view", "error")]), (F.col("id") % 4 + 1).cast("int"))
    ev = spark.range(400).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("ts"),
        (F.col("id").cast("int") / 40).cast("long").alias("user_id"), kind.alias("event_type"), F.col("id").cast("double").alias("value"),
        F.lit("{}").alias("props"))
    ev.write.parquet(f"{tmp_dir}/events.parquet")
    out = q_log_dataset(spark, tmp_dir)
    assert not re.search(r"(?<!unboundedpreceding\$\(\)), unboundedfollowing", out._jdf.queryExecution().toString().lower())
    assert set(out.columns) == {"user", "session_id", "line"}
