"""Sinks and sources through files that Spark writes from the tables and reads
back: delimited rows, LibSVM rows, 4-column weather, ``period=`` folders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlab.functions.codes import FEATURE_COLS
from seqlab.operators.encode import assemble, exact_split, holdout_split, vector_values
from seqlab.operators.groups import ordered_chunks, sort_key, sort_sessions
from seqlab.operators.joins import nearest_join
from seqlab.plans.appliance import labelled
from seqlab.plans.appliance_sql import LABELLED
from seqlab.plans.events import event_sessions
from seqlab.plans.events_sql import SESSIONS_CARRY
from seqlab.session import scratch_path
from seqlab.sinks.text import read_sorted_lines, write_delimited, write_libsvm, write_lines, write_table
from seqlab.sources.logs import (file_number, read_csv_inferred, read_delimited, read_instances, read_libsvm,
                                 read_lines_ordered, read_weather)
from seqlab.sources.tables import table


def _folder(spark, name):
    return scratch_path(spark, f"files-{name}-{uuid.uuid4().hex[:8]}")


def q_delimited_round_trip(spark, data_dir):
    """Events written as sorted comma-separated rows (a missing value is an empty field) and read back."""
    path = _folder(spark, "delimited")
    ev = table(spark, data_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    for _ in range(2):  # the second run overwrites the first
        write_delimited(ev, path, sort_by=["event_id"])
    return read_delimited(spark, path, ["event_id", "user_id", "kind"])


def q_libsvm_round_trip(spark, data_dir):
    """Coded feature rows through Spark's LibSVM sink and source."""
    path = _folder(spark, "libsvm")
    write_libsvm(assemble(labelled(spark, data_dir), list(FEATURE_COLS)).withColumn("label", F.col("label").cast("double")), path)
    back = read_libsvm(spark, path, len(FEATURE_COLS))
    return back.select(F.col("label").cast("int").alias("label"), vector_values("features").alias("features"))


def _weather_line():
    return F.concat_ws(",", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"),
                       F.floor("value").cast("string"))


def q_weather_four_columns(spark, data_dir):
    """View events as weather lines of four fields, read back with their time."""
    path = _folder(spark, "weather")
    ev = table(spark, data_dir, "events").where(F.col("event_type") == "view")
    write_lines(ev, _weather_line(), path)
    return read_weather(spark, path, columns=4).select(
        "city", "date", "time", "temperature", F.col("weather_ts").cast("timestamp_ntz").alias("weather_ts"))


def q_period_folder(spark, data_dir):
    """Orders stored by month in ``period=`` folders; the filter on the month reads its folder
    only, and a month without a folder has no rows."""
    path = _folder(spark, "period")
    orders = table(spark, data_dir, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyyMM").alias("period"))
    write_table(orders, path, partition_by=["period"])
    stored = spark.read.schema(orders.schema).parquet(path)
    return stored.where(F.col("period") == "199610").select("o_orderkey")


def q_file_numbers(spark, data_dir):
    """Lines counted by the file number taken from each file's path."""
    path = _folder(spark, "numbers")
    names = table(spark, data_dir, "customer").select(F.concat(F.col("c_nationkey").cast("string"), F.lit(".log")).alias("d"), "c_name")
    names.write.partitionBy("d").text(path)
    folder = F.regexp_extract(F.col("file_path"), "d=([^/]*)/", 1)
    return read_lines_ordered(spark, path).groupBy(file_number(folder).alias("file_no")).agg(F.count(F.lit(1)).alias("n"))


def q_split_random(spark, data_dir):
    """Seeded hold-out by a mixed hash of the id."""
    return table(spark, data_dir, "events").select("event_id", holdout_split("event_id", 70, seed=7).alias("is_train"))


def q_weather_join_four(spark, data_dir):
    """Each purchase with the nearest reading of its user in weather lines of four fields."""
    path = _folder(spark, "weather4")
    ev = table(spark, data_dir, "events")
    write_lines(ev.where(F.col("event_type") == "view"), _weather_line(), path)
    weather = read_weather(spark, path, columns=4).select(
        F.col("city").alias("w_city"), F.col("weather_ts").cast("timestamp_ntz").alias("weather_ts"), "temperature")
    buys = ev.where(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").cast("string").alias("city"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    out = nearest_join(buys, weather, left_keys=["city"], right_keys=["w_city"], left_ts="ts", right_ts="weather_ts",
                       right_cols=["weather_ts", "temperature"], strategy="auto")
    return out.select("event_id", "city", "weather_ts", "temperature")


def q_inferred_csv(spark, data_dir):
    """Events through CSV files with a header line, read back with inferred types, three columns kept."""
    path = _folder(spark, "csv")
    table(spark, data_dir, "events").select("event_id", "user_id", "event_type", "value").write.option("header", True).csv(path)
    back = read_csv_inferred(spark, path, ["event_id", "event_type", "value"])
    return back.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("value").cast("double").alias("value"))


def q_quoted_instances(spark, data_dir):
    """Embeddings as instance lines whose fields stand between bars, read back as numbers and class."""
    path = _folder(spark, "instances")
    emb = table(spark, data_dir, "embeddings").select(
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)], F.col("label").cast("int").alias("y"))
    emb.write.option("quote", "|").option("quoteAll", True).csv(path)
    return read_instances(spark, path)


def q_split_exact(spark, data_dir):
    """Random order cut at exactly 70 % of the rows."""
    return exact_split(table(spark, data_dir, "events").select("event_id"), "event_id", 70, seed=7)


def q_sorted_file(spark, data_dir):
    """Sessions as one sorted text file in parts, read back with the line number and byte offset of each line."""
    path = _folder(spark, "sorted")
    s = event_sessions(spark, data_dir).select("user_id", "session_id")
    write_delimited(s, path, sort_by=["user_id", "session_id"])
    return read_sorted_lines(spark, path)


def q_ordered_chunks(spark, data_dir):
    """Every user's events in order, in lists of at most 16."""
    ev = table(spark, data_dir, "events").select("user_id", "ts", "event_id", "event_type")
    lists = ordered_chunks(ev, ["user_id"], ["ts", "event_id"], ["event_id", "event_type"], chunk_rows=16)
    line = F.array_join(F.transform("rows", lambda r: F.concat(r["event_id"].cast("string"), F.lit(":"), r["event_type"])), ",")
    return lists.select("user_id", "chunk", F.size("rows").alias("n"), line.alias("line"))


def q_group_sorted_by_id(spark, data_dir):
    """Sessions in the order of the text key ``user + ' ' + session id`` with their position."""
    s = event_sessions(spark, data_dir).select("user_id", "session_id")
    return sort_sessions(s, sort_key("user_id", "session_id"), rank_col="pos")


QUERIES = {
    "delimited_round_trip": q_delimited_round_trip,
    "libsvm_round_trip": q_libsvm_round_trip,
    "weather_four_columns": q_weather_four_columns,
    "period_folder": q_period_folder,
    "file_numbers": q_file_numbers,
    "split_random": q_split_random,
    "group_sorted_by_id": q_group_sorted_by_id,
    "split_exact": q_split_exact,
    "weather_join_four": q_weather_join_four,
    "inferred_csv": q_inferred_csv,
    "quoted_instances": q_quoted_instances,
    "sorted_file": q_sorted_file,
    "ordered_chunks": q_ordered_chunks,
}

ORACLES = {
    "delimited_round_trip": """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events""",
    "libsvm_round_trip": f"""SELECT label, [{", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURE_COLS)}] AS features FROM ({LABELLED}) l""",
    "weather_four_columns": """SELECT CAST(user_id AS VARCHAR) AS city, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS temperature, date_trunc('second', CAST(ts AS TIMESTAMP)) AS weather_ts
FROM events WHERE event_type = 'view'""",
    "period_folder": "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199610'",
    "file_numbers": "SELECT CAST(c_nationkey AS VARCHAR) AS file_no, COUNT(*) AS n FROM customer GROUP BY c_nationkey",
    "split_random": """SELECT event_id, CAST('0x' || substr(md5('7/' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 70 AS is_train
FROM events""",
    "weather_join_four": """WITH w AS (SELECT user_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS weather_ts,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS temperature FROM events WHERE event_type = 'view')
SELECT p.event_id, CAST(p.user_id AS VARCHAR) AS city, w.weather_ts, w.temperature
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN w ON w.user_id = p.user_id
QUALIFY row_number() OVER (PARTITION BY p.event_id
  ORDER BY abs(epoch_us(w.weather_ts) - epoch_us(CAST(p.ts AS TIMESTAMP))), w.weather_ts, w.temperature) = 1""",
    "inferred_csv": "SELECT event_id, event_type, value FROM events",
    "quoted_instances": "SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CAST(label AS INTEGER) AS y FROM embeddings",
    "split_exact": """SELECT event_id, row_number() OVER (
  ORDER BY CAST('0x' || substr(md5('7/' || CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT)) <= (SELECT COUNT(*) * 70 // 100 FROM events) AS is_train
FROM events""",
    "sorted_file": f"""SELECT row_number() OVER w - 1 AS line_no,
  CAST(coalesce(sum(strlen(line) + 1) OVER (ORDER BY user_id, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_byte, line
FROM (SELECT user_id, session_id, coalesce(CAST(user_id AS VARCHAR), '') || ',' || coalesce(CAST(session_id AS VARCHAR), '') AS line FROM ({SESSIONS_CARRY}) s)
WINDOW w AS (ORDER BY user_id, session_id)""",
    "ordered_chunks": """SELECT user_id, pos // 16 AS chunk, CAST(COUNT(*) AS INTEGER) AS n,
  string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, ',' ORDER BY pos) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) e GROUP BY user_id, pos // 16""",
    "group_sorted_by_id": f"""SELECT user_id, session_id,
  ROW_NUMBER() OVER (ORDER BY CAST(user_id AS VARCHAR) || ' ' || session_id) AS pos
FROM ({SESSIONS_CARRY}) s""",
}
