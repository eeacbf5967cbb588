"""The reference's end-to-end ETL on device log text files.

``log_sessions`` → ``filter_min_events`` → ``filter_min_group`` (by user)
→ ``nearest_join`` with weather (city, calendar day of the start) → sorted
output; then ``log_features`` → range filter → codes → labels → dataset
lines.

For the registered query the log files and the weather file are written by
Spark from the ``events`` table (devices spread over a few files, each
device's section opening with its header, ``signup`` repeating the header, ``error`` as power-off, settings derived as in
:mod:`seqlab.plans.appliance`; ``view`` events become weather readings of the
user's city), so the whole ETL runs over data that grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions.address import parse_address
from seqlab.functions.codes import FEATURE_COLS, TEMP_RANGE
from seqlab.functions.scan import with_order_blocks
from seqlab.operators.features import encode_categories, filter_range, sliding_features
from seqlab.operators.groups import filter_min_group
from seqlab.operators.joins import nearest_join
from seqlab.operators.labels import combine_labels
from seqlab.operators.sessionize import filter_min_events, sessionize
from seqlab.plans.appliance import CODE_SPEC, appliance_settings
from seqlab.session import materialize, scratch_path
from seqlab.sinks.text import dataset_line
from seqlab.sources.logs import file_number, parse_log_lines, read_lines_ordered, read_weather
from seqlab.sources.tables import table

# Addresses given to the generated devices (by user id modulo 5).
DEMO_ADDRESSES = ("中国黑龙江哈尔滨", "中国内蒙古包头", "中国上海上海", "中国广东广州", "None")
# Sessions of a user above which its windows are taken in blocks.
SESSION_BLOCK_ROWS = 1_000_000
SESSION_COLS = ["user", "session_id", "n_on", "start", "end", "speed", "direction", "mode", "raw6", "temp",
                "province", "city"]


def _address(user_id):
    return F.element_at(F.array(*[F.lit(a) for a in DEMO_ADDRESSES]), (F.pmod(user_id, F.lit(5)) + 1).cast("int"))


# Log files the devices are spread over (by user id modulo): one per
# LOG_FILE_ROWS events, LOG_FILES at least.
LOG_FILES, LOG_FILE_ROWS = 16, 1_000_000
# Lines after the first empty line of a file are never read (they would make
# one more session of a device "ghost").
TRAILER = ("", "ID:ghost,None", "/,d,poweron,low,auto,cool,26,25,2024-02-01 00:00",
           "/,d,poweroff,low,auto,cool,26,25,2024-02-01 00:10")


def write_event_logs(spark: SparkSession, data_dir: str, out: str, n_files: int | None = None) -> None:
    """Device logs in ``n_files`` files (folder ``file=<n>``): every user
    (device) is one section that opens with its header line, then its events
    in order (a ``signup`` repeats the header); each file ends with an empty
    line followed by lines that must be ignored."""
    ev = table(spark, data_dir, "events")
    n_files = n_files or max(LOG_FILES, -(-ev.count() // LOG_FILE_ROWS))
    app = appliance_settings(ev)
    header = F.concat(F.lit("ID:"), F.col("user_id").cast("string"), F.lit(","), _address(F.col("user_id")))
    line = (F.when(F.col("event_type") == "signup", header)
            .otherwise(F.concat_ws(",", F.lit("/"), F.lit("d"),
                                   F.when(F.col("event_type") == "error", "poweroff").otherwise("poweron"),
                                   "speed", "direction", "mode", "event_type", F.col("temp").cast("string"),
                                   F.date_format("ts", "yyyy-MM-dd HH:mm"))))
    file = F.pmod(F.col("user_id"), F.lit(n_files)).cast("int")
    events = app.select(file.alias("file"), F.lit(0).alias("sec"), "user_id", F.lit(1).alias("k0"), "ts", "event_id",
                        F.lit(0).alias("k1"), line.alias("value"))
    users = ev.select("user_id").distinct()
    headers = users.select(file.alias("file"), F.lit(0).alias("sec"), "user_id", F.lit(0).alias("k0"),
                           F.lit(None).cast("timestamp_ntz")
                           .alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("k1"),
                           header.alias("value"))
    tail = F.explode(F.array(*[F.struct(F.lit(i).alias("k1"), F.lit(t).alias("value")) for i, t in enumerate(TRAILER)]))
    trailers = (users.select(file.alias("file")).distinct()
                .select("file", F.lit(1).alias("sec"), F.lit(None).cast("long").alias("user_id"), F.lit(0).alias("k0"),
                        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"),
                        tail.alias("t")).select("file", "sec", "user_id", "k0", "ts", "event_id", "t.k1", "t.value"))
    (events.unionByName(headers).unionByName(trailers)
        .repartition(n_files, "file").sortWithinPartitions("file", "sec", "user_id", "k0", "ts", "event_id", "k1")
        .select("file", "value").write.mode("overwrite").partitionBy("file").text(out))


def write_event_weather(spark: SparkSession, data_dir: str, out: str) -> None:
    """Weather lines (8 fields) of every ``view`` event in its user's city."""
    ev = table(spark, data_dir, "events").where(F.col("event_type") == "view")
    _, city = parse_address("addr")
    rows = ev.select(_address(F.col("user_id")).alias("addr"), "ts", "value", "event_id").select(
        city.alias("city"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm:ss").alias("time"),
        (F.pmod(F.floor("value"), F.lit(15)) + 15).cast("string").alias("temperature"),
        F.col("event_id").cast("string").alias("w4"), F.lit("w5").alias("w5"), F.lit("w6").alias("w6"),
        F.lit("w7").alias("w7")).where(F.col("city").isNotNull())
    rows.select(F.concat_ws(",", *rows.columns).alias("value")).write.mode("overwrite").text(out)


def log_sessions(spark: SparkSession, log_path: str, carry_over: bool = True, on_bad: str = "error",
                 file_no=None) -> DataFrame:
    """Sessions of every log file (12 columns of the reference, start/end as
    the log's time text)."""
    lines = read_lines_ordered(spark, log_path)
    parsed = parse_log_lines(lines, on_bad=on_bad)
    if on_bad != "error":
        parsed = parsed.where(F.col("kind") != "bad")
    fno = file_no if file_no is not None else file_number("file_path")
    s = sessionize(parsed, file_col="file_path", order_cols=["block", "pos"], kind_col="kind", time_col="time",
                   settings_cols=["speed", "direction", "mode", "raw6", "temp"],
                   header_cols=["user", "province", "city"], block_col="block", file_no=fno,
                   carry_over=carry_over)
    return materialize(s.select(*SESSION_COLS))


def attach_weather(sessions: DataFrame, weather: DataFrame, strategy: str = "scan") -> DataFrame:
    left = sessions.select("*", F.try_to_timestamp("start", F.lit("yyyy-MM-dd HH:mm")).alias("start_ts"),
                           F.substring("start", 1, 10).alias("start_day"))
    right = weather.select(F.col("city").alias("w_city"), F.col("date").alias("w_date"), F.col("time").alias("w_time"),
                           F.col("temperature").alias("w_temp"), "w4", "w5", "w6", "w7", "weather_ts")
    out = nearest_join(left, right, left_keys=["city", "start_day"], right_keys=["w_city", "w_date"],
                       left_ts="start_ts", right_ts="weather_ts",
                       right_cols=["w_date", "w_time", "w_temp", "w4", "w5", "w6", "w7"], strategy=strategy)
    return out.drop("start_ts", "start_day")


def log_joined(spark: SparkSession, log_path: str, weather_path: str, **kw) -> DataFrame:
    s = filter_min_group(filter_min_events(log_sessions(spark, log_path, **kw)), "user", k=3, size_col="n_sessions")
    return attach_weather(s, read_weather(spark, weather_path))


def log_features(joined: DataFrame, order: str = "lexical") -> DataFrame:
    """Four consecutive sessions of a user. ``order='lexical'`` sorts by the
    session id text (reference: ``-10`` before ``-2``), ``'natural'`` by file
    number and sequence number."""
    fno = F.regexp_extract("session_id", r"^(.*)-([0-9]+)$", 1)
    seq = F.regexp_extract("session_id", r"^(.*)-([0-9]+)$", 2)
    if order == "lexical":
        order_cols = ["session_id"]
        df = joined
    else:
        order_cols = ["__f", "__s"]
        df = joined.withColumn("__f", fno).withColumn("__s", seq.cast("long"))
    df = with_order_blocks(df, ["user"], order_cols, SESSION_BLOCK_ROWS, "__b")
    return sliding_features(df, "user", order_cols, width=4, feature_cols=["temp", "speed", "direction", "mode"],
                            target_cols={"weather": "w_temp", "speed": "speed", "direction": "direction",
                                         "mode": "mode", "temp": "temp"},
                            start_cols={"session_id": "session_id"}, block="__b")


def log_dataset(features: DataFrame) -> DataFrame:
    kept = filter_range(features, ["temp1", "temp2", "temp3", "temp"], *TEMP_RANGE, required=["weather"])
    coded = encode_categories(kept, {**CODE_SPEC, "weather": 0})
    return coded.withColumn("label", combine_labels(["temp", "speed", "direction", "mode"]))


def generated_inputs(spark: SparkSession, data_dir: str) -> tuple[str, str]:
    base = scratch_path(spark, f"logs-{uuid.uuid4().hex[:8]}")
    write_event_logs(spark, data_dir, f"{base}/logs")
    write_event_weather(spark, data_dir, f"{base}/weather")
    return f"{base}/logs", f"{base}/weather"


def q_log_sessions(spark, data_dir):
    """Sessions read back from the generated log text (equal to the event
    sessions: same files, order and settings)."""
    logs, _ = generated_inputs(spark, data_dir)
    return log_sessions(spark, logs, file_no=F.col("file").cast("string"))


def q_log_etl(spark, data_dir):
    """Whole ETL on generated logs: sessions, filters, weather join."""
    logs, weather = generated_inputs(spark, data_dir)
    s = filter_min_group(filter_min_events(log_sessions(spark, logs, file_no=F.col("file").cast("string"))),
                         "user", k=3, size_col="n_sessions")
    return attach_weather(s, read_weather(spark, weather))


def q_log_dataset(spark, data_dir):
    """Dataset lines (13 codes ``#`` combined label) of the log ETL."""
    joined = q_log_etl(spark, data_dir)
    ds = log_dataset(log_features(joined))
    return ds.select("user", "session_id", dataset_line(list(FEATURE_COLS), "label").alias("line"))


QUERIES = {
    "log_sessions": q_log_sessions,
    "log_etl": q_log_etl,
    "log_dataset": q_log_dataset,
}
