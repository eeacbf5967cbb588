"""The appliance-log operators configured on the ``events`` table.

Each user's event stream plays the part of one log file: ``signup`` is the
device header, ``error`` switches off, every other type is a power-on event.
Order inside a user is ``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.functions.scan import with_order_blocks
from seqlab.operators.features import sliding_features
from seqlab.operators.groups import filter_min_group, sort_sessions
from seqlab.operators.joins import nearest_join
from seqlab.operators.sessionize import filter_min_events, sessionize
from seqlab.session import materialize
from seqlab.sources.tables import read_period, table

# Rows per block of the per-user scans: users with more events are cut at equal
# depth (see with_order_blocks); a user with a third of 100 TB is then spread
# over thousands of bounded tasks, and every other user is one window.
EVENT_BLOCK_ROWS = 1_000_000


def with_event_blocks(events: DataFrame, target_rows: int = EVENT_BLOCK_ROWS) -> DataFrame:
    return with_order_blocks(events, ["user_id"], ["ts", "event_id"], target_rows, "blk")


def event_kinds(events: DataFrame, target_rows: int = EVENT_BLOCK_ROWS) -> DataFrame:
    et = F.col("event_type")
    kind = F.when(et == "signup", "header").when(et == "error", "off").otherwise("on")
    return with_event_blocks(events, target_rows).select(
        "user_id", "ts", "event_id", "event_type", "value", kind.alias("kind"),
        F.col("event_id").alias("signup_id"), "blk")


def event_sessions(spark: SparkSession, data_dir: str, carry_over: bool = True, reused: bool = True) -> DataFrame:
    """Sessions of every user. ``reused=True`` checkpoints them for plans
    that read them more than once."""
    ev = event_kinds(table(spark, data_dir, "events"))
    s = sessionize(ev, file_col="user_id", order_cols=["ts", "event_id"], kind_col="kind", time_col="ts",
                   settings_cols=["event_type", "value"], header_cols=["signup_id"], block_col="blk",
                   carry_over=carry_over)
    s = s.withColumnRenamed("start", "start_ts").withColumnRenamed("end", "end_ts")
    # Later steps read the sessions several times (group sizes, windows).
    return materialize(s) if reused else s


def q_sessionize(spark, data_dir):
    return event_sessions(spark, data_dir, reused=False)


def q_sessionize_clean(spark, data_dir):
    return event_sessions(spark, data_dir, carry_over=False, reused=False)


def q_min_events(spark, data_dir):
    return filter_min_events(event_sessions(spark, data_dir, reused=False), k=1)


def q_min_group(spark, data_dir):
    return filter_min_group(filter_min_events(event_sessions(spark, data_dir)), "user_id", k=3)


def session_features(sessions: DataFrame) -> DataFrame:
    """Four consecutive sessions of a user (natural order of the session
    number): settings of three, settings of the fourth as targets."""
    blocked = with_order_blocks(sessions, ["user_id"], ["seq"], EVENT_BLOCK_ROWS, "__sblk")
    return sliding_features(blocked, "user_id", ["seq"], width=4,
                            feature_cols=["n_on", "event_type", "value"],
                            target_cols={"next_event_type": "event_type", "next_value": "value",
                                         "next_n_on": "n_on"},
                            start_cols={"session_id": "session_id"}, block="__sblk")


def q_session_features(spark, data_dir):
    s = filter_min_group(filter_min_events(event_sessions(spark, data_dir)), "user_id", k=3, size_col=None)
    return session_features(s)


def q_sliding_features(spark, data_dir):
    ev = with_event_blocks(table(spark, data_dir, "events"))
    return sliding_features(ev, "user_id", ["ts", "event_id"], width=4, feature_cols=["value"],
                            target_cols={"target": "value"}, start_cols={"event_id": "event_id"},
                            block="blk")


def q_sliding_lexical(spark, data_dir):
    """Order by the text of the event id (``'10'`` before ``'9'``)."""
    ev = table(spark, data_dir, "events").withColumn("eid_text", F.col("event_id").cast("string"))
    ev = with_order_blocks(ev, ["user_id"], ["eid_text"], EVENT_BLOCK_ROWS, "blk")
    return sliding_features(ev, "user_id", ["eid_text"], width=4, feature_cols=["value"],
                            target_cols={"target": "value"}, start_cols={"event_id": "event_id"},
                            block="blk")


def _purchases_views(spark, data_dir):
    ev = table(spark, data_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    purchases = (ev.where(F.col("event_type") == "purchase")
                 .select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("day")))
    views = (ev.where(F.col("event_type") == "view")
             .select("user_id", F.to_date("ts").alias("view_day"), F.col("ts").alias("view_ts"),
                     F.col("event_id").alias("view_id"), F.col("value").alias("view_value")))
    return purchases, views


def nearest_view(spark, data_dir, strategy="scan", max_gap_seconds=None):
    purchases, views = _purchases_views(spark, data_dir)
    return nearest_join(purchases, views, left_keys=["user_id", "day"], right_keys=["user_id", "view_day"],
                        left_ts="ts", right_ts="view_ts", right_cols=["view_ts", "view_id", "view_value"],
                        max_gap_seconds=max_gap_seconds, strategy=strategy)


def q_nearest_join(spark, data_dir):
    return nearest_view(spark, data_dir, strategy="auto")


def q_nearest_join_scan(spark, data_dir):
    return nearest_view(spark, data_dir, strategy="scan")


def q_nearest_join_gap(spark, data_dir):
    return nearest_view(spark, data_dir, strategy="auto", max_gap_seconds=3600)


def q_nearest_join_gap_scan(spark, data_dir):
    return nearest_view(spark, data_dir, strategy="scan", max_gap_seconds=3600)


def q_group_sorted(spark, data_dir):
    """Sessions in the order of the text key ``user + ' ' + start`` with
    their 1-based position in that order."""
    s = event_sessions(spark, data_dir)
    key = F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return sort_sessions(s.select("user_id", "session_id", "start_ts"), key, rank_col="pos")


def q_period_filter(spark, data_dir):
    """Orders of the period ``199610`` (a month); the range predicate on the
    date reaches the Parquet scan."""
    return read_period(table(spark, data_dir, "orders"), "o_orderdate", "199610")
