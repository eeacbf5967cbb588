"""How evenly the blocked scans spread one hot key over tasks.

Moves a third of all events to one user (data derived from the events table
by Spark), runs sessionize, sliding windows and the scan plan of the nearest
join once with blocked scans and once with a plain per-user window, and
reads Spark's event log (written to a scratch folder)
for the shuffle records read by each task of every stage. Prints a markdown
table: per run, the largest task of the busiest stage against the median.

usage: python tools/skew_check.py [data_dir] [rows_per_block]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def task_records(log_dir: str) -> dict[int, list[int]]:
    """Shuffle records read per task, by stage, from the JSON event log."""
    per_stage: dict[int, list[int]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith((".", "appstatus")):
            continue
        with open(path, encoding="utf-8") as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                read = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                if read:
                    per_stage.setdefault(ev["Stage ID"], []).append(read)
    return per_stage


def _session(log_dir: str) -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("skew-check")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.sql.shuffle.partitions", "64")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(data_dir: str, op: str, blocked: bool, block_rows: int) -> tuple[int, float, int]:
    log_dir = tempfile.mkdtemp(prefix="seqlab-eventlog-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark = _session(log_dir)
    from seqlab.functions.scan import with_order_blocks
    from seqlab.operators.features import sliding_features
    from seqlab.operators.joins import nearest_join
    from seqlab.operators.sessionize import sessionize
    from seqlab.plans.events import event_kinds
    from seqlab.sources.tables import table
    ev = table(spark, data_dir, "events")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    if op == "sessionize":
        kinds = event_kinds(hot, target_rows=block_rows)
        out = sessionize(kinds, file_col="user_id", order_cols=["ts", "event_id"], kind_col="kind", time_col="ts",
                         settings_cols=["event_type", "value"], header_cols=["signup_id"],
                         block_col="blk" if blocked else None, checkpoint_runs=False)
    elif op == "sliding_features":
        out = sliding_features(with_order_blocks(hot, ["user_id"], ["ts", "event_id"], block_rows), "user_id",
                               ["ts", "event_id"], width=4,
                               feature_cols=["value"], target_cols={"target": "value"},
                               start_cols={"event_id": "event_id"}, block="blk" if blocked else None,
                               bucket_rows=max(block_rows, 4))
    else:  # nearest_join, scan plan: every purchase <- nearest view of the same user (no day key)
        purchases = hot.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
        views = hot.where(F.col("event_type") == "view").select(F.col("user_id").alias("vu"),
                                                                F.col("ts").alias("vts"),
                                                                F.col("event_id").alias("view_id"))
        out = nearest_join(purchases, views, left_keys=["user_id"], right_keys=["vu"], left_ts="ts",
                           right_ts="vts", right_cols=["view_id"], strategy="scan",
                           block_unit="auto" if blocked else None, block_rows=block_rows)
    n = out.count()
    spark.stop()
    stages = task_records(log_dir)
    busiest = max(stages.values(), key=lambda v: max(v))
    return max(busiest), statistics.median(busiest), n


def main():
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    block_rows = int(sys.argv[2]) if len(sys.argv) > 2 else 1000
    print("| operator | scan | largest task (shuffle records) | median task | result rows |")
    print("|---|---|---|---|---|")
    for op in ("sessionize", "sliding_features", "nearest_join"):
        for blocked in (True, False):
            mx, med, n = run(data_dir, op, blocked, block_rows)
            label = "blocked" if blocked else "one window per user"
            print(f"| {op} | {label} | {mx} | {med:.0f} | {n} |")


if __name__ == "__main__":
    main()
