"""State-delimited sessionization: collapse runs of "on" events into sessions.

Input: one row per log line or event, with

* ``file_col``   the unit the state machine runs over (a log file, a user)
* ``order_cols`` total order inside the unit
* ``kind_col``   ``'on'``, ``'off'``, ``'header'`` or ``'stop'``
* header attribute columns (read on header rows only; carried down)
* setting columns and ``time_col`` (read on on rows only)

Rules (one state machine per unit, walking rows in order):

* ``stop`` ends the unit: it and every later row are ignored.
* A maximal run of consecutive ``on`` rows starts a pending session that takes
  the header attributes, settings and time of its first row; every started
  run gets the next sequence number of the unit, whether it is emitted or not.
* ``off`` emits the pending session, if any, with its number of ``on`` rows,
  start = time of its first and end = time of its last ``on`` row.
* ``header`` sets new header attributes and ends the current run. With
  ``carry_over=True`` (reference behaviour) a pending session survives the
  header and a later ``off`` emits it with the attributes it started with; a
  new run replaces it. With ``carry_over=False`` the header drops it.
* A session still pending when the unit ends is never emitted.

Set-based form: one blocked pass of :func:`running` over the rows gives
``run`` (non-on rows before the row) and ``off_grp`` (off rows before the
row); runs are aggregated by ``(unit, off_grp, run)`` and a second scan over
the run table numbers the runs that have on rows (``seq``); the emitted session of an off group is its last run
with on rows, if an off closes the group. All steps are scans over bounded
blocks or aggregations with map-side combine, so one huge unit does not end
up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.scan import running
from seqlab.session import materialize

ON, OFF, HEADER, STOP = "on", "off", "header", "stop"


def sessionize(df: DataFrame, *, file_col: str, order_cols: Sequence[str], kind_col: str,
               time_col: str, settings_cols: Sequence[str] = (), header_cols: Sequence[str] = (),
               block_col: str | None = None, file_no: Column | None = None,
               carry_over: bool = True, id_col: str = "session_id", checkpoint_runs: bool = True) -> DataFrame:
    """Sessions, one row each: ``file_col, id_col, seq, n_on, start, end,
    *header_cols, *settings_cols``. ``file_no`` (default: ``file_col``) is the
    prefix of the session id ``<file_no>-<seq>``.

    ``checkpoint_runs`` writes the run table to the checkpoint folder before
    numbering it, so the row-level pass (the only step that touches every
    row) runs once."""
    kind = F.col(kind_col)
    order = list(order_cols)
    file_no = file_no if file_no is not None else F.col(file_col)
    hdr = F.struct(*[F.col(c) for c in header_cols]) if header_cols else F.struct(F.lit(None).alias("_"))

    rows = df.select(F.col(file_col), *[F.col(c) for c in order if c != file_col],
                     *([F.col(block_col)] if block_col and block_col not in order else []),
                     kind.alias("__kind"), F.col(time_col).alias("__time"),
                     F.struct(*[F.col(c) for c in settings_cols]).alias("__set"),
                     F.when(kind == HEADER, hdr).alias("__hdr_here"),
                     file_no.cast("string").alias("__file_no"))
    rows = running(rows, [file_col], order, block=block_col,
                   sums={"__stops": (F.col("__kind") == STOP).cast("int"),
                         "__not_on": (F.col("__kind") != ON).cast("int"),
                         "__offs": (F.col("__kind") == OFF).cast("int")},
                   lasts={"__hdr": F.col("__hdr_here")})
    rows = rows.where(F.col("__stops") == 0)
    on = F.col("__kind") == ON
    rows = rows.select(
        "*",
        (F.col("__not_on") - (~on).cast("int")).alias("__run"),
        (F.col("__offs") - (F.col("__kind") == OFF).cast("int")).alias("__off_grp"),
        (F.col(block_col) if block_col else F.lit(0)).alias("__blk"),
    )

    pos = F.struct(*[F.col(c) for c in order])
    first = F.struct(F.col("__hdr").alias("hdr"), F.col("__set").alias("set"), F.col("__time").alias("start"),
                     F.col("__file_no").alias("file_no"))
    runs = rows.groupBy(file_col, "__off_grp", "__run").agg(
        F.sum(F.col("__kind").eqNullSafe(ON).cast("int")).alias("n_on"),
        F.min_by(first, F.when(on, pos)).alias("first"),
        F.max_by(F.col("__time"), F.when(on, pos)).alias("end"),
        F.max(F.col("__kind").eqNullSafe(OFF).cast("int")).alias("has_off"),
        F.min("__blk").alias("__rblk"),
    )
    if checkpoint_runs:
        runs = materialize(runs)
    # Sequence number = runs with on rows so far in the unit, lost ones too;
    # a scan over the (much smaller) run table, blocked like the rows.
    runs = running(runs, [file_col], ["__run"], block="__rblk" if block_col else None,
                   sums={"seq": (F.col("n_on") > 0).cast("int")})
    if carry_over:
        sess = runs.groupBy(file_col, "__off_grp").agg(
            F.max_by(F.struct("n_on", "first", "end", "seq"), F.when(F.col("n_on") > 0, F.col("__run"))).alias("s"),
            F.max("has_off").alias("closed"),
        ).where((F.col("closed") == 1) & F.col("s").isNotNull()).select(file_col, "s.*")
    else:
        sess = runs.where((F.col("n_on") > 0) & (F.col("has_off") == 1)).select(file_col, "n_on", "first", "end",
                                                                                 "seq")

    return sess.select(
        F.col(file_col),
        F.concat(F.col("first.file_no"), F.lit("-"), F.col("seq").cast("string")).alias(id_col),
        F.col("seq").cast("int").alias("seq"),
        F.col("n_on").cast("int").alias("n_on"),
        F.col("first.start").alias("start"),
        F.col("end"),
        *[F.col(f"first.hdr.{c}").alias(c) for c in header_cols],
        *[F.col(f"first.set.{c}").alias(c) for c in settings_cols],
    )


def filter_min_events(sessions: DataFrame, k: int = 1, count_col: str = "n_on") -> DataFrame:
    """Keep sessions with more than ``k`` on events (NULL or unparsable drops)."""
    return sessions.where(F.col(count_col).cast("string").try_cast("int") > k)
