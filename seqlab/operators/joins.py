"""Nearest-in-time join inside an equality key (two-sided as-of join)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlab.functions.scan import running, time_block, with_order_blocks

# Right sides up to this size are broadcast by ``strategy='auto'``: all rows, and rows of
# one key (a key's rows are one array, which its left rows carry through the search).
BROADCAST_ROWS = 1_000_000
BROADCAST_KEY_ROWS = 4096


def _micros_between(a, b):
    return F.timestamp_diff("MICROSECOND", a, b)


def nearest_join(left: DataFrame, right: DataFrame, *, left_keys: Sequence[str], right_keys: Sequence[str],
                 left_ts: str, right_ts: str, right_cols: Sequence[str], max_gap_seconds: float | None = None,
                 strategy: str = "scan", block_unit: str | None = "auto", block_rows: int = 1_000_000) -> DataFrame:
    """Every ``left`` row once, with ``right_cols`` of the right row of the
    same key nearest in time (NULLs when the key has none, or when the gap is
    above ``max_gap_seconds``). Ties: smaller gap, then earlier right time,
    then smaller ``right_cols`` values (deterministic replacement of the
    reference's list-order rule).

    Plans:

    * ``'scan'`` (default): left and right rows are unioned, ordered by time
      inside the key and scanned for the last right row before and the first
      right row after each left row. Keys above ``block_rows`` rows are cut into
      blocks of about that many rows (``block_unit='auto'``; a unit such as
      ``'minute'`` cuts by time; ``None`` scans every key as one block), so a
      hot key is spread over many tasks. No pairs are ever built.
    * ``'auto'``: the right rows are counted by key, and ``'broadcast'`` is taken up to
      ``BROADCAST_ROWS`` of them and ``BROADCAST_KEY_ROWS`` of a key, else ``'scan'``.
    * ``'broadcast'``: only for a right side the caller knows to be small.
      Right rows are sorted into one array per key and broadcast; every left
      row finds its nearest by binary search. No shuffle of the left side.
    """
    lk = [f"__k{i}" for i in range(len(left_keys))]
    # a right row without key or time matches nothing
    right = right.dropna(subset=[right_ts, *right_keys])
    if strategy == "auto":
        size = right.groupBy(*right_keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("key")).first()
        small = (size["rows"] or 0) <= BROADCAST_ROWS and (size["key"] or 0) <= BROADCAST_KEY_ROWS
        strategy = "broadcast" if small else "scan"
    payload = F.struct(*[F.col(c) for c in right_cols])

    if strategy == "broadcast":
        cands = (right.select(*[F.col(c).alias(k) for c, k in zip(right_keys, lk)],
                              F.struct(F.col(right_ts).alias("t"), payload.alias("p")).alias("__c"))
                 .groupBy(*lk, F.col("__c.t").alias("__t")).agg(F.min("__c").alias("__c"))
                 .groupBy(*lk).agg(F.sort_array(F.collect_list("__c")).alias("__cands")))
        joined = left.join(F.broadcast(cands), on=[left[c] == cands[k] for c, k in zip(left_keys, lk)], how="left")
        lt, n = F.col(left_ts), F.size("__cands")

        def halve(s, _):
            """First place whose time is after the left time lies in [lo, hi]."""
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            after = F.get("__cands", mid)["t"] > lt
            open_ = s["lo"] < s["hi"]
            return F.struct(F.when(open_ & ~after, mid + 1).otherwise(s["lo"]).alias("lo"),
                            F.when(open_ & after, mid).otherwise(s["hi"]).alias("hi"))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
        at = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])
        joined = joined.withColumn("__at", F.when(lt.isNotNull() & (n > 0), at))
        near = F.transform(F.array_compact(F.array(F.get("__cands", F.col("__at") - 1), F.get("__cands", F.col("__at")))),
                           lambda x: F.struct(F.abs(_micros_between(x["t"], lt)).alias("d"), x["t"].alias("t"), x["p"].alias("p")))
        best = F.array_min(near)
        out = joined.select(*[left[c] for c in left.columns], F.when(F.col("__at").isNotNull(), best).alias("__best"))
    elif strategy == "scan":
        lcols = left.columns
        # A row with a NULL key or time cannot match: it gets a salt of its
        # own, so such rows neither meet right rows nor pile up in one task.
        matchable = F.col(left_ts).isNotNull()
        for c in left_keys:
            matchable = matchable & F.col(c).isNotNull()
        lefts = left.select(*[F.col(c).alias(k) for c, k in zip(left_keys, lk)],
                            F.col(left_ts).alias("__t"), F.lit(0).alias("__side"),
                            F.struct(*[F.col(c) for c in lcols]).alias("__left"),
                            F.when(matchable, F.lit(0)).otherwise(F.xxhash64(*[F.col(c) for c in lcols]))
                            .alias("__salt"))
        # One right row per (key, time): the smallest payload wins a tie.
        rights = (right.select(*[F.col(c).alias(k) for c, k in zip(right_keys, lk)],
                               F.col(right_ts).alias("__t"), payload.alias("__p"))
                  .groupBy(*lk, "__t").agg(F.min("__p").alias("__p"))
                  .select(*lk, "__t", F.lit(1).alias("__side"),
                          F.struct(F.col("__t").alias("t"), F.col("__p").alias("p")).alias("__r"),
                          F.lit(0).cast("long").alias("__salt")))
        lefts = lefts.withColumn("__r", F.lit(None).cast(rights.schema["__r"].dataType))
        rights = rights.withColumn("__left", F.lit(None).cast(lefts.schema["__left"].dataType))
        # equal times are told apart by a hash, so that a burst can be cut into blocks too
        both = lefts.unionByName(rights).withColumn("__tie", F.xxhash64("__left"))
        order = ["__t", "__side", "__tie"]
        if block_unit == "auto":
            both = with_order_blocks(both, [*lk, "__salt"], order, block_rows, "__blk")
        elif block_unit:
            both = both.withColumn("__blk", time_block("__t", block_unit))
        scanned = running(both, [*lk, "__salt"], order, block="__blk" if block_unit else None,
                          lasts={"__prev": F.col("__r")}, firsts={"__next": F.col("__r")})
        scanned = scanned.where(F.col("__side") == 0)
        lt = F.col("__t")
        dp = F.abs(_micros_between(F.col("__prev.t"), lt))
        dn = F.abs(_micros_between(lt, F.col("__next.t")))
        pick_prev = F.col("__prev").isNotNull() & (F.col("__next").isNull() | (dp <= dn))
        best = (F.when(pick_prev, F.struct(dp.alias("d"), F.col("__prev.t").alias("t"), F.col("__prev.p").alias("p")))
                .when(F.col("__next").isNotNull(),
                      F.struct(dn.alias("d"), F.col("__next.t").alias("t"), F.col("__next.p").alias("p"))))
        out = scanned.select(*[F.col(f"__left.{c}").alias(c) for c in lcols], best.alias("__best"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")

    if max_gap_seconds is not None:
        ok = F.col("__best.d") <= F.lit(int(max_gap_seconds * 1_000_000))
        out = out.withColumn("__best", F.when(ok, F.col("__best")))
    return out.select(*[F.col(c) for c in out.columns if c != "__best"],
                      *[F.col(f"__best.p.{c}").alias(c) for c in right_cols])
