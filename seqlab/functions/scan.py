"""Ordered running scans that stay balanced when one partition key is huge.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key into
one task. When one key may hold a third of all rows that task is the whole
job. ``running`` instead cuts each key into ordered *blocks* (a column the
caller supplies, e.g. the split offset of a text file or a time bucket), scans
every block on its own, summarises each block in one row, scans the small
block table, and joins the block offsets back. Work per task is bounded by the
block size, not by the key size.

Supported scans (all over ``order_by`` inside ``partition_by``):

* ``sums``   inclusive running sum of a numeric expression (NULL counts 0)
* ``lasts``  last non-NULL value at or before the row
* ``firsts`` first non-NULL value at or after the row
* ``prevs``  value of the previous row (NULL on the first row of the key)
* ``starts`` running count of the rows that start a run of one value

A frame that ends at the last row is computed anew from every row of its window
(the square of a key's rows), so ``firsts`` are last values in the reverse order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.session import materialize


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def running(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], *,
            block: str | None = None,
            sums: Mapping[str, Column] | None = None,
            lasts: Mapping[str, Column] | None = None,
            firsts: Mapping[str, Column] | None = None,
            prevs: Mapping[str, Column] | None = None,
            starts: Mapping[str, tuple[Column, object]] | None = None) -> DataFrame:
    """Add running-scan columns to ``df``; see module doc.

    ``starts`` maps a name to ``(column, value)``: the running count of rows
    that start a run of ``value`` (the column equals ``value`` and the
    previous row's does not).

    ``block`` names a column of ``df`` that is monotone in ``order_by`` inside
    each partition: every row of a smaller block precedes every row of a
    larger one. A key whose rows all have a NULL block is not split: it is one
    window, without a summary. Without ``block`` the scan is one window per
    key (fine when keys are known to be small).
    """
    sums, lasts, firsts, prevs = dict(sums or {}), dict(lasts or {}), dict(firsts or {}), dict(prevs or {})
    starts = dict(starts or {})
    part, order = list(partition_by), list(order_by)

    # All partition columns in one struct: never NULL, so the block offsets
    # join back with a plain equi-join on the very columns the rows are
    # already partitioned by (NULL keys still form one partition).
    staged = df.select("*", F.struct(*[F.col(c) for c in part]).alias("__pk"),
                       *[F.coalesce(c, F.lit(0)).alias(f"__s_{n}") for n, c in sums.items()],
                       *[c.alias(f"__l_{n}") for n, c in lasts.items()],
                       *[c.alias(f"__f_{n}") for n, c in firsts.items()],
                       *[c.alias(f"__p_{n}") for n, c in prevs.items()],
                       *[c.alias(f"__r_{n}") for n, (c, _) in starts.items()])
    keys = ["__pk"] + ([block] if block else [])
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*keys).orderBy(*[c.desc() for c in _cols(order)])
    ahead = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def is_v(n):
        return F.coalesce(F.col(f"__r_{n}") == F.lit(starts[n][1]), F.lit(False))

    local = staged.select(
        "*",
        *[F.sum(f"__s_{n}").over(upto).alias(f"__ls_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(upto).alias(f"__ll_{n}") for n in lasts],
        *[F.last(f"__f_{n}", ignorenulls=True).over(ahead).alias(f"__lf_{n}") for n in firsts],
        *[F.lag(f"__p_{n}").over(w).alias(f"__lp_{n}") for n in prevs],
        *[is_v(n).alias(f"__rv_{n}") for n in starts],
        *([F.row_number().over(w).alias("__rn")] if (block and prevs) else []),
    )
    if starts:
        local = local.select("*", *[
            (F.col(f"__rv_{n}") & ~F.coalesce(F.lag(f"__rv_{n}").over(w), F.lit(False))).cast("long")
            .alias(f"__rs_{n}") for n in starts])
        local = local.select("*", *[F.sum(f"__rs_{n}").over(upto).alias(f"__lr_{n}") for n in starts])
    outputs = set(sums) | set(lasts) | set(firsts) | set(prevs) | set(starts)

    if not block:
        out = local.select("*", *[F.col(f"__ls_{n}").alias(n) for n in sums],
                           *[F.col(f"__ll_{n}").alias(n) for n in lasts],
                           *[F.col(f"__lf_{n}").alias(n) for n in firsts],
                           *[F.col(f"__lp_{n}").alias(n) for n in prevs],
                           *[F.col(f"__lr_{n}").alias(n) for n in starts])
        return out.drop(*[c for c in out.columns if c not in df.columns and c not in outputs])

    # One summary row per block of the split keys (the filter reaches below the
    # windows), then a scan over the (small) block table. Unsplit keys have no
    # offsets; the left join keeps their rows as they are.
    pos = F.struct(*_cols(order))
    summary = local.where(F.col(block).isNotNull()).groupBy(*keys).agg(
        *[F.sum(f"__s_{n}").alias(f"__bs_{n}") for n in sums],
        *[F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), pos)).alias(f"__bl_{n}") for n in lasts],
        *[F.min_by(f"__f_{n}", F.when(F.col(f"__f_{n}").isNotNull(), pos)).alias(f"__bf_{n}") for n in firsts],
        *[F.max_by(f"__p_{n}", pos).alias(f"__bp_{n}") for n in prevs],
        *[F.sum(f"__rs_{n}").alias(f"__bt_{n}") for n in starts],
        *[F.min_by(f"__rv_{n}", pos).alias(f"__bfv_{n}") for n in starts],
        *[F.max_by(f"__rv_{n}", pos).alias(f"__blv_{n}") for n in starts],
        F.count(F.lit(1)).alias("__bn"),
    )
    wb = Window.partitionBy("__pk").orderBy(block)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("__pk").orderBy(F.col(block).desc()).rowsBetween(Window.unboundedPreceding, -1)
    if starts:
        # A block whose first row continues the previous block's run does
        # not start a run there.
        summary = summary.select("*", *[
            (F.col(f"__bfv_{n}") & F.coalesce(F.lag(f"__blv_{n}").over(wb), F.lit(False))).cast("long")
            .alias(f"__bc_{n}") for n in starts])
    offsets = summary.select(
        *keys,
        *[F.coalesce(F.sum(f"__bs_{n}").over(before), F.lit(0)).alias(f"__os_{n}") for n in sums],
        *[F.last(f"__bl_{n}", ignorenulls=True).over(before).alias(f"__ol_{n}") for n in lasts],
        *[F.last(f"__bf_{n}", ignorenulls=True).over(after).alias(f"__of_{n}") for n in firsts],
        *[F.lag(f"__bp_{n}").over(wb).alias(f"__op_{n}") for n in prevs],
        *[(F.coalesce(F.sum(F.col(f"__bt_{n}") - F.col(f"__bc_{n}")).over(before), F.lit(0))
           - F.col(f"__bc_{n}")).alias(f"__or_{n}") for n in starts],
    )
    joined = local.join(offsets, on=keys, how="left")
    out = joined.select(
        "*",
        *[(F.col(f"__ls_{n}") + F.coalesce(f"__os_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"__ll_{n}", f"__ol_{n}").alias(n) for n in lasts],
        *[F.coalesce(f"__lf_{n}", f"__of_{n}").alias(n) for n in firsts],
        *[F.when(F.col("__rn") == 1, F.col(f"__op_{n}")).otherwise(F.col(f"__lp_{n}")).alias(n) for n in prevs],
        *[(F.col(f"__lr_{n}") + F.coalesce(f"__or_{n}", F.lit(0))).alias(n) for n in starts],
    )
    return out.drop(*[c for c in out.columns if c not in df.columns and c not in outputs])


def time_block(ts: str | Column, unit: str = "hour") -> Column:
    """Block id for :func:`running` from a timestamp: truncation to ``unit``
    (``minute``, ``hour``, ``day``, ...). Monotone in time for TIMESTAMP and
    TIMESTAMP_NTZ alike. Pick the unit so one unit of the busiest key fits a
    task comfortably.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    # NULL times sort first, so they are the first block
    return F.coalesce(F.unix_micros(F.date_trunc(unit, c).cast("timestamp")), F.lit(-(1 << 63)))


# Rows of a heavy key sampled per block, for its cut points.
SAMPLES = 64
# Pieces that a key's sample is gathered in; no row holds more than one piece.
SLOTS = 1024


def _cut_points(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], target_rows: int) -> DataFrame:
    """One row per heavy key: ``__hk0``.. and ``__cuts``, the sorted rows to cut at.

    One pass over ``df`` counts rows and gathers samples, a key's sample in
    ``SLOTS`` pieces. The samples of heavy keys are numbered in order as rows (a
    sort that can spill), so only the cuts of a key come together in one row.
    """
    every = max(1, target_rows // SAMPLES)
    step = -(-target_rows // every)
    pos, names = F.struct(*[F.col(c) for c in order_by]), [f"__hk{i}" for i in range(len(keys))]
    h = F.xxhash64(*[F.col(c) for c in order_by])
    sampled = F.pmod(h, F.lit(every)) == 0
    slot = F.when(sampled, F.pmod(F.xxhash64(h), F.lit(SLOTS)))
    pieces = (df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], slot.alias("__slot"))
              .agg(F.count(F.lit(1)).alias("__n"), F.collect_list(F.when(sampled, pos)).alias("__s")))
    per_key = Window.partitionBy(*names)
    rows = (pieces.withColumn("__n", F.sum("__n").over(per_key)).where(F.col("__n") > target_rows)
            .select(*names, F.explode_outer("__s").alias("__p")))
    place = F.row_number().over(per_key.orderBy(F.col("__p").asc_nulls_last())) - 1
    rows = rows.withColumn("__i", place)
    is_cut = F.col("__p").isNotNull() & (F.col("__i") > 0) & (F.col("__i") % step == 0)
    return rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.when(is_cut, F.col("__p")))).alias("__cuts"))


def with_order_blocks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], target_rows: int = 1_000_000,
                      out_col: str = "blk") -> DataFrame:
    """Add a block id for :func:`running` that cuts heavy keys at equal depth.

    A key with at most ``target_rows`` rows gets NULL (it is not split). A
    heavier key is cut at rows of a deterministic sample (hash of the order
    columns), so each block has about ``target_rows`` rows wherever they lie:
    bursts of one time are cut by the other order columns, and NULLs, which
    sort first, fall into the first blocks. Only rows equal in all order
    columns cannot be cut apart.

    The plan stays lazy. The table of heavy keys with their cut points has at
    most about one entry per ``target_rows`` rows (a million entries, about 40 MB,
    for 10^12 rows); it is broadcast, so rows are not shuffled for it. A row's
    block is found among a key's cuts in two steps of about the square root of
    their number.
    """
    pos = F.struct(*[F.col(c) for c in order_by])
    heavy = _cut_points(df, keys, order_by, target_rows)
    heavy = heavy.withColumn("__g", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("__cuts")))).cast("int"))
    heavy = heavy.withColumn("__heads", F.filter("__cuts", lambda _, i: i % F.col("__g") == 0))
    cond = None
    for i, k in enumerate(keys):
        e = df[k].eqNullSafe(heavy[f"__hk{i}"])
        cond = e if cond is None else cond & e
    joined = df.join(F.broadcast(heavy), on=cond, how="left").withColumn("__pos", pos)
    joined = joined.withColumn("__h", F.size(F.filter("__heads", lambda c: c <= F.col("__pos"))))
    fine = F.slice("__cuts", F.greatest(F.lit(0), F.col("__h") - 1) * F.col("__g") + 1, F.col("__g"))
    blk = F.when(F.col("__h") == 0, F.lit(0)).otherwise(
        (F.col("__h") - 1) * F.col("__g") + F.size(F.filter(fine, lambda c: c <= F.col("__pos"))))
    out = joined.withColumn(out_col, F.when(F.col("__cuts").isNotNull(), blk).cast("long"))
    return out.drop("__cuts", "__g", "__heads", "__pos", "__h", *[f"__hk{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Add the 0-based position in the global order. Rows are dealt out by
    ranges of the order; every task numbers its own range, and one row per
    range carries the offsets. The dealt rows are checkpointed, since ranges
    come from a sample that a second run of the plan would draw anew."""
    own = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = own.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (own.withColumn("__part", part).join(offsets, "__part")
            .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__before", "__at"))
