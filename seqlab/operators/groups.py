"""Group-size filters and sorted outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.scan import global_rank, running, with_order_blocks


def filter_min_group(df: DataFrame, key: str | Sequence[str], k: int = 3,
                     size_col: str | None = "n_sessions") -> DataFrame:
    """Keep rows whose group has more than ``k`` rows; optionally keep the
    group size as a column.

    The sizes come from an aggregation (map-side combined, so a hot key costs
    one partial count per task) joined back on the key; adaptive execution
    splits the join partitions of a hot key. No window collects a group into
    one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    name = size_col or "__size"
    sizes = (df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias(name)).where(F.col(name) > k)
             .select(*[F.col(c).alias(f"__g_{c}") for c in keys], name))
    # NULL keys form one group, as in the reference (missing user = "").
    cond = None
    for c in keys:
        e = df[c].eqNullSafe(sizes[f"__g_{c}"])
        cond = e if cond is None else cond & e
    out = df.join(sizes, on=cond, how="inner").drop(*[f"__g_{c}" for c in keys])
    return out if size_col else out.drop(name)


def ordered_chunks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str], chunk_rows: int = 1000,
                   block_rows: int = 1_000_000) -> DataFrame:
    """The rows of each key in order, as lists of bounded length: ``keys, chunk, rows``
    (``array<struct<cols>>``; chunks from 0, each of ``chunk_rows`` rows but a key's last one).

    Places come from a blocked running count, so a hot key is many blocks and many chunks and
    no task or row holds it whole. NULL keys are a key; rows alike in ``order_by`` follow in
    order of ``cols``.
    """
    order = [*order_by, *[c for c in cols if c not in order_by]]
    blocked = with_order_blocks(df, keys, order, block_rows, "__blk")
    at = running(blocked, keys, order, block="__blk", sums={"__at": F.lit(1)}).withColumn("__at", F.col("__at") - 1)
    lists = at.groupBy(*keys, F.floor(F.col("__at") / chunk_rows).cast("long").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("__at", F.struct(*cols).alias("row")))).alias("__rows"))
    return lists.select(*keys, "chunk", F.col("__rows.row").alias("rows"))


def sort_key(*cols: str | Column, sep: str = " ") -> Column:
    """String sort key as the reference builds it (``user + ' ' + start``)."""
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
                              for c in cols])


def sort_sessions(df: DataFrame, key: Column, rank_col: str | None = None) -> DataFrame:
    """Globally sorted output (range-partitioned sort, done at the sink).

    ``rank_col`` adds the 1-based position in that order: rows are dealt out
    by ranges of the key and numbered in their range, so no task sees all rows
    and a hot user or day is split by the range bounds.
    """
    if rank_col is None:
        return df.orderBy(key)
    ranked = global_rank(df.withColumn("__key", key), "__key", name=rank_col)
    return ranked.withColumn(rank_col, (F.col(rank_col) + 1).cast("long")).drop("__key")
