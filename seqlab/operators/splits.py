"""The best first split of a decision tree, from grouped counts.

Counts of (feature, value, class) are one aggregation; everything after it works
on that table. For a threshold after each value the gini impurity needs, per side,
the sum of squared class counts. The left one grows from value to value by
2 * (class rows so far) * (class rows here) + (class rows here)^2, the right one
follows from the totals, so running sums in the order of the values are enough and
no table of all thresholds and classes is made. All sums are exact integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.scan import running, with_order_blocks
from seqlab.session import materialize

BLOCK_VALUES = 1_000_000    # values of a feature scanned in one piece


def feature_counts(df: DataFrame, features: Sequence[str | Column], label: str) -> DataFrame:
    """``f, v, y, c``: rows of each class with each value of each feature (index in ``features``)."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in features]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), c.alias("v")) for i, c in enumerate(cols)]))
    return (df.select(pairs.alias("p"), F.col(label).cast("double").alias("y")).where(F.col("p.v").isNotNull() & F.col("y").isNotNull())
            .groupBy("p.f", "p.v", "y").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c")))


def split_gains(counts: DataFrame) -> DataFrame:
    """``f, threshold, n_left, n_right, gain`` of every threshold between neighbouring values."""
    counts = materialize(counts)
    total = (counts.groupBy("f", "y").agg(F.sum("c").alias("t")))
    whole = total.groupBy("f").agg(F.sum("t").alias("n"), F.sum(_d(F.col("t") * F.col("t"))).alias("squares"))
    blocked = with_order_blocks(counts, ["f", "y"], ["v"], BLOCK_VALUES)
    so_far = running(blocked, ["f", "y"], ["v"], block="blk", sums={"upto": F.col("c")})
    step = _d(2 * (F.col("upto") - F.col("c")) * F.col("c")) + _d(F.col("c") * F.col("c"))
    values = (so_far.join(total, ["f", "y"]).groupBy("f", "v")
              .agg(F.sum("c").alias("c"), F.sum(step).alias("step"), F.sum(_d(F.col("t") * F.col("c"))).alias("cross")))
    values = running(with_order_blocks(values, ["f"], ["v"], BLOCK_VALUES), ["f"], ["v"], block="blk",
                     sums={"nl": F.col("c"), "sl": F.col("step"), "tl": F.col("cross")}, firsts={})
    nexts = running(values.drop("blk").withColumn("back", -F.col("v")).transform(
        lambda d: with_order_blocks(d, ["f"], ["back"], BLOCK_VALUES)), ["f"], ["back"], block="blk", prevs={"next": F.col("v")})
    rows = nexts.where("next IS NOT NULL").join(F.broadcast(whole), "f")       # a row a feature
    n, nl, sl = (F.col(c).cast("double") for c in ("n", "nl", "sl"))
    nr = (F.col("n") - F.col("nl")).cast("double")
    sr = (F.col("squares") - 2 * F.col("tl") + F.col("sl")).cast("double")
    gain = (sl / nl + sr / nr) / n - F.col("squares").cast("double") / n / n
    return rows.select("f", ((F.col("v") + F.col("next")) / 2).alias("threshold"), F.col("nl").cast("long").alias("n_left"),
                       (F.col("n") - F.col("nl")).cast("long").alias("n_right"), gain.alias("gain"))


def _d(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def best_split(df: DataFrame, features: Sequence[str | Column], label: str) -> DataFrame:
    """The threshold with the greatest gini gain (to 12 decimals; ties to the first feature and lowest threshold)."""
    gains = split_gains(feature_counts(df, features, label))
    return gains.orderBy(F.round("gain", 12).desc(), "f", "threshold").limit(1)


def side_classes(df: DataFrame, left: Column, label: str) -> DataFrame:
    """``left, cls``: the most frequent class of either side, ties to the smallest."""
    counts = df.groupBy(left.alias("left"), F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("left").agg(F.max_by("cls", F.struct("c", -F.col("cls"))).alias("cls"))
