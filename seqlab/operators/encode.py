"""Category indexing, one-hot encoding, nominal declarations, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.scan import global_rank
from seqlab.session import materialize


# Category tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_CATEGORIES = 1_000_000


def category_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, idx)``: the index of every category of each column, most
    frequent first, ties in alphabetical order. One pass over ``df``; the
    categories stay a table and are ranked by ranges."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("p")).select("p.*")
    counts = pairs.where(F.col("value").isNotNull()).groupBy("column", "value").count()
    ranked = global_rank(counts, "column", F.desc("count"), "value", name="__r")
    first = ranked.groupBy("column").agg(F.min("__r").alias("__first"))  # a row per column
    return materialize(ranked.join(F.broadcast(first), "column")
                       .select("column", "value", (F.col("__r") - F.col("__first")).cast("int").alias("idx")))


def _indexed(df: DataFrame, cols: Sequence[str], suffix: str) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with the index columns, and the number of categories of each column."""
    categories = category_table(df, cols)
    sizes = {r["column"]: r["n"] for r in categories.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in cols:
        own = categories.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("idx").alias("__i"))
        if sizes.get(c, 0) <= BROADCAST_CATEGORIES:
            own = F.broadcast(own)
        missing = F.raise_error(F.concat(F.lit(f"no category in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))))
        df = (df.join(own, F.col(c).cast("string") == F.col("__v"), "left")
              .withColumn(c + suffix, F.coalesce("__i", missing.cast("int"))).drop("__v", "__i"))
    return df, sizes


def category_index(df: DataFrame, cols: Sequence[str], suffix: str = "_idx") -> DataFrame:
    """Index of each category per column, most frequent first, ties in
    alphabetical order; a NULL fails the job."""
    return _indexed(df, cols, suffix)[0]


def one_hot(df: DataFrame, cols: Sequence[str], drop_last: bool = False, suffix: str = "_vec") -> DataFrame:
    """Index then one-hot encode ``cols`` (sparse vector columns ``<c>_vec``).
    ``drop_last=False`` keeps every category as the reference's dataset does.
    The encoder is fitted on the number of categories alone."""
    out, sizes = _indexed(df, cols, "_idx")
    top = df.sparkSession.createDataFrame([tuple(float(max(1, sizes.get(c, 1)) - 1) for c in cols)], [c + "_idx" for c in cols])
    enc = OneHotEncoder(inputCols=[c + "_idx" for c in cols], outputCols=[c + suffix for c in cols],
                        dropLast=drop_last).fit(top)
    return enc.transform(out).drop(*[c + "_idx" for c in cols])


def vector_values(c: str | Column) -> Column:
    """Vector column as ``array<double>``."""
    return vector_to_array(F.col(c) if isinstance(c, str) else c, "float64")


def one_hot_dataset(df: DataFrame, vec_cols: Sequence[str], target_cols: Sequence[str],
                    out_col: str = "values") -> DataFrame:
    """Dense row: every one-hot vector's values, then the target codes."""
    parts = [vector_values(c) for c in vec_cols]
    tail = F.array(*[F.col(c).cast("double") for c in target_cols])
    return df.select("*", F.concat(*parts, tail).alias(out_col))


def declare_nominal(df: DataFrame, col: str, n_values: int) -> DataFrame:
    """Mark an integer code column as categorical with ``n_values`` values so
    that trees split it by category sets. The metadata must be attached with
    ``withMetadata``; an aliased ``withColumn`` silently loses it."""
    meta = {"ml_attr": {"type": "nominal", "name": col, "vals": [str(float(i)) for i in range(n_values)]}}
    return df.withColumn(col, F.col(col).cast("double")).withMetadata(col, meta)


def assemble(df: DataFrame, inputs: Sequence[str], out_col: str = "features",
             nominal: dict[str, int] | None = None) -> DataFrame:
    """Feature vector from numeric and vector columns (``VectorAssembler``);
    ``nominal`` columns are declared categorical first."""
    nominal = nominal or {}
    types = dict(df.dtypes)
    for c in inputs:
        if c not in nominal and types[c] != "vector":
            df = df.withColumn(c, F.col(c).cast("double"))
    for c, n in nominal.items():
        df = declare_nominal(df, c, n)
    return VectorAssembler(inputCols=list(inputs), outputCol=out_col, handleInvalid="error").transform(df)


def hash_split(key: str | Column, train_percent: int = 70, mult: int = 7919, add: int = 104729) -> Column:
    """Repeatable split flag from an integer id: ``(id*mult + add) % 100 <
    train_percent``. Independent of partitioning, unlike ``randomSplit``."""
    k = F.col(key) if isinstance(key, str) else key
    # Reduced modulo 100 first: same result, no overflow for any 64-bit id.
    return F.pmod(F.pmod(k.cast("long"), F.lit(100)) * F.lit(mult) + F.lit(add), F.lit(100)) < F.lit(train_percent)


def holdout_split(key: str | Column, train_percent: int = 70, seed: int = 0) -> Column:
    """Seeded random-order hold-out: a mixed hash (MD5 of seed and id) decides,
    so ids with any structure split evenly and a rerun gives the same split."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), k.cast("string")).cast("binary")), 1, 8), 16, 10)
    return F.pmod(h.cast("long"), F.lit(100)) < F.lit(train_percent)


DIGITS = 12     # bits of a value that one histogram tells apart


def kth_smallest(df: DataFrame, col: str, k: int, bits: int = 60) -> tuple[int, int, int]:
    """(value, taken, equal): the ``k``-th smallest (from 1) of a column of integers of
    ``bits`` bits, how many of its equals are among the ``k`` smallest, and how many equals it
    has. Each round is one aggregation into at most 4096 counts of the rows that agree with
    the bits found so far, so nothing is sorted and no row reaches the driver."""
    found, shift = 0, bits
    while True:
        step = min(DIGITS, shift)
        shift -= step
        inside = df.where(F.shiftright(col, shift + step) == found) if shift + step < bits else df
        digit = F.shiftright(col, shift).bitwiseAND(F.lit((1 << step) - 1))
        counts = sorted((r["d"], r["n"]) for r in inside.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for d, n in counts:
            if k <= n:
                break
            k -= n
        found = (found << step) | int(d)
        if shift == 0:
            return found, k, n


def exact_split(df: DataFrame, key: str | Column, train_percent: int = 70, seed: int = 0, name: str = "is_train") -> DataFrame:
    """Random-order split cut at exactly floor(n * percent / 100) rows: a row trains if its place
    in the order of the seeded hash of its key is before the cut. Rows of one key (and keys of
    one hash) are told apart by their place in the checkpointed rows, which is as many as needed
    of them. Null keys are one key; an empty table stays empty."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(k.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10)
    rows = materialize(df.withColumn("__h", h.cast("long")).withColumn("__m", F.monotonically_increasing_id()))
    total = rows.count()
    n = total * train_percent // 100
    if n == 0 or n == total:
        return rows.withColumn(name, F.lit(n > 0)).drop("__h", "__m")
    value, taken, equal = kth_smallest(rows, "__h", n)
    flag = F.col("__h") <= value
    if taken < equal:
        last, _, _ = kth_smallest(rows.where(F.col("__h") == value), "__m", taken, bits=63)
        flag = (F.col("__h") < value) | ((F.col("__h") == value) & (F.col("__m") <= last))
    return rows.withColumn(name, flag).drop("__h", "__m")


def split(df: DataFrame, key: str, train_percent: int = 70) -> tuple[DataFrame, DataFrame]:
    flag = hash_split(key, train_percent)
    return df.where(flag), df.where(~flag)
