"""Parquet tables of a data folder (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, data_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, data_dir, n).createOrReplaceTempView(n)


def read_period(df: DataFrame, date_col: str, period: str) -> DataFrame:
    """Rows of one month ``YYYYMM`` (or one day ``YYYYMMDD``) of ``date_col``.

    A half-open range of constants on the column itself, so Parquet min/max
    statistics and partition pruning (for a ``period=`` folder layout) apply.
    """
    import datetime as dt

    from pyspark.sql import functions as F
    y, m = int(period[:4]), int(period[4:6])
    if len(period) == 6:
        start, end = dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1)
    else:
        start = dt.date(y, m, int(period[6:8]))
        end = start + dt.timedelta(days=1)
    typ = df.schema[date_col].dataType
    c = F.col(date_col)
    return df.where((c >= F.lit(start.isoformat()).cast(typ)) & (c < F.lit(end.isoformat()).cast(typ)))
