"""Text and table writers in the reference's output formats.

All writers run on the executors (``write.text`` / ``write.parquet``); no
result goes through the driver. Every writer overwrites its target, so a
re-run replaces the previous result (idempotent output).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.sources.logs import read_lines_ordered


def _text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(""))


def delimited_line(cols: Sequence[str | Column], sep: str = ",") -> Column:
    """Fields joined by ``sep``; NULL is written as an empty field (plain
    ``concat_ws`` would skip it and shift the columns)."""
    return F.concat_ws(sep, *[_text(c) for c in cols])


def integral_line(cols: Sequence[str | Column], sep: str = ",") -> Column:
    """Numeric fields with zero decimals (``'{:.0f}'``: half to even)."""
    return F.concat_ws(sep, *[_text(F.bround((F.col(c) if isinstance(c, str) else c).cast("double"), 0)
                                    .cast("long")) for c in cols])


def dataset_line(feature_cols: Sequence[str], label_col: str, label_sep: str = "#") -> Column:
    """``f1,f2,...#label`` rows of the dataset file."""
    return F.concat(integral_line(feature_cols), F.lit(label_sep), integral_line([label_col]))


def libsvm_line(feature_cols: Sequence[str], label_col: str) -> Column:
    """``label 1:x1 2:x2 ...`` (1-based indices, every feature written)."""
    parts = [F.concat(F.lit(f"{i + 1}:"), _text(c)) for i, c in enumerate(feature_cols)]
    return F.concat_ws(" ", _text(label_col), *parts)


def dictionary_line(index_col: str, text_col: str) -> Column:
    """``idx:{temp,mode,direction,speed}`` rows of the label dictionary."""
    return F.concat(_text(index_col), F.lit(":{"), _text(text_col), F.lit("}"))


def write_lines(df: DataFrame, line: Column, path: str, sort_by: Sequence[str | Column] | None = None) -> None:
    """One text line per row (UTF-8), overwriting ``path``. ``sort_by`` gives
    a globally ordered result (range-partitioned sort)."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"__sort{i}") for i, c in enumerate(sort_by or [])]
    out = df.select(line.alias("value"), *keys)
    if keys:
        out = out.orderBy(*[f"__sort{i}" for i in range(len(keys))])
    out.select("value").write.mode("overwrite").text(path)


def part_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``part, file_path, first_line, n_lines, first_byte, n_bytes`` of a folder that ``write_lines``
    wrote in order: where each part file's lines and bytes stand in the one sorted file that the
    parts make when read one after the other. A row a file; the running sums go over those."""
    per = (_part_lines(spark, path).groupBy("part", "file_path")
           .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("size").alias("n_bytes")))
    before = Window.orderBy("part", "file_path").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", "file_path", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("first_line"), "n_lines",
                      F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("first_byte"), "n_bytes")


def _part_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_lines_ordered(spark, path).select(
        "*", F.regexp_extract("file_path", r"part-(\d+)[^/]*$", 1).cast("long").alias("part"),
        (F.octet_length("line") + 1).cast("long").alias("size"))


def read_sorted_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` (from 0), ``first_byte``, ``line``: the parts read back as one ordered file.
    Places inside a part are counted in windows of one file; the manifest adds what is before it."""
    here = Window.partitionBy("file_path").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = _part_lines(spark, path).select("file_path", "line", F.count(F.lit(1)).over(here).alias("__line"),
                                            F.coalesce(F.sum("size").over(here), F.lit(0)).alias("__byte"))
    parts = part_manifest(spark, path).select("file_path", F.col("first_line").alias("__l"), F.col("first_byte").alias("__b"))
    return lines.join(parts, "file_path").select((F.col("__line") + F.col("__l")).alias("line_no"),
                                                 (F.col("__byte") + F.col("__b")).alias("first_byte"), "line")


def write_delimited(df: DataFrame, path: str, cols: Sequence[str] | None = None, sep: str = ",",
                    sort_by: Sequence[str | Column] | None = None) -> None:
    write_lines(df, delimited_line(cols or df.columns, sep), path, sort_by)


def write_libsvm(df: DataFrame, path: str, label_col: str = "label", features_col: str = "features") -> None:
    """LibSVM through Spark's own data source (a vector column)."""
    df.select(F.col(label_col).cast("double").alias("label"), F.col(features_col).alias("features")) \
        .write.mode("overwrite").format("libsvm").save(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append one metrics row set to a Parquet table (run reports)."""
    df.write.mode("append").parquet(path)
