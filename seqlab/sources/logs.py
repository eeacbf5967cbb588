"""Ordered text sources: device log files and comma-separated tables.

Log files are read line by line with their position, never as one string
per file: every line carries its file, the byte offset of the split that
read it and a position inside that split, which orders the lines of a file
and gives the block id for the blocked scans (see
:func:`seqlab.functions.scan.running`). A file of any size is spread over
as many tasks as it has splits. ``whole_files=True`` is the other form (one
row per file, exploded into numbered lines) for small files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlab.functions.address import header_user, parse_address
from seqlab.functions.codes import POWER_ON


def file_number(path: str | Column) -> Column:
    """File number: the file's base name up to its first dot."""
    p = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(F.element_at(F.split(p, "/"), -1), r"\.", -1), 1)


def read_lines_ordered(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``file_path, block, pos, line`` (plus discovered partition columns);
    ``(block, pos)`` orders the lines of a file."""
    if whole_files:
        raw = spark.read.text(path, wholetext=True)
        parts = [c for c in raw.columns if c != "value"]
        return raw.select(F.col("_metadata.file_path").alias("file_path"), *parts,
                          F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("pos", "line")
                          ).select("file_path", *parts, F.lit(0).cast("long").alias("block"),
                                   F.col("pos").cast("long").alias("pos"), "line")
    raw = spark.read.text(path)
    parts = [c for c in raw.columns if c != "value"]
    return raw.select(F.col("_metadata.file_path").alias("file_path"), *parts,
                      F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


EVENT_FIELDS = ("speed", "direction", "mode", "raw6", "temp", "time")


def parse_log_lines(lines: DataFrame, on_bad: str = "error") -> DataFrame:
    """Kind and fields of each line.

    * empty line: ``stop`` (the rest of the file is ignored)
    * first field ``/``: an event, ``on`` when the state is ``poweron`` else
      ``off``; settings speed, direction, mode, raw6, temp and time
    * anything else: a ``header``: user (first field without its 3-character
      prefix), province and city from the address (``None`` = blank)

    Short lines fail the job (``on_bad='error'``, the reference's behaviour)
    or get kind ``bad`` (``on_bad='keep'``; see :func:`bad_lines`).
    """
    f = F.split("line", ",", -1)
    n = F.size(f)
    is_event = F.element_at(f, 1) == "/"
    short = F.when(F.col("line") == "", F.lit(False)).when(is_event, n < 9).otherwise(n < 2)
    kind = (F.when(F.col("line") == "", F.lit("stop"))
            .when(short, F.lit("bad"))
            .when(is_event, F.when(F.element_at(f, 3) == POWER_ON, F.lit("on")).otherwise(F.lit("off")))
            .otherwise(F.lit("header")))
    if on_bad == "error":
        kind = F.when(kind == "bad", F.raise_error(F.concat(F.lit("short log line: "), F.col("line")))
                      .cast("string")).otherwise(kind)
    get = lambda i: F.when(n >= i, F.element_at(f, i))
    province, city = parse_address(get(2))
    hdr = kind == "header"
    ev = kind.isin("on", "off")
    return lines.select(
        "*", kind.alias("kind"),
        F.when(hdr, header_user(F.element_at(f, 1))).alias("user"),
        F.when(hdr, province).alias("province"), F.when(hdr, city).alias("city"),
        *[F.when(ev, get(i + 4)).alias(name) for i, name in enumerate(EVENT_FIELDS)])


def bad_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") == "bad")


WEATHER_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                               ("city", "date", "time", "temperature", "w4", "w5", "w6", "w7")])


def read_weather(spark: SparkSession, path: str, columns: int = 8) -> DataFrame:
    """Comma-split weather lines (no quoting, no header). ``columns=4``
    keeps city, date, time and temperature only. Malformed lines are kept in
    ``_corrupt_record`` and get NULL fields instead of failing the job."""
    schema = T.StructType(WEATHER_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(schema).option("quote", "").option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").option("encoding", "UTF-8").csv(path))
    keep = [f.name for f in WEATHER_SCHEMA.fields][:columns]
    return df.select(*keep, F.try_to_timestamp(F.concat_ws(" ", "date", "time"),
                                               F.lit("yyyy-MM-dd HH:mm:ss")).alias("weather_ts"),
                     "_corrupt_record")


def read_delimited(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Comma-split text rows (no quoting, no header) as string columns with
    the given names; the form ``write_delimited`` produces (sessions, joined
    rows). Short rows get NULLs, extra fields are dropped."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("quote", "").option("mode", "PERMISSIVE").csv(path)


def read_csv_inferred(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header line and inferred types (UTF-8), optionally projected."""
    df = spark.read.option("header", True).option("inferSchema", True).option("encoding", "UTF-8").csv(path)
    return df.select(*columns) if columns else df


def read_instances(spark: SparkSession, path: str, quote: str = "|") -> DataFrame:
    """Learner instances: comma-separated numbers, last one the class; a
    custom quote character. Returns ``x array<double>, y int``."""
    df = spark.read.option("quote", quote).option("header", False).csv(path)
    cols = df.columns
    return df.select(F.array(*[F.col(c).try_cast("double") for c in cols[:-1]]).alias("x"),
                     F.col(cols[-1]).try_cast("double").cast("int").alias("y"))


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", num_features)
    return r.load(path)
