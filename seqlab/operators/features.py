"""Sliding feature windows, range filters and category coding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.scan import running


def sliding_features(df: DataFrame, key: str, order_cols: Sequence[str | Column], *,
                     width: int = 4, feature_cols: Sequence[str] = (),
                     target_cols: Mapping[str, str] | None = None,
                     start_cols: Mapping[str, str] | None = None,
                     block: str | None = None, bucket_rows: int = 4096) -> DataFrame:
    """One row per run of ``width`` consecutive rows of a key.

    Features ``<c>1 .. <c><width-1>`` come from the first ``width-1`` rows,
    targets (``{out: col}``) from the last row, ``start_cols`` from the first
    row. A key with ``n`` rows gives ``max(n - width + 1, 0)`` rows; NULL
    values never drop a row.

    With ``block`` (a column monotone in the order, see :func:`running`) the
    position of every row is a blocked running count, rows are cut into
    buckets of ``bucket_rows`` positions, and the first ``width-1`` rows of
    each bucket are copied into the previous bucket, so every window lies in
    one bucket and no key is ever scanned by one task as a whole.
    """
    if bucket_rows < width:
        raise ValueError("bucket_rows must be at least the window width")
    target_cols = dict(target_cols or {})
    start_cols = dict(start_cols or {})
    span = width - 1
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    needed = sorted(set(feature_cols) | set(target_cols.values()) | set(start_cols.values()))

    if block is None:
        base = df.select(*dict.fromkeys([key, *needed]), *order)
        w = Window.partitionBy(key).orderBy(*order)
        part_w, owned = w, F.lit(True)
    else:
        names = [c for c in order_cols if isinstance(c, str)]
        if len(names) != len(order_cols):
            raise ValueError("blocked sliding windows need named order columns")
        keep = list(dict.fromkeys([key, *needed, *names, block]))
        pos = running(df.select(*keep), [key], names, block=block,
                      sums={"__pos": F.lit(1)})
        pos = pos.withColumn("__pos", F.col("__pos") - 1)
        bucket = F.floor(F.col("__pos") / bucket_rows)
        # Every row once in its bucket; the first rows of a bucket once more
        # in the previous bucket (one pass over the input, no union).
        halo = (F.col("__pos") % bucket_rows < span) & (F.col("__pos") >= bucket_rows)
        copies = F.when(halo, F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")),
                                      F.struct((bucket - 1).alias("b"), F.lit(False).alias("own"))))\
            .otherwise(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own"))))
        base = (pos.select("*", F.explode(copies).alias("__copy"))
                .select("*", F.col("__copy.b").alias("__bucket"), F.col("__copy.own").alias("__own"))
                .drop("__copy"))
        part_w = Window.partitionBy(key, "__bucket").orderBy("__pos")
        owned = F.col("__own")

    cols = [F.col(key)]
    cols += [F.col(c).alias(out) for out, c in start_cols.items()]
    for c in feature_cols:
        cols += [(F.col(c) if j == 0 else F.lead(c, j).over(part_w)).alias(f"{c}{j + 1}") for j in range(span)]
    cols += [F.lead(c, span).over(part_w).alias(out) for out, c in target_cols.items()]
    cols += [F.lead(F.lit(1), span).over(part_w).alias("__full"), owned.alias("__keep")]
    out = base.select(*cols)
    return out.where(F.col("__full").isNotNull() & F.col("__keep")).drop("__full", "__keep")


def strict_int(c: str | Column) -> Column:
    """Integer value of a text or number column; NULL unless it is an integer
    with an optional sign and white space around it (``'25.0'`` and ``''`` are not)."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def filter_range(df: DataFrame, cols: Sequence[str], lo: int, hi: int,
                 required: Sequence[str] = (), on_bad: str = "error") -> DataFrame:
    """Keep rows whose ``cols`` all lie in ``[lo, hi]`` and whose ``required``
    columns are neither NULL nor blank.

    ``on_bad='error'`` fails the job on a value that is not an integer (the
    reference's ``int()``); ``'drop'`` treats it as out of range.
    """
    conds = []
    for c in cols:
        v = strict_int(c)
        if on_bad == "error":
            v = F.when(v.isNull() & F.col(c).isNotNull(),
                       F.raise_error(F.concat(F.lit(f"not an integer in {c}: "), F.col(c).cast("string")))
                       .cast("int")).otherwise(v)
        conds.append(v.between(lo, hi))
    for c in required:
        conds.append(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    cond = conds[0]
    for x in conds[1:]:
        cond = cond & x
    return df.where(F.coalesce(cond, F.lit(False)))


def code_of(c: str | Column, mapping: Mapping[str, int], on_bad: str = "error") -> Column:
    """Dictionary code of a category value (``create_map`` literal lookup).

    An unknown value fails the job (``on_bad='error'``) or becomes NULL.
    """
    col = F.col(c) if isinstance(c, str) else c
    lookup = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    code = F.try_element_at(lookup, col)
    if on_bad == "error":
        code = F.when(code.isNull() & col.isNotNull(),
                      F.raise_error(F.concat(F.lit("unknown category: "), col.cast("string"))).cast("int")
                      ).otherwise(code)
    return code


def encode_categories(df: DataFrame, spec: Mapping[str, Mapping[str, int] | int], on_bad: str = "error") -> DataFrame:
    """Replace columns by codes: a mapping → dictionary code; an int → the
    integer value minus that offset (temperatures: value − 24)."""
    out = []
    for c in df.columns:
        if c not in spec:
            out.append(F.col(c))
        elif isinstance(spec[c], int):
            v = strict_int(c)
            if on_bad == "error":
                v = F.when(v.isNull() & F.col(c).isNotNull(),
                           F.raise_error(F.concat(F.lit(f"not an integer in {c}: "), F.col(c).cast("string")))
                           .cast("int")).otherwise(v)
            out.append((v - F.lit(spec[c])).alias(c))
        else:
            out.append(code_of(c, spec[c], on_bad).alias(c))
    return df.select(*out)
