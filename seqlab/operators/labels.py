"""Combined class labels, label index and label dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.functions.scan import global_rank
from seqlab.session import materialize

# Fixed values of the reference's label space (must match for equal labels):
# temperature codes 0-4 (24-28 degrees), fan speed 0-5, direction 0-2, mode 0-4;
# label = temp * 90 + speed * 15 + direction * 5 + mode.
LABEL_PARTS = ("temp", "speed", "direction", "mode")
LABEL_RADICES = (5, 6, 3, 5)
# Order of the parts in the label dictionary text: temp, mode, direction, speed.
DICTIONARY_ORDER = ("temp", "mode", "direction", "speed")


def _weights(radices: Sequence[int]) -> list[int]:
    w, acc = [], 1
    for r in reversed(radices):
        w.append(acc)
        acc *= r
    return list(reversed(w))


def combine_labels(cols: Sequence[str | Column], radices: Sequence[int] = LABEL_RADICES) -> Column:
    """Mixed-radix number of the codes: the first column is the most
    significant digit (reference: ``temp*90 + speed*15 + direction*5 + mode``)."""
    expr = None
    for c, w in zip(cols, _weights(radices)):
        term = (F.col(c) if isinstance(c, str) else c) * F.lit(w)
        expr = term if expr is None else expr + term
    return expr.cast("int")


def split_label(label: str | Column, names: Sequence[str] = LABEL_PARTS,
                radices: Sequence[int] = LABEL_RADICES) -> list[Column]:
    """Inverse of :func:`combine_labels`: one code column per part."""
    return [c.alias(n) for n, c in _digits(label, names, radices).items()]


def _digits(label, names, radices) -> dict[str, Column]:
    lab = F.col(label) if isinstance(label, str) else label
    return {name: F.pmod(F.floor(lab.cast("long") / F.lit(w)), F.lit(r)).cast("int")
            for name, w, r in zip(names, _weights(radices), radices)}


def label_index(df: DataFrame, label_col: str = "label", index_col: str = "label_index") -> DataFrame:
    """Dense 0-based index of the distinct labels, in label order. It stays a
    table (ranked by ranges, checkpointed), whatever the number of labels."""
    labels = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    return materialize(global_rank(labels, label_col, name=index_col).withColumn(index_col, F.col(index_col).cast("int")))


def index_labels(df: DataFrame, label_col: str = "label", index_col: str = "label_index",
                 index: DataFrame | None = None) -> DataFrame:
    """Attach the dense label index; Spark picks the join by the index's size.
    Rows whose label is NULL (or not in an index passed in) keep a NULL index."""
    idx = label_index(df, label_col, index_col) if index is None else index
    return df.join(idx, on=label_col, how="left")


def label_dictionary(index: DataFrame, label_col: str = "label", index_col: str = "label_index",
                     radices: Sequence[int] = LABEL_RADICES, names: Sequence[str] = LABEL_PARTS,
                     order: Sequence[str] = DICTIONARY_ORDER, braces: bool = False) -> DataFrame:
    """``index -> 'temp,mode,direction,speed'`` text of each label (the
    ``braces`` form writes ``{...}`` as in the dictionary file)."""
    parts = _digits(label_col, names, radices)
    text = F.concat_ws(",", *[parts[n].cast("string") for n in order])
    if braces:
        text = F.concat(F.lit("{"), text, F.lit("}"))
    return index.select(F.col(index_col), F.col(label_col), text.alias("label_text"))


def class_count(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Number of distinct classes (one row)."""
    return df.agg(F.countDistinct(label_col).cast("long").alias("n_classes"))
