"""Word counts and substring filters over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: str | Column) -> Column:
    """Words of a text as a line-by-line ``split(' ')``: every line split on
    single spaces, so runs of spaces and empty lines give empty words.
    Splitting lines and then spaces equals one split on either character."""
    t = F.col(text) if isinstance(text, str) else text
    return F.split(t, "[ \n]", -1)


def word_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` over all texts; the aggregation combines map-side, so a
    very common word costs one partial count per task."""
    return (df.select(F.explode(words(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def contains_count(text_col: str, needle: str) -> Column:
    """Number of texts containing ``needle`` (an aggregate expression)."""
    return F.count_if(F.col(text_col).contains(needle))
