"""Document fingerprints: bottom-k sketches of shingle hashes (operator 6).

Native: only DataFrame functions. A sketch is the sorted array of the ``K``
least 48-bit hashes of a text's distinct word shingles. Sketches merge (the
least ``K`` of two sketches' union are the sketch of the united sets), and two
of them estimate resemblance, containment and the number of distinct shingles;
while a text has at most ``K`` distinct shingles, all of this is exact.

Defined cases: null and empty texts have the empty sketch, of likeness 1 to
another empty one and 0 to any other; a text with fewer than ``SHINGLE`` words
is one shingle; very long texts only make long arrays inside their row; equal
texts have equal sketches; in the order of documents null ids come last, rows
of one id follow by their text; an only document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import numbered, table

K = 128
SHINGLE = 5
SALTS = 64
BLOCK_BITS = 10         # ids of one block of neighbours: 1024
BROADCAST_BLOCKS = 100_000  # the table of blocks is broadcast up to so many rows (4 MB), joined by a shuffle beyond


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Distinct 48-bit hashes of the k-word shingles, words lowered."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    words = F.transform(parts, lambda w: F.xxhash64(w))

    def windows(h):
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - k),
                           lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), 16))
        one = F.array(F.shiftrightunsigned(F.xxhash64(h), 16))
        none = F.array().cast("array<bigint>")
        return F.when(n >= k, F.array_distinct(many)).when(n > 0, one).otherwise(none)

    return let(words, windows)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text, shingle)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of each key's rows together. Hashes are made distinct and cut per
    salt first, so a key of any number of rows is never gathered whole."""
    one = parts.select(*keys, F.explode(column).alias("_h")).distinct()
    salted = one.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy("_h")
    least = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merge(a, b, k)
    same = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return let(both, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(same / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    top = F.element_at(a, -1).cast("double") + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (top / F.lit(float(1 << 48))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the size of
    the union, by the size of a."""
    union = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 12, "0")), "")


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Rows (doc_id, text, carried columns and ``next_``-columns of text and them)
    of each document and the next one in the order of (doc_id, text).

    Blocks of 1024 ids hold neighbours together; a block's last document finds
    its next one in a copy of the next block's first document. One shuffle of
    the texts; ``carried`` columns are computed after it.
    """
    block = F.shiftright("doc_id", BLOCK_BITS)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_block", block)
    first = d.groupBy("_block").agg(F.min("doc_id").alias("_first"))
    ranks = numbered(first, F.col("_block").asc_nulls_last(), name="_rank")
    n = ranks.count()
    before = ranks.select(F.col("_block").alias("_to"), ((F.col("_rank") + 1) % n).alias("_rank")) if n else \
        ranks.select(F.col("_block").alias("_to"), "_rank")
    heads = before.join(ranks, "_rank").select("_to", "_first")
    if n <= BROADCAST_BLOCKS:
        heads = F.broadcast(heads)
    copies = d.join(heads, F.col("doc_id").eqNullSafe(F.col("_first")))
    rows = d.withColumn("_copy", F.lit(0)).unionByName(
        copies.select("doc_id", "text", F.col("_to").alias("_block"), F.lit(1).alias("_copy")))
    rows = rows.repartition("_block").withColumns(carried)
    w = Window.partitionBy("_block").orderBy("_copy", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", *carried)})
    return rows.filter("_copy = 0").drop("_copy", "_block")


def op6_fingerprint(spark, sf_dir):
    docs = with_next(table(spark, sf_dir, "documents"), {"sketch": sketch(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_share"),
        distinct_count(F.col("sketch")).alias("distinct_shingles"))
