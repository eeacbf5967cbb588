"""Mixing sources to target weights by weighted fair queueing (operator 10).

Every document is a packet of its source's queue; the queue order is a
pseudo-random shuffle that depends on the document id alone, so reruns agree.
A packet's virtual finish time is the source's words up to its end divided by
the source's target. Served in the order of finish times, all sources drain in
proportion to their targets; the mix is cut where the total budget ends. The
document a source is serving at the cut is taken in part, so a source's taken
words equal its target, rounded to a word.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, last in order; a null id shuffles as the text ''; equal ids
follow in order of size; an empty table gives an empty mix; further columns of
the documents, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import WORD, checkpointed, free_name, numbered, running_sum, table

WEIGHTS = (3, 1, 2)     # by source in code-point order, repeating
SHARE = 1.5             # total budget as a share of all words
MOST_REPEATS = 2        # a source's target stops at so many times its size
BLOCK_ROWS = 4096       # rows of a hash block in which a running sum is taken


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, source_docs, target) from rows (source, size).

    Targets are in proportion to the weights and sum up to ``share`` of all
    words; what exceeds ``most`` times a source's size is shared again by weight
    until no target does. The shared level is one number; each round is one
    aggregation over the table of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    ranked = numbered(per, F.col("source").asc_nulls_last(), name="_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    whole = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    budget = share * float(whole[0] or 0)
    level, capped = (budget / whole[1] if whole[1] else 0.0), 0
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_w")
        n, held, rest = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_cap"))),
                                   F.sum(F.when(~over, F.col("_w")))).first()
        if n == capped or not rest:
            break
        level, capped = (budget - held) / rest, n
    return ranked.select("source", "source_size", "source_docs",
                         F.least("_cap", F.lit(level) * F.col("_w")).alias("target"))


def fair_queue(docs: DataFrame, targets: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """One row per copy the mix takes: (doc_id, source, size, copy, words,
    mix_start), ``mix_start`` being the mix's words before it.

    ``docs`` has (doc_id, source, size), ``targets`` what ``source_targets`` gives.
    """
    return _served(_queued(docs, targets), most)


def _queued(docs: DataFrame, targets: DataFrame) -> DataFrame:
    n = targets.agg(F.sum("source_docs")).first()[0] or 0
    digits = 0
    while n > BLOCK_ROWS * 16 ** digits:
        digits += 1
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    q = docs.select("doc_id", "source", "size").withColumn("_h", h).withColumn("_block", F.substring("_h", 1, digits))
    q = running_sum(q, ["source"], "_block", ["_h", "size"], "size", "_start")
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    # the table of targets has a row per source; Spark picks the join by its size
    return q.join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_block")


def _words(start):
    """Words served of a packet that starts at ``start`` of its source's queue."""
    quota = F.floor(F.col("target") + F.lit(0.5))
    return F.greatest(F.lit(0), F.least(F.col("size"), quota - start))


def _served(queued: DataFrame, most: int) -> DataFrame:
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(most))))
    start = F.col("_start") + (F.col("copy") - 1) * F.col("source_size")
    copies = copies.withColumn("words", _words(start)).filter("words > 0")
    finish = (start + F.col("words")).cast("double") / F.col("target")
    copies = copies.withColumn("_finish", finish)
    n = queued.agg(F.count(F.lit(1))).first()[0]
    pieces = max(1, -(-n // BLOCK_ROWS) * 2)
    copies = copies.withColumn("_piece", F.floor(F.col("_finish") * pieces))
    order = ["_finish", F.col("source").asc_nulls_last(), "_h", "size", "copy"]
    out = running_sum(copies, [], "_piece", order, "words", "mix_start")
    return out.select("doc_id", "source", "size", "copy", "words", "mix_start")


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, the words taken and
    where its first copy starts in the mix (null if it is not taken)."""
    sizes = checkpointed(with_sizes(docs))
    targets = checkpointed(source_targets(sizes))
    queued = _queued(sizes, targets)
    copies = _served(queued, MOST_REPEATS)
    # equal rows are told apart by their order, so that each keeps its own copies
    first = copies.groupBy("doc_id", "source", "size").agg(F.min("mix_start").alias("mix_start"))
    taken = sum((_words(F.col("_start") + i * F.col("source_size")) for i in range(MOST_REPEATS)), F.lit(0))
    out = queued.withColumn("taken", taken)
    f = first.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "mix_start")
    on = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("source").eqNullSafe(F.col("_s")), F.col("size") == F.col("_z")]
    return out.join(f, on, "left").select(
        "doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "mix_start")


def op10_mix_sources(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))


def stage_mix(spark, docs, sf_dir):
    """Pipeline stage: one row per copy taken, in the columns of the documents
    plus ``copy``, ``mix_start`` and ``mix_words`` (underscores follow where the
    documents have such a column); the document being served at the cut is
    truncated after ``mix_words`` words."""
    cols = docs.columns
    sizes = checkpointed(with_sizes(docs))
    targets = checkpointed(source_targets(sizes))
    new = {c: free_name(c, cols) for c in ("copy", "mix_start", "mix_words")}

    own_key, own_words, own_row = (free_name(c, cols) for c in ("_key", "_words", "_row"))
    key, nth_copy = (free_name(c, [*cols, own_key, own_words, own_row]) for c in ("_of", "_nth"))

    def text_key(size):
        return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), size.cast("string"),
                        F.lit("/"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))

    # rows alike in id, source and size are told apart by their order, here as in the queue
    nth = Window.partitionBy(key, "copy").orderBy("mix_start")
    copies = fair_queue(sizes, targets).withColumn(key, text_key(F.col("size"))).withColumn(nth_copy, F.row_number().over(nth))
    copies = copies.select(key, nth_copy, *[F.col(c).alias(new[n]) for c, n in (
        ("copy", "copy"), ("mix_start", "mix_start"), ("words", "mix_words"))])
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    own = docs.withColumn(own_words, words).withColumn(own_key, text_key(F.col(own_words))).withColumn(
        own_row, F.row_number().over(Window.partitionBy(own_key).orderBy(F.xxhash64("text"))))
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(new["mix_words"]).cast("int")), "")
    # the difference keeps the row number out of the join's keys: one shuffle serves window and join
    return (own.join(copies, (F.col(own_key) == F.col(key)) & (F.col(own_row) - F.col(nth_copy) == 0))
            .withColumn("text", F.when(F.col(new["mix_words"]) >= F.col(own_words), F.col("text")).otherwise(cut))
            .select(*[f"`{c}`" for c in cols], *[new[c] for c in ("copy", "mix_start", "mix_words")]))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w
  FROM d GROUP BY source),
total AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
levels AS (
  SELECT 0 AS step, (SELECT budget FROM total) / (SELECT sum(w) FROM s) AS lev, CAST(0 AS BIGINT) AS capped, true AS more
  UNION ALL
  SELECT step + 1, CASE WHEN x.n = capped OR x.rest IS NULL THEN lev ELSE ((SELECT budget FROM total) - x.held) / x.rest END,
         x.n, x.n <> capped AND x.rest IS NOT NULL
  FROM levels, LATERAL (SELECT count(*) FILTER (2.0::DOUBLE * source_size < lev * w) AS n,
                               sum(2.0::DOUBLE * source_size) FILTER (2.0::DOUBLE * source_size < lev * w) AS held,
                               sum(w) FILTER (NOT 2.0::DOUBLE * source_size < lev * w) AS rest FROM s) x
  WHERE more),
lev AS (SELECT max_by(lev, step) AS lev FROM levels),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, lev.lev * w) AS target FROM s, lev),
q AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.*, copy, greatest(0, least(size, quota - (start + (copy - 1) * source_size))) AS words
  FROM q, (VALUES (1), (2)) v(copy)),
m AS (
  SELECT *, CAST(coalesce(sum(words) OVER (
    ORDER BY CAST(start + (copy - 1) * source_size + words AS DOUBLE) / target, source NULLS LAST, h, size, copy
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mix_start FROM c WHERE words > 0)
SELECT q.doc_id, q.size, q.source_size, q.target,
       CAST(greatest(0, least(q.size, quota - start)) + greatest(0, least(q.size, quota - (start + q.source_size))) AS BIGINT) AS taken,
       f.mix_start
FROM q LEFT JOIN (SELECT doc_id, source, size, min(mix_start) AS mix_start FROM m GROUP BY ALL) f
  ON q.doc_id IS NOT DISTINCT FROM f.doc_id AND q.source IS NOT DISTINCT FROM f.source AND q.size = f.size
"""
