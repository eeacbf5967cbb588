r"""Merkle fixity audit of archive replicas (operator 2).

An archive is a run of records at byte offsets. The leaves of a replica's tree
are its records' digests; a node of level k covers a fixed range of offsets,
``RANGE * FANOUT^k`` bytes, and its hash is that of its children's starts and
hashes in order. The audit compares the two roots, and from level to level only
the children of ranges that differ, down to the records: changed, missing in the
replica, or extra in it. Every level is a grouping and a join over ranges;
``FANOUT`` children at most meet in a group above the lowest level.

Defined cases: null parts of a page are empty; pages of one id follow by their
record; replicas without records have no root and agree with each other; a
record that keeps its offset but changes its length is changed.

The query builds one response record per page, in the order of page_id, and a
second replica in which a fixed rule of the id (``crc32(id) mod 97`` of 5, 6, 7)
damages some records: another line end, left out, cut in half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import checkpointed, numbered, running_sum, table
from seqlab.llm.lmscore import crc32_sql

RANGE = 1 << 16
FANOUT = 16
BLOCK_ROWS = 4096
MOD, CHANGED, LEFT_OUT, CUT = 97, 5, 6, 7


def digest(record: Column) -> Column:
    return F.sha2(record.cast("binary"), 256)


def levels(size: int) -> int:
    """Levels of ranges until one covers ``size`` bytes."""
    n, span = 1, RANGE
    while span < size:
        n, span = n + 1, span * FANOUT
    return n


def tree(leaves: DataFrame, n: int) -> list[DataFrame]:
    """Levels of the tree over leaves (offset, digest), each (range, hash); the last has the root."""
    span = RANGE
    rows = leaves.select("offset", F.floor(F.col("offset") / span).cast("long").alias("range"), F.col("digest").alias("hash"))
    out = []
    for _ in range(n):
        own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "hash"))),
                                       lambda c: F.concat(c["offset"].cast("string"), F.lit(":"), c["hash"])), "\n")
        node = checkpointed(rows.groupBy("range").agg(digest(own).alias("hash")))
        out.append(node)
        rows = node.select(F.col("range").alias("offset"), F.floor(F.col("range") / FANOUT).cast("long").alias("range"), "hash")
    return out


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(offset, status, expected, found) of the records in which ``replica`` differs
    from ``primary``; both have (offset, length, digest)."""
    end = primary.select((F.col("offset") + F.col("length")).alias("e")).union(
        replica.select(F.col("offset") + F.col("length"))).agg(F.max("e")).first()[0] or 0
    n = levels(end)
    a, b = tree(primary, n), tree(replica, n)
    wrong = _differ(a[-1], b[-1], "range", "hash").select("range")
    for x, y in zip(a[-2::-1], b[-2::-1]):
        parent = F.floor(F.col("range") / FANOUT).cast("long")
        wrong = _differ(_below(x, wrong, parent), _below(y, wrong, parent), "range", "hash").select("range")
        wrong = checkpointed(wrong)
    parent = F.floor(F.col("offset") / RANGE).cast("long")
    rows = _differ(_below(primary, wrong, parent), _below(replica, wrong, parent), "offset", "digest")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return rows.select("offset", status.alias("status"), "expected", "found")


def _below(nodes: DataFrame, wrong: DataFrame, parent: Column) -> DataFrame:
    """The children of ranges that differ."""
    return nodes.join(wrong.withColumnRenamed("range", "_up"), parent == F.col("_up"), "left_semi")


def _differ(x: DataFrame, y: DataFrame, key: str, value: str) -> DataFrame:
    x = x.select(key, F.col(value).alias("expected"))
    y = y.select(key, F.col(value).alias("found"))
    return x.join(y, key, "full").filter(~F.col("expected").eqNullSafe(F.col("found")))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, length, digest, replica_length, replica_digest): each page's
    archive record and what the damaged replica has in its place."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    record = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
                      F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    p = pages.select("page_id", record.alias("r"))
    rule = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(MOD))
    half = (F.length("r") / 2).cast("int")
    other = (F.when(rule == CHANGED, F.concat(F.substring(F.col("r"), F.lit(1), F.length("r") - 2), F.lit("\n\n")))
             .when(rule == CUT, F.substring(F.col("r"), F.lit(1), half)).when(rule != LEFT_OUT, F.col("r")))
    p = p.withColumn("o", other)
    return p.select("page_id", F.octet_length("r").cast("long").alias("length"), digest(F.col("r")).alias("digest"),
                    F.octet_length("o").cast("long").alias("replica_length"), digest(F.col("o")).alias("replica_digest"))


def op2_fixity_audit(spark, sf_dir):
    rows = numbered(records(table(spark, sf_dir, "pages")), F.col("page_id").asc_nulls_last(), "digest", name="_rank")
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / BLOCK_ROWS))
    rows = checkpointed(running_sum(rows, [], "_block", ["_rank"], "length", "offset"))
    primary = rows.select("offset", "length", "digest")
    replica = rows.filter("replica_digest is not null").select("offset", F.col("replica_length").alias("length"),
                                                               F.col("replica_digest").alias("digest"))
    return audit(primary, replica).join(rows.select("offset", "page_id", "length"), "offset").select(
        "page_id", "offset", "length", "status", "expected", "found")


OP2_SQL = rf"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS r,
    {crc32_sql("coalesce(CAST(page_id AS VARCHAR), '')")} % {MOD} AS rule FROM pages),
d AS (
  SELECT page_id, strlen(r) AS length, sha256(r) AS expected,
    CASE rule WHEN {CHANGED} THEN sha256(substr(r, 1, length(r) - 2) || chr(10) || chr(10))
              WHEN {LEFT_OUT} THEN NULL WHEN {CUT} THEN sha256(substr(r, 1, length(r) // 2)) ELSE sha256(r) END AS found FROM r),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY page_id NULLS LAST, expected ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM d)
SELECT page_id, "offset", CAST(length AS BIGINT) AS length, CASE WHEN found IS NULL THEN 'missing' ELSE 'changed' END AS status, expected, found
FROM o WHERE found IS DISTINCT FROM expected
"""
