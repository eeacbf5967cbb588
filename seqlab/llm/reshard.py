"""Resharding with the fewest bytes moved (operator 11).

Shards are folders ``shard=K`` of Parquet files. From the old shards' sizes and
the new capacities a minimum-cost flow gives the transfers: bytes that stay in
the shard of the same number cost nothing, bytes that go to another one cost 1
each. The flow runs over shards, not rows: old shards, one relay that stands for
"any other shard", new shards, so there are a few arcs a shard whatever the
data. A shard's rows, in the order of its files, are then one line of bytes cut
at the flow's amounts: the first piece stays, each further piece goes to one
shard. A document goes where its middle lies, so a cut is off by at most half
a document.

Files that lie whole in the staying piece are not touched; the manifest goes
on naming them. Only the other ones are read, and their rows written to the new
shards. A row's place in its shard (``slot``) is its file's first slot plus the
row's index in the file, so nothing is sorted or windowed over a shard.

Scale: one row a file (path, rows, bytes) is summed up over the files of a
shard; the driver holds one number a shard and the paths of affected files,
which Spark's own listing holds too. Running sums over rows are taken inside
files only. A heavy old shard has more files, no larger ones.

Defined cases: a null text has no bytes and the checksum of the empty text; a
null id counts as the text ''; repeated rows are rows of their own; an empty
table has no files, empty shards and an empty result; a shard without rows is no
folder; further columns travel in one struct, so their names clash with nothing;
capacities below the total raise ``ValueError``.
"""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from seqlab.llm.common import checkpointed, shuffle_partitions, sized, table
from seqlab.session import scratch_path

OLD_SHARDS, NEW_SHARDS = 12, 16
FILE_BYTES = 128 << 20      # of texts in a file of the query's old layout


# ---------------------------------------------------------------- the flow

class Network:
    """Arcs (to, capacity left, cost) in pairs: arc i and its reverse i ^ 1."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for x, y, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def _distances(self, source: int) -> list[float]:
        dist = [float("inf")] * len(self.out)
        dist[source] = 0
        queue, waiting = deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for i in self.out[a]:
                b = self.to[i]
                if self.left[i] and dist[a] + self.cost[i] < dist[b]:
                    dist[b] = dist[a] + self.cost[i]
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        return dist

    def min_cost_flow(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost) of a greatest flow of least cost. All shortest paths of one
        price are filled before the next price is looked for."""
        flow = cost = 0
        while True:
            dist = self._distances(source)
            if dist[sink] == float("inf"):
                return flow, cost
            at = [0] * len(self.out)
            while sent := self._push(source, sink, dist, at):
                flow += sent
                cost += sent * int(dist[sink])

    def _push(self, source: int, sink: int, dist: list, at: list[int]) -> int:
        """Sends flow along one path of arcs on shortest paths; ``at`` remembers exhausted arcs."""
        path, on, a = [], {source}, source
        while a != sink:
            while at[a] < len(self.out[a]):
                i = self.out[a][at[a]]
                b = self.to[i]
                if self.left[i] and b not in on and dist[b] == dist[a] + self.cost[i]:
                    path.append(i)
                    on.add(b)
                    a = b
                    break
                at[a] += 1
            else:
                if not path:
                    return 0
                on.discard(a)
                a = self.to[path.pop() ^ 1]
                at[a] += 1
        sent = min(self.left[i] for i in path)
        for i in path:
            self.left[i] -= sent
            self.left[i ^ 1] += sent
        return sent


def transfers(old: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes), the staying bytes of a shard first, that move the
    fewest bytes; new shards are numbered from 0 in the order of ``capacity``."""
    if sum(capacity) < sum(old.values()):
        raise ValueError(f"capacities of {sum(capacity)} bytes cannot hold {sum(old.values())}")
    shards = sorted(old)
    source, sink, relay = 0, 1, 2
    o = {s: 3 + i for i, s in enumerate(shards)}
    n = [3 + len(shards) + t for t in range(len(capacity))]
    net = Network(3 + len(shards) + len(capacity))
    stay, leave = {}, {}
    for s in shards:
        net.arc(source, o[s], old[s])
        if s < len(capacity):
            stay[s] = net.arc(o[s], n[s], old[s])
        leave[s] = net.arc(o[s], relay, old[s], 1)
    enter = [net.arc(relay, n[t], capacity[t]) for t in range(len(capacity))]
    for t, room in enumerate(capacity):
        net.arc(n[t], sink, room)
    net.min_cost_flow(source, sink)

    def sent(arc):
        return net.left[arc ^ 1]

    room = deque((t, sent(a)) for t, a in enumerate(enter) if sent(a))
    out = []
    for s in shards:
        if s in stay and sent(stay[s]):
            out.append((s, s, sent(stay[s])))
        rest = sent(leave[s])
        while rest:
            t, free = room.popleft()
            part = min(rest, free)
            out.append((s, t, part))
            rest -= part
            if free > part:
                room.appendleft((t, free - part))
    return out


# ---------------------------------------------------------------- shard files

@dataclass
class Layout:
    """The shard files that count. A shard reads them by generation and part."""
    rows: DataFrame     # row, size, text_crc32, path, index: rows of these and maybe further files
    files: DataFrame    # path, shard, generation, part, n, bytes


def with_sizes(rows: DataFrame, text: str = "text") -> DataFrame:
    """(row, size, text_crc32): all columns in one struct, UTF-8 bytes plus 1, checksum of the bytes."""
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                       (F.octet_length(utf8) + F.lit(1)).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))


def write_shards(rows: DataFrame, shard, order: list, path: str, files: int) -> None:
    """Writes rows of ``with_sizes`` as shards in about ``files`` files, which follow each
    other in the order of their part numbers. Rows alike in all of ``order`` may still be
    dealt to several files."""
    keys = ["shard", *order, F.monotonically_increasing_id()]
    (rows.withColumn("shard", shard).repartitionByRange(files, *keys).sortWithinPartitions(*keys)
     .select("row", "size", "text_crc32", "shard").write.partitionBy("shard").parquet(path))


def read_files(spark: SparkSession, row: StructType, *paths: str) -> DataFrame:
    """Rows of shard files (or of all files below a folder) with their file and place in it."""
    schema = StructType([StructField("row", row), StructField("size", LongType()), StructField("text_crc32", LongType())])
    return (spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
            .select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("index")))


def layout(rows: DataFrame, generation: int = 0) -> Layout:
    files = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return Layout(rows, checkpointed(files.select(
        "path", F.regexp_extract("path", r"shard=(\d+)/[^/]*$", 1).cast("int").alias("shard"),
        F.lit(generation).alias("generation"), F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("part"),
        "n", "bytes")))


def _before(value: str):
    """Sum of ``value`` over the earlier files of the shard; a window over one row a file."""
    over = Window.partitionBy("shard").orderBy("generation", "part", "path").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(over), F.lit(0))


def slots(lay: Layout) -> DataFrame:
    """Rows of the layout's files with ``shard`` and ``slot``, the place in the shard from 0."""
    first = sized(checkpointed(lay.files.select("path", "shard", _before("n").alias("first"))))
    return lay.rows.join(first, "path").withColumn("slot", F.col("first") + F.col("index")).drop("first", "path", "index")


# ---------------------------------------------------------------- the move

def reshard(old: Layout, capacity: list[int], path: str, file_bytes: int = FILE_BYTES) -> Layout:
    """Moves the fewest bytes so that shard t holds about ``capacity[t]`` of them: rewrites
    the affected files below ``path`` and returns the layout of kept and new files."""
    spark = old.rows.sparkSession
    row = old.rows.schema["row"].dataType
    sizes = {r["shard"]: r["s"] for r in old.files.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()}
    pieces, at = [], {}
    for s, t, n in transfers(sizes, capacity):
        lo = at.get(s, 0)
        at[s] = lo + n
        pieces.append((s, t, lo, lo + n))
    piece = F.broadcast(spark.createDataFrame(pieces, "shard int, to int, lo long, hi long"))     # a few rows a shard
    files = old.files.withColumn("start", _before("bytes"))
    inside = (F.col("start") >= F.col("lo")) & (F.col("start") + F.col("bytes") <= F.col("hi"))
    files = checkpointed(files.join(piece.withColumnRenamed("shard", "_s"), (F.col("shard") == F.col("_s")) & inside, "left")
                         .drop("_s", "lo", "hi"))
    kept = files.filter("to = shard").select(old.files.columns)
    cut = files.filter("to is null").select("path", "shard", "start")
    cut_paths = [r["path"] for r in cut.select("path").collect()]       # at most one file a cut
    moves = files.filter("to <> shard").select("path", "shard", "start", "to", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    if cut_paths:
        before = Window.partitionBy("path").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
        rows = (read_files(spark, row, *cut_paths).select("path", "index", "size").join(F.broadcast(cut), "path")
                .withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0))))
        middle = 2 * F.col("start") + F.col("size")
        there = (F.col("shard") == F.col("_s")) & (middle >= 2 * F.col("lo")) & (middle < 2 * F.col("hi"))
        moves = moves.union(rows.join(piece.withColumnRenamed("shard", "_s"), there).groupBy("path", "shard", "to")
                            .agg(F.min("start"), F.min("index"), F.max("index") + 1).select("path", "shard", "min(start)", "to", "min(index)", "(max(index) + 1)"))
    moves = checkpointed(moves)
    paths = [r["path"] for r in moves.select("path").distinct().collect()]      # the affected files
    if not paths:
        return Layout(old.rows, kept)
    moved = moves.join(old.files.select("path", "bytes"), "path").agg(F.sum("bytes")).first()[0]
    m = sized(moves.select(F.col("path").alias("_path"), F.col("shard").alias("_from"), F.col("start").alias("_start"), "to", "lo", "hi"))
    rows = read_files(spark, row, *paths).join(
        m, (F.col("path") == F.col("_path")) & (F.col("index") >= F.col("lo")) & (F.col("index") < F.col("hi")))
    write_shards(rows, F.col("to"), [F.col("_from") != F.col("to"), "_from", "_start", "index"], path,
                 max(shuffle_partitions(spark), -(-moved // file_bytes)))
    new = layout(read_files(spark, row, path), 1)
    return Layout(old.rows.union(new.rows), kept.union(new.files))


def even(total: int, shards: int) -> list[int]:
    return [total * (t + 1) // shards - total * t // shards for t in range(shards)]


def resharded(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """(row, size, text_crc32, shard, slot) after documents dealt to ``old_shards`` by a hash
    of their id, longest first, move to ``new_shards`` of equal bytes. Cuts then fall on short documents."""
    spark = docs.sparkSession
    base = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    rows = with_sizes(docs)
    shard = F.pmod(F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(old_shards)).cast("int")
    total = rows.agg(F.sum("size")).first()[0] or 0
    write_shards(rows, shard, [F.col("size").desc(), F.col("row.doc_id").asc_nulls_last(), "text_crc32"], f"{base}/old",
                 max(shuffle_partitions(spark), -(-total // FILE_BYTES)))
    old = layout(read_files(spark, rows.schema["row"].dataType, f"{base}/old"))
    return slots(reshard(old, even(total, new_shards), f"{base}/new"))


def op11_reshard(spark, sf_dir):
    rows = resharded(table(spark, sf_dir, "documents"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> str:
    """DuckDB list of the CRC-32 of the 16 half bytes (reflected polynomial)."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (c & 1) * 3988292384
        out.append(f"{c}::BIGINT")
    return f"[{', '.join(out)}]"


def _crc_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, half a byte at a time."""
    def half(v: str) -> str:
        return f"xor({v} >> 4, {_crc_table()}[({v} & 15) + 1])"
    digit = "instr('123456789ABCDEF', p[{}])"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            f"lambda p: {digit.format(1)} * 16 + {digit.format(2)})), lambda a, x: {half(half('xor(a, x)'))}), 4294967295)")


# Bytes that stay are the smaller of a shard's size and capacity; what is over is dealt in
# order to the shards that have room: the least that any transfers can move.
OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc_sql("coalesce(text, '')")} AS crc,
         CAST({_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % {OLD_SHARDS} AS INTEGER) AS old FROM documents),
p AS (SELECT *, 2 * coalesce(sum(size) OVER (PARTITION BY old ORDER BY size DESC, doc_id NULLS LAST, crc
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS middle2 FROM d),
total AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS b FROM d),
s AS (
  SELECT t, coalesce(o.b, 0) AS has, CASE WHEN t < {NEW_SHARDS} THEN total.b * (t + 1) // {NEW_SHARDS} - total.b * t // {NEW_SHARDS} ELSE 0 END AS cap
  FROM range({max(OLD_SHARDS, NEW_SHARDS)}) r(t) LEFT JOIN (SELECT old, sum(size) AS b FROM d GROUP BY old) o ON o.old = r.t, total),
g AS (
  SELECT t, least(has, cap) AS stay, has - least(has, cap) AS over, cap - least(has, cap) AS room,
         coalesce(sum(has - least(has, cap)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over0,
         coalesce(sum(cap - least(has, cap)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room0 FROM s),
m AS (
  SELECT p.*, CASE WHEN middle2 < 2 * g.stay THEN old ELSE (
           SELECT n.t FROM g n WHERE middle2 - 2 * g.stay + 2 * g.over0 >= 2 * n.room0
             AND middle2 - 2 * g.stay + 2 * g.over0 < 2 * (n.room0 + n.room)) END AS shard
  FROM p JOIN g ON g.t = p.old)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY old <> shard, old, middle2) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM m
"""
