"""Helpers shared by the operators of this folder: tables, word hashing over
Arrow buffers, block tables with request/reply messages, components."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``: cuts the
    lineage, survives lost executors, and is removed with the DataFrame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Actions inside remove their shuffle files when they end (a setting of the
    session, put back afterwards): for checkpoints, which are what later steps read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it if a column has it already."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def in_fold(id_col, mod: int, fold: int):
    """crc32(id as text) mod ``mod`` is ``fold``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == fold


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds the 0-based position in the global order. Range-partitioned: each
    task numbers its own range, and one row per range carries the offsets."""
    low = (1 << 33) - 1
    own = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (own.withColumn("_part", part).join(offsets, "_part")
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(low)))
            .drop("_part", "_before", "_at"))


def running_sum(df: DataFrame, keys: list[str], block: str, order: list, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of a key (without the row itself).

    ``block`` is a column that grows with the order and splits each key into
    bounded pieces, so a hot key is never sorted in one task: blocks are summed
    first, the few block sums are accumulated per key, rows only within a block.
    A null block is a piece of its own, before all others.
    """
    sums = df.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col(block).asc_nulls_first())
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)),
                                                    F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate([*keys, block])], "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate([*keys, block])]
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (rows.join(offsets, on).withColumn(name, F.col("_before") + F.col("_in"))
            .drop("_before", "_in", *[f"_o{i}" for i in range(len(keys) + 1)]))


# ---------------------------------------------------------------- words in numpy

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i mod 2^64 for i < n (B is odd, so it has an inverse)."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", np.uint64(pow(int(_B), -1, 1 << 64)))):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step on uint64 (fixed public constants of a 64-bit finalizer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    at, data = arr.buffers()[1:3]
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Documents and blocks of them are long rows: Spark's default Arrow batch of
    64 MB is held outside the heap, by each task and its Python worker. Left alone
    if the session sets it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(ARROW_BYTES))


def tidy() -> None:
    """Gives freed memory back to the system; an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Row slices of a batch with about ``most`` bytes of text each (one row at least)."""
    raw, offs = text_bytes(batch.column(column))
    del raw
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    tidy()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """g[i] = sum of (byte + 1) * B^j over j < i, mod 2^64."""
    up, _ = powers(len(data) + 1)
    g = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=g[1:])
    return g


WORDS_AT_ONCE = 1 << 19     # bytes whose words are hashed at once


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lowered) and the word offset of every row. Rows
    are taken a few hundred KB at a time, so that the arrays over bytes stay small."""
    hashes, at, i = [], [np.zeros(1, np.int64)], 0
    while i + 1 < len(offs):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + WORDS_AT_ONCE, "right")) - 1)
        h, own = _words(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        hashes.append(h)
        at.append(own[1:] + at[-1][-1])
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(at)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    at = np.zeros(len(offs), np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), at
    low = _LOW[data]
    ok = ~_SPACE[low]
    row = offs[:-1][offs[:-1] < n]
    begins = ok.copy()
    begins[1:] &= ~ok[:-1]
    begins[row] = ok[row]
    ends = ok.copy()
    ends[:-1] &= ~ok[1:]
    last = row[row > 0] - 1
    ends[last] = ok[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    g = prefix_hash(low)
    _, down = powers(n + 1)
    h = mix((g[end] - g[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(start, offs)


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence hashed by ``a`` followed by the item hashed by ``b``."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of every row and their row offsets; a row
    with fewer (but some) words gives its whole sequence as one."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(off[-1], np.uint64)
    full = np.flatnonzero(n >= k)
    if len(full):
        first = np.repeat(at[:-1][full] - off[:-1][full], count[full])
        slot = np.concatenate([np.arange(off[i], off[i + 1]) for i in full]) if len(full) < 64 else \
            np.flatnonzero(np.repeat(n >= k, count))
        pos = first + slot
        s = np.full(len(pos), np.uint64(k), np.uint64)
        for j in range(k):
            s = chain(s, h[pos + j])
        out[slot] = s
    for i in np.flatnonzero((n > 0) & (n < k)):
        s = np.full(1, np.uint64(n[i]), np.uint64)
        for j in range(at[i], at[i + 1]):
            s = chain(s, h[j:j + 1])
        out[off[i]] = s[0]
    return out, off


# ---------------------------------------------------------------- components

EDGES_A_PART = 50_000
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """A checkpointed table of a few numbers a row, broadcast in joins if it has
    at most ``BROADCAST_ROWS`` rows (about 40 MB); Spark shuffles a larger one."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge list; comp is the least node that
    can be reached. Alternating star contraction: each round hangs a node's
    larger and smaller neighbours on its least one, so no pairs inside a
    component are made and chains shrink geometrically. Every round is
    checkpointed, in as many partitions as its edges need; only their number
    and a checksum come to the driver.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                     .filter("u <> v").distinct())
    digest, n = None, e.count()
    while n:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .filter("u <> v"))
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                           F.col("m").alias("v")).filter("u <> v").distinct())
        e = checkpointed(small.coalesce(max(1, -(-n // EDGES_A_PART))))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if digest == now:
            break
        digest, n = now, now[0]
    return (e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())
