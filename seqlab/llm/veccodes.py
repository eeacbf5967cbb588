"""Vector code compression with Hilbert-sorted flat blocks (operator 13).

Vectors become integers and are cut into equal consecutive parts; every part
position has a codebook, trained by a fixed number of exact integer rounds.

Layout: a chunk is one row with some thousands of vectors of a partition. For
each part position its points lie along a Hilbert curve and are cut into flat
blocks of ``BLOCK_ROWS`` points, each with its min/max box and the sum of its
points. In a round a block's box gives every entry a least and a greatest
distance; entries whose least distance exceeds the smallest greatest one can be
nearest to no point of the block. If one entry is left, the block's stored sum
is added to it and no point is looked at; else a small integer kernel compares
the points with the short list. All arithmetic is exact: 64-bit integers where
no square can overflow, Python integers otherwise.

Scale: vectors are never shuffled. A round maps over the chunks and sums up
(entry, component) by a Spark aggregation; only codebooks (``entries`` times the
vector's length, a bound set by the caller) are in the driver. A vector that a
third of all rows hold makes boxes without extent, which cost one comparison.

Defined cases: rows whose vector is null or has null or non-finite components
are dropped; shorter vectors count as padded with zeros to the longest one, and
that to a multiple of the parts; null ids are last; equal ids follow in order of
their vectors; with fewer rows than entries the codebooks have fewer entries; an
empty table gives an empty result; other columns are not read; an error beyond
the long range is given as the greatest long.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.blocks import pack, rows_of, unpack
from seqlab.llm.common import checkpointed, sized, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_BYTES = 4 << 20       # of 64-bit components in a chunk
BLOCK_ROWS = 64             # points of a flat block
LIMB = 40                   # bits of the pieces in which sums beyond 64 bits are added up
LONG_MAX = (1 << 63) - 1

Books = list[list[list[int]]]       # part position, entry, component


def usable(vector: str):
    """The vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~bad


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite double."""
    return int(x) * scale if abs(x) >= 2.0 ** 60 else math.floor(x * scale)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits a component (Skilling's
    transform of axes, 2004, for all points at once). ``x`` is uint64, (points, components)."""
    x = x.copy()
    m = x.shape[1]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(m):
            hit = (x[:, i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(hit, low, swap)
            x[:, i] ^= swap
    for i in range(1, m):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        turn ^= np.where((x[:, m - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << one) | ((x[:, i] >> np.uint64(level)) & one)
    return key


def curve_order(points: np.ndarray) -> np.ndarray:
    """Order of float points along the curve; long vectors use their first 63 components."""
    m = min(points.shape[1], 63)
    bits = min(10, 63 // m)
    p = points[:, :m]
    low, high = p.min(0), p.max(0)
    span = np.where(high / 2 > low / 2, high / 2 - low / 2, 1.0)      # halves cannot overflow
    cell = np.clip((p / 2 - low / 2) / span * ((1 << bits) - 1), 0, (1 << bits) - 1).astype(np.uint64)
    return np.argsort(hilbert(cell, bits), kind="stable")


def widest(width: int) -> int:
    """Components below this bound never overflow a 64-bit squared distance of ``width`` components."""
    return min(1 << 31, math.isqrt((1 << 60) // max(1, width)))


def exact(points: np.ndarray, scale: int) -> np.ndarray:
    return np.array([[whole(x, scale) for x in row] for row in points.tolist()], object).reshape(points.shape)


def flat_blocks(vectors: DataFrame, width: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """Chunks of (vec_id, label, vector) rows: ids, labels and, for each part position, the
    points along the curve with their rows, and the blocks' boxes and sums. A chunk with
    components too large for 64-bit squares (``narrow`` false) keeps the vectors themselves."""
    m = width // parts
    most = max(1, CHUNK_BYTES // (8 * width))
    types = dict(vectors.dtypes)

    def chunk(ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        n = len(x)
        with np.errstate(over="ignore"):
            y = np.floor(x * float(scale))
        narrow = bool((np.abs(y) < widest(m)).all())
        cut = np.arange(0, n, BLOCK_ROWS)
        cols = {k: [] for k in ("rows", "points", "low", "high", "sums")}
        for p in range(parts):
            own = (y if narrow else x)[:, p * m:(p + 1) * m]
            order = curve_order(own)
            own = own[order]
            cols["rows"].append(pack(order.astype(np.int32)))
            if narrow:
                own = own.astype(np.int64)
                cols["low"].append(pack(np.minimum.reduceat(own, cut).reshape(-1)))
                cols["high"].append(pack(np.maximum.reduceat(own, cut).reshape(-1)))
                cols["sums"].append(pack(np.add.reduceat(own, cut).reshape(-1)))
            cols["points"].append(pack(own.astype(np.int32 if narrow else np.float64).reshape(-1)))
        one = pa.array([0, n], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), pa.array([narrow])]
            + [pa.array([v], pa.list_(pa.binary())) for v in cols.values()], ["ids", "labels", "narrow", *cols])

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                v = part.column("vector")
                size = np.diff(np.asarray(v.offsets)) if len(v) else np.zeros(0, np.int64)
                x = np.zeros((part.num_rows, width))
                x[np.arange(width)[None, :] < size[:, None]] = np.asarray(v.flatten())
                yield chunk(part.column("vec_id"), part.column("label"), x)

    schema = (f"ids array<{types['vec_id']}>, labels array<{types['label']}>, narrow boolean, "
              + ", ".join(f"{c} array<binary>" for c in ("rows", "points", "low", "high", "sums")))
    return vectors.mapInArrow(cut, schema)


class Part:
    """The points of one part position of a chunk, in curve order, with their blocks."""

    def __init__(self, row: dict, p: int, m: int, scale: int):
        self.rows = unpack(row["rows"][p], np.int32)
        n = len(self.rows)
        self.cut = np.arange(0, n, BLOCK_ROWS)
        self.narrow = row["narrow"]
        if self.narrow:
            self.points = unpack(row["points"][p], np.int32).reshape(n, m).astype(np.int64)
            self.low, self.high, self.sums = (unpack(row[k][p], np.int64).reshape(-1, m) for k in ("low", "high", "sums"))
        else:
            self.points = exact(unpack(row["points"][p], np.float64).reshape(n, m), scale)
            self.low, self.high, self.sums = (f.reduceat(self.points, self.cut) for f in (np.minimum, np.maximum, np.add))

    def nearest(self, book: list[list[int]], look: bool):
        """(blocks' entry or -1, points' entry, points' squared distance). Points of a block
        with one possible entry are only looked at if ``look``; their distance is 0 else."""
        n, m = self.points.shape
        kind = np.int64 if self.narrow and max(map(abs, (c for e in book for c in e)), default=0) < widest(m) else object
        book = np.array(book, kind).reshape(-1, m)
        points, low, high = (a.astype(kind) for a in (self.points, self.low, self.high))
        gap = np.maximum(np.maximum(low[:, None] - book, book - high[:, None]), 0)
        reach = np.maximum(np.abs(book - low[:, None]), np.abs(high[:, None] - book))
        short = (gap * gap).sum(2) <= (reach * reach).sum(2).min(1)[:, None]
        only = np.where(short.sum(1) == 1, short.argmax(1), -1)
        entry = np.repeat(only, np.diff(np.append(self.cut, n)))
        far = np.zeros(n, kind)
        for b in range(len(self.cut)) if look else np.flatnonzero(only < 0):
            at = slice(self.cut[b], self.cut[b] + BLOCK_ROWS)
            list_ = np.flatnonzero(short[b])
            d = points[at, None] - book[list_]
            d = (d * d).sum(2)
            pick = d.argmin(1)      # the first of equal ones is the lowest index
            entry[at] = list_[pick]
            far[at] = d[np.arange(len(pick)), pick]
        return only, entry, far


def entry_sums(chunks: DataFrame, books: Books, m: int, scale: int = SCALE) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part position, entry) to the number of its points and their sum."""
    k = len(books[0])

    def run(batches):
        for row in rows_of(batches):
            slot, limb, value = [], [], []
            for p, book in enumerate(books):
                part = Part(row, p, m, scale)
                only, entry, _ = part.nearest(book, look=False)
                sums = np.zeros((k, m + 1), object)
                sums[:, m] = np.bincount(entry, minlength=k)
                one = only >= 0
                np.add.at(sums, only[one], np.column_stack([part.sums[one], np.zeros(one.sum(), np.int64)]).astype(object))
                rest = np.repeat(~one, np.diff(np.append(part.cut, len(entry))))
                if rest.any():
                    order = np.argsort(entry[rest], kind="stable")
                    e = entry[rest][order]
                    head = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
                    sums[e[head], :m] += np.add.reduceat(part.points[rest][order], head)
                for s, total in enumerate(sums.reshape(-1).tolist()):
                    i = 0
                    while total:
                        last = -(1 << LIMB) < total < 1 << LIMB
                        slot.append(p * k * (m + 1) + s)
                        limb.append(i)
                        value.append(total if last else total & ((1 << LIMB) - 1))
                        total = 0 if last else total >> LIMB
                        i += 1
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())],
                                             ["slot", "limb", "value"])

    found = (chunks.mapInArrow(run, "slot int, limb int, value long").groupBy("slot", "limb")
             .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())    # one row a component of the codebooks
    flat = [0] * (len(books) * k * (m + 1))
    for r in found:
        flat[r["slot"]] += int(r["value"]) << (LIMB * r["limb"])
    out = {}
    for p in range(len(books)):
        for e in range(k):
            at = (p * k + e) * (m + 1)
            out[p, e] = flat[at + m], flat[at:at + m]
    return out


def train(chunks: DataFrame, books: Books, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Each round replaces every entry by the componentwise floor of its points' mean."""
    m = len(books[0][0])
    for _ in range(rounds):
        sums = entry_sums(chunks, books, m, scale)
        books = [[[c // sums[p, e][0] for c in sums[p, e][1]] if sums[p, e][0] else entry for e, entry in enumerate(book)]
                 for p, book in enumerate(books)]
    return books


def encode(chunks: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    m = len(books[0][0])
    hexes = np.array([f"{e:02x}" for e in range(max(256, len(books[0])))])
    digits = max(2, len(f"{max(0, len(books[0]) - 1):x}"))
    if digits > 2:
        hexes = np.array([f"{e:0{digits}x}" for e in range(len(books[0]))])

    def run(batches):
        for row in rows_of(batches):
            n = len(row["ids"])
            codes, error = np.zeros((n, len(books)), f"<U{digits}"), np.zeros(n, np.int64 if row["narrow"] else object)
            for p, book in enumerate(books):
                part = Part(row, p, m, scale)
                _, entry, far = part.nearest(book, look=True)
                codes[part.rows, p] = hexes[entry]
                if far.dtype == object:
                    error = error.astype(object)
                error[part.rows] += far
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], ids), pa.array(row["labels"], labels), pa.array(["".join(c) for c in codes]),
                 pa.array([min(e, LONG_MAX) for e in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [f.dataType.elementType for f in chunks.schema.fields[:2]]
    ids, labels = map(to_arrow_type, kinds)
    return chunks.mapInArrow(run, f"vec_id {kinds[0].simpleString()}, label {kinds[1].simpleString()}, code string, error long")


def books_digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, Books]:
    """Codes of all usable (vec_id, label, embedding) rows and the final codebooks."""
    kept = (rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).filter(usable("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    width = parts * max(1, -(-longest // parts))
    m = width // parts
    chunks = checkpointed(flat_blocks(kept, width, parts, scale))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()     # the codebooks' first entries
    ints = [[whole(x, scale) for x in r["vector"]] + [0] * (width - len(r["vector"])) for r in first]
    books = train(chunks, [[v[p * m:(p + 1) * m] for v in ints] for p in range(parts)], rounds, scale)
    return encode(chunks, books, scale), books


def op13_vector_codes(spark, sf_dir):
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = checkpointed(codes)
    sums = F.sum(F.col("error").cast("decimal(38,0)"))
    per = sized(checkpointed(codes.groupBy(F.col("label").alias("_label"))
                             .agg(F.least(sums, F.lit(LONG_MAX)).cast("long").alias("label_error"))))
    return (codes.join(per, F.col("label").eqNullSafe(F.col("_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    """Two rounds and the last assignment, written out; d*64+k keeps ties to the lower index."""
    steps = ""
    for i in range(ROUNDS + 1):
        steps += f""",
a{i} AS (SELECT rn, p, min(d * {ENTRIES} + k) AS dk FROM (
    SELECT pt.rn, pt.p, b.k, CAST(sum((pt.v - b.v) * (pt.v - b.v)) AS HUGEINT) AS d
    FROM pt JOIN b{i} b ON pt.p = b.p AND pt.j = b.j GROUP BY pt.rn, pt.p, b.k) GROUP BY rn, p)"""
        if i < ROUNDS:
            steps += f""",
s{i} AS (SELECT pt.p, CAST(a.dk % {ENTRIES} AS BIGINT) AS k, pt.j, CAST(sum(pt.v) AS HUGEINT) AS s, count(*) AS n
         FROM pt JOIN a{i} a ON pt.rn = a.rn AND pt.p = a.p GROUP BY ALL),
b{i + 1} AS (SELECT b.p, b.k, b.j, CASE WHEN s.n IS NULL THEN b.v
             ELSE CAST((s.s - ((s.s % s.n) + s.n) % s.n) // s.n AS BIGINT) END AS v
         FROM b{i} b LEFT JOIN s{i} s ON b.p = s.p AND b.k = s.k AND b.j = s.j)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn,
         CAST(len(embedding) // {PARTS} AS BIGINT) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS (
  SELECT rn, i // w AS p, i % w AS j, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT rn, w, unnest(e) AS x, unnest(range(len(e))) AS i FROM kept)),
b0 AS (SELECT p, rn - 1 AS k, j, v FROM pt WHERE rn <= {ENTRIES}){steps},
code AS (SELECT rn, string_agg(printf('%02x', CAST(dk % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code,
                CAST(sum(dk // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rn),
sha AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, j)) AS h FROM b{ROUNDS})
SELECT kept.vec_id, code.code, code.error,
       CAST(sum(code.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, sha.h AS codebooks_sha256
FROM kept JOIN code USING (rn), sha
"""


OP13_SQL = _sql()
