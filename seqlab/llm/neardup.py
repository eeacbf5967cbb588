"""Near-duplicate documents by HyperMinHash (operator 8).

A document's set are the distinct hashes of its word shingles (64 bits, of words
with A-Z lowered; fewer words than the shingle: the whole sequence as one).

Sketch: ``REGISTERS`` buckets, each with a hash function of its own, so that
also a set of few shingles fills all of them; a bucket keeps its least hash as
6 bits of leading zeros and ``MANTISSA`` bits after the leading one. Bands of
``ROWS`` registers are bucketed. A pair of likeness 0.8 shares no band with a
chance of (1 - 0.8^5)^40 < 2e-7.

Links, without making the pairs of a bucket:

1. Equal sets are one class from the start, kept by their least id.
2. In every band bucket each member is paired with the bucket's least member.
   The share of equal registers, corrected by the chance that different minima
   fall on one register, estimates the likeness; estimates below ``ESTIMATE``
   (6 standard errors under 0.8) are let go. Each class first verifies its best
   such pair on the full sets, then the pairs that these links do not join.
3. Buckets whose other members still fall into several components are grouped
   into families. A family's largest component needs no further look inside;
   each member outside it is compared, on full sets and by an inverted index,
   with all members of the family, in blocks of bounded size. So every pair that
   shares a band is decided, but work grows only with what stays undecided.

Defined cases: a document without words (or null text) has the empty set and is
linked with nothing; rows of one id are one document; rows with a null id are
linked with nothing, have a null component and are kept; ties cannot arise, as
the least id decides; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import chain, checkpointed, components, free_name, mix, shingles, sized, slices, small_batches, table, text_bytes, words

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
PERCENT = 80
ESTIMATE = PERCENT / 100 - 6 * math.sqrt(0.16 / REGISTERS)
FAMILY_BLOCK = 2000     # members of a family compared in one task

_SIG = "doc_id long, n_shingles long, d1 long, d2 long, regs binary"


def shingle_sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and row offsets."""
    h, at = words(*text_bytes(part.column("text")))
    s, off = shingles(h, at, k)
    sets = [np.unique(s[a:b]) for a, b in zip(off[:-1], off[1:])]
    n = np.array([len(x) for x in sets], np.int64)
    return (np.concatenate(sets) if sets else s), np.concatenate(([0], np.cumsum(n))).astype(np.int64)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a | np.uint64(1), mix(a)


def registers(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Compressed registers (rows, REGISTERS) as uint16; rows of empty sets are 0."""
    n = np.diff(off)
    full = np.flatnonzero(n > 0)
    out = np.zeros((len(n), REGISTERS), np.uint16)
    if not len(full):
        return out
    a, b = _functions(REGISTERS)
    least = np.empty((REGISTERS, len(full)), np.uint64)
    starts = off[:-1][full]
    v = np.empty(len(s), np.uint64)
    for j in range(REGISTERS):
        np.add(s, b[j], out=v)
        np.multiply(v, a[j], out=v)
        np.minimum.reduceat(v, starts, out=least[j])
    out[full] = compress(least).T
    return out


def compress(v: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the MANTISSA bits after the leading one."""
    v = np.maximum(v, np.uint64(1))
    top = np.floor(np.log2(v.astype(np.float64))).astype(np.int64)
    top = np.where((v >> top.astype(np.uint64)) == 0, top - 1, top)     # rounded up in float64
    after = v << (np.uint64(63) - top.astype(np.uint64)) << np.uint64(1)
    return ((63 - top).astype(np.uint16) << np.uint16(MANTISSA)) | (after >> np.uint64(64 - MANTISSA)).astype(np.uint16)


@lru_cache(maxsize=4096)
def _by_chance(i: int, j: int) -> float:
    """Chance that the minima of two disjoint sets of 2^i and 2^j hashes fall on one register."""
    lead = np.arange(64)[:, None]
    low = 2.0 ** -(lead + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0 ** -(lead + 1 + MANTISSA)
    cells = [np.exp(2.0 ** e * np.log1p(-low)) - np.exp(2.0 ** e * np.log1p(-np.minimum(high, 1 - 1e-16))) for e in (i, j)]
    return float((cells[0] * cells[1]).sum())


def estimate(x: bytes, y: bytes, n: int, m: int) -> float:
    """Collision-corrected likeness of two sketches of sets of n and m hashes."""
    same = float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean())
    c = _by_chance(round(math.log2(max(1, n))), round(math.log2(max(1, m))))
    return max(0.0, (same - c) / (1 - c))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, regs): sketch and 128-bit digest of each set."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s, off = shingle_sets(part, k)
                regs = registers(s, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(off)), *map(pa.array, digests(s, off)),
                     pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "regs"])

    return docs.select("doc_id", "text").mapInArrow(sign, _SIG)


def _bands(classes: DataFrame) -> DataFrame:
    def hashes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), regs.shape[:2])
            for r in range(ROWS):
                h = chain(h, regs[:, :, r].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS)), pa.array(h.reshape(-1).view(np.int64))],
                ["rep", "bucket"])

    return classes.select("rep", "regs").mapInArrow(hashes, "rep long, bucket long")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set, best) of the documents in ``ids`` (id, d1, d2, best); of an id's
    texts, the one with the digest d1, d2."""

    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s, off = shingle_sets(part, k)
                d1, d2 = digests(s, off)
                fit = pa.array((d1 == part.column("d1").to_numpy()) & (d2 == part.column("d2").to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(s.view(np.int64))),
                     part.column("best")], ["id", "set", "best"]).filter(fit)

    wanted = docs.select("doc_id", "text").join(sized(ids).withColumnRenamed("id", "doc_id"), "doc_id")
    return wanted.mapInArrow(sets, "id long, set array<long>, best long")


def digests(s: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set, in any order of its hashes."""
    zero = np.zeros(1, np.uint64)
    sums = [np.concatenate((zero, np.cumsum(mix(s ^ np.uint64(c)), dtype=np.uint64))) for c in (0x51, 0xA7)]
    return [(c[off[1:]] - c[off[:-1]]).view(np.int64) for c in sums]


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) whose full sets are alike enough."""
    same = F.size(F.array_intersect("sa", "sb"))
    near = 100 * F.col("same") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("same"))
    return pairs.withColumn("same", same).filter(near).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The checkpointed pairs (a, b) whose full sets are alike enough."""
    ids = sized(checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    own = sets.join(ids, "id", "left_semi")
    return _near(sized(pairs).join(own.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
                 .join(own.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))


def _compare(group: pa.Table) -> pa.Table:
    """Links of a family block's queries with its members of other components."""
    rows = list(zip(*(group.column(c).to_pylist() for c in ("query", "id", "comp"))))
    sets = [group.column("set")[i].values.to_numpy() for i in range(len(rows))]
    members = [i for i, r in enumerate(rows) if not r[0]]
    queries = [i for i, r in enumerate(rows) if r[0]]
    if not members or not queries:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    size = np.array([len(sets[i]) for i in members])
    keys = np.concatenate([sets[i] for i in members])
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    ids, comps = np.array([rows[i][1] for i in members]), np.array([rows[i][2] for i in members])
    out = []
    for q, comp, s in ((rows[i][1], rows[i][2], sets[i]) for i in queries):
        lo, hi = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
        c = hi - lo
        pick = np.repeat(lo - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        same = np.bincount(owner[pick], minlength=len(size))
        near = (100 * same >= PERCENT * (size + len(s) - same)) & (comps != comp)
        # one link to each component is enough to join it
        for other in np.unique(comps[near]):
            out.append((q, int(ids[near & (comps == other)].min())))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _family_links(open_members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components inside families of undecided buckets; rows (bucket, id, comp)."""
    least = open_members.groupBy("bucket").agg(F.min("id").alias("b"))
    star = open_members.join(least, "bucket").select(F.col("id").alias("a"), "b")
    fam = components(star)
    m = checkpointed(open_members.select("id", "comp").distinct().join(fam.select(F.col("node").alias("id"), F.col("comp").alias("family")), "id"))
    sizes = m.groupBy("family", "comp").count()
    kernel = sizes.groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("kernel"), F.sum("count").alias("n"))
    m = m.join(kernel, "family").withColumn("blocks", F.ceil(F.col("n") / FAMILY_BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = m.select("family", "id", "comp", own.alias("mb"), every.alias("qb"), F.lit(False).alias("query")).unionByName(
        m.filter("comp <> kernel").select("family", "id", "comp", own.alias("qb"), every.alias("mb"), F.lit(True).alias("query")))
    rows = checkpointed(rows)
    return (sized(rows).join(sets.select("id", "set"), "id").groupBy("family", "mb", "qb")
            .applyInArrow(lambda g: _compare(g), "a long, b long"))


def _likeness(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
    return pa.array([estimate(*t) for t in zip(*(c.to_pylist() for c in (x, y, n, m)))], pa.float64())


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    sig = checkpointed(signatures(docs, k))
    classes = checkpointed(sig.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles")
                           .agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs")))
    bands = _bands(classes)
    heads = bands.groupBy("bucket").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = checkpointed(bands.join(heads, "bucket").filter("rep <> head").select("bucket", "rep", "head", "n"))
    pairs = sized(checkpointed(shared.select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()))
    # of an id with several texts, one text stands for it
    own = classes.groupBy("rep").agg(F.min(F.struct("d1", "d2", "n_shingles", "regs")).alias("c")).select("rep", "c.*")
    likeness = F.arrow_udf(_likeness, "double")
    stars = (pairs.join(own.select(F.col("rep").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na")), "a")
             .join(own.select(F.col("rep").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb")), "b")
             .select("a", "b", likeness("ra", "rb", "na", "nb").alias("near")).filter(F.col("near") >= ESTIMATE))
    stars = checkpointed(stars)
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("near", -F.col("b"))).alias("best"))
    ids = (stars.select(F.col("a").alias("id")).union(stars.select("b"))
           .union(shared.filter("n > 2").select("rep"))).distinct()
    ids = checkpointed(ids.join(best.withColumnRenamed("a", "id"), "id", "left")
                       .join(own.select(F.col("rep").alias("id"), "d1", "d2"), "id"))
    sets = checkpointed(_sets(docs, ids, k))
    leaders = sets.join(sized(checkpointed(best.select(F.col("best").alias("id")).distinct())), "id", "left_semi")
    first = checkpointed(_near(sets.filter("best is not null").select(F.col("id").alias("a"), F.col("best").alias("b"), F.col("set").alias("sa"))
                               .join(leaders.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")))
    # where two steps along the first links lead; pairs that meet there need no look
    up = first.groupBy("a").agg(F.min("b").alias("b"))
    for _ in range(2):
        over = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
        up = checkpointed(up.join(over, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
    rest = stars.select("a", "b")
    for c in ("a", "b"):
        rest = rest.join(sized(up).select(F.col("a").alias(c), F.col("b").alias(f"{c}_up")), c, "left")
    rest = checkpointed(rest.filter(F.coalesce("a_up", "a") != F.coalesce("b_up", "b")).select("a", "b"))
    comp = checkpointed(components(first.union(_linked(rest, sets))))
    members = (shared.filter("n > 2").select("bucket", F.col("rep").alias("id"))
               .join(sized(comp).select(F.col("node").alias("id"), "comp"), "id", "left")
               .select("bucket", "id", F.coalesce("comp", "id").alias("comp")))
    undecided = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    open_members = checkpointed(members.join(undecided.select("bucket"), "bucket"))
    if not open_members.isEmpty():
        # links of whole components: theirs are known, the families' are new
        comp = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(_family_links(open_members, sets)))
    label = classes.select("d1", "d2", "n_shingles", "rep").join(
        comp.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    # rows of one id are one document: it belongs to the least component of its rows
    found = (sig.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2", "n_shingles")
           .join(label, ["d1", "d2", "n_shingles"]).groupBy("doc_id")
           .agg(F.min(F.coalesce("comp", "rep")).alias("component_id")))
    out = sig.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def stage_near_duplicates(spark, docs, sf_dir):
    """Pipeline stage: the least id of every group of near copies stays (five-word shingles)."""
    found = near_duplicates(docs, k=5)
    name = free_name("_gone", docs.columns)
    gone = sized(checkpointed(found.filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
