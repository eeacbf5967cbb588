"""Benchmark decontamination by spaced-seed hashing (operator 5).

A seed is a window of ``SPAN`` words of which a fixed mask looks at some and
ignores the rest. The masks come from a rule: the window is cut into
``MISSES + 3`` blocks and a mask keeps three of them, one mask for each choice,
so a window with at most ``MISSES`` substituted words is found by some mask
whatever their places. Every document position is hashed under every mask and
looked up among the benchmark's seeds; around a hit the document and the item
are laid side by side, word by word, and the overlap counts where a window of
``SPAN`` words agrees in at least ``LIKENESS`` of them. Where a document and an item
repeat the same words, hits would grow with the product of the repeats: such a pair is
laid out on all its diagonals instead, one at a time, which can only find the same.

The benchmark is handled in blocks of a bounded number of words: a block's seeds
are broadcast (about 20 MB at most), and each further block is another map over
the documents, so any size of benchmark works and no pairs are made.

Defined cases: words are split at ASCII white space, A-Z lowered; null and empty
texts (documents or items) match nothing; an item of ``least`` (5) to 12 words is one
window of its own length, with masks for the misses that ``LIKENESS`` allows at that
length; a shorter one would be found in clean texts and never matches, unless the caller
lowers ``least`` (to 1: every item counts; below 5 words all must agree); equal items are each reported; repeated documents each give their rows; null ids are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.common import WORD, mix, slices, table, text_bytes, words

SPAN = 13
MISSES = 2
LIKENESS = 0.8
LEAST_WORDS = 5
PAIRS_AT_ONCE = 1 << 19 # places of a seed in rows and items that are paired at once
BLOCK_WORDS = 100_000   # words of benchmark items in one broadcast block


def masks(span: int = SPAN, misses: int = MISSES) -> list[tuple[int, ...]]:
    """Positions each mask looks at."""
    blocks = np.array_split(np.arange(span), misses + 3)
    return [tuple(int(i) for b in keep for i in b) for keep in combinations(blocks, 3)]


def needed(width: int) -> int:
    """Words of a window that must agree."""
    return -(-int(round(LIKENESS * 100)) * width // 100)


def _seeds(h: np.ndarray, mask: tuple[int, ...], n: int) -> np.ndarray:
    """Hash of the masked words at each of the first n positions."""
    s = np.full(n, np.uint64(len(mask)), np.uint64)
    for j in mask:
        s += h[j:j + n] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(s)


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of start[i] .. start[i] + n[i] - 1, with their i."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + np.repeat(start - np.cumsum(n) + n, n)


class Index:
    """Seeds of a block of benchmark items: sorted hashes, item and offset, by mask."""

    def __init__(self, items: list[tuple[object, str | None]], span: int = SPAN, least: int = LEAST_WORDS):
        self.ids = [i for i, _ in items]
        raw, offs = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        self.h, self.at = words(raw, offs)
        n = np.diff(self.at)
        self.longest = int(n.max()) if len(n) else 0
        self.span = span
        self.masks = [(m, span) for m in masks(span)]
        self.masks += [(m, k) for k in sorted({int(k) for k in n if max(1, least) <= k < span}) for m in masks(k, k - needed(k))]
        self.tables = []
        for mask, width in self.masks:
            use = n >= span if width == span else n == width
            s = _seeds(self.h, mask, max(0, len(self.h) - width + 1))
            ok = np.zeros(len(s), bool)
            item = np.repeat(np.arange(len(n)), n)[:len(s)]
            off = np.arange(len(s)) - self.at[item] if len(s) else np.zeros(0, np.int64)
            if len(s):
                ok = use[item] & (off <= n[item] - width)
            order = np.lexsort((off[ok], item[ok], s[ok]))
            bits = np.zeros(1 << (20 if width == span else 17), bool)
            bits[(s[ok] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.tables.append((s[ok][order], item[ok][order], off[ok][order], bits))

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of the (row, item, diagonal) triples of all seeds that the rows
        share with items, and of the (row, item) pairs whose every diagonal is to be
        laid out: those where one seed's places in the row times its places in the
        item are more than the diagonals they can have (repeated words)."""
        n_items, wide = len(self.ids), self._wide(h)
        found, dense = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (mask, width), (key, item, off, bits) in zip(self.masks, self.tables):
            n = len(h) - width + 1
            if n <= 0 or not len(key):
                continue
            s = _seeds(h, mask, n)
            pos = np.flatnonzero(bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)])
            row = np.searchsorted(at, pos, "right") - 1
            inside = pos + width <= at[row + 1]
            pos, row = pos[inside], row[inside]
            lo = np.searchsorted(key, s[pos], "left")
            hit = lo < len(key)
            hit[hit] = key[lo[hit]] == s[pos[hit]]
            pos, row, lo = pos[hit], row[hit], lo[hit]
            order = np.lexsort((pos, lo, row))                  # places of a row's seed side by side
            pos, row, lo = pos[order], row[order], lo[order]
            new = np.ones(len(pos), bool)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] != lo[:-1])
            first = np.flatnonzero(new)
            places = np.diff(np.append(first, len(pos)))
            turn = np.ones(len(key), bool)                      # entries of one seed and item
            turn[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
            group = np.flatnonzero(turn)
            size = np.diff(np.append(group, len(key)))
            g_lo = np.searchsorted(group, lo[first])
            g_n = np.searchsorted(group, np.searchsorted(key, s[pos[first]], "right")) - g_lo
            which, g = _spread(g_lo, g_n)                       # a row's seed and an item's
            r, i = row[first[which]], item[group[g]]
            many = places[which] * size[g] > np.diff(at)[r] + np.diff(self.at)[i]
            dense.append(np.unique(r[many] * n_items + i[many]))
            few = np.flatnonzero(~many)
            ends = np.cumsum(places[which[few]] * size[g[few]])
            for part in np.split(few, np.flatnonzero(np.diff(ends // PAIRS_AT_ONCE)) + 1):
                k, p = _spread(first[which[part]], places[which[part]])
                e, q = _spread(group[g[part[k]]], size[g[part[k]]])
                shift = pos[p[e]] - at[row[p[e]]] - off[q]
                found.append(np.unique((row[p[e]] * n_items + item[q]) * wide + shift + self.longest))
            found = [np.unique(np.concatenate(found))]
        return found[0], np.unique(np.concatenate(dense))

    def _wide(self, h: np.ndarray) -> int:
        return len(h) + self.longest + 1

    def diagonals(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, diagonal) to be laid out."""
        found, dense = self.hits(h, at)
        n_items, wide = len(self.ids), self._wide(h)
        pair = found // wide
        lone = ~np.isin(pair, dense)
        for p, d in zip(pair[lone].tolist(), (found[lone] % wide - self.longest).tolist()):
            yield p // n_items, p % n_items, d
        for p in dense.tolist():
            row, item = p // n_items, p % n_items
            n = int(self.at[item + 1] - self.at[item])
            width = min(self.span, n)
            for d in range(width - n, int(at[row + 1] - at[row]) - width + 1):
                yield row, item, d

    def overlaps(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Verified (row, item, first word, words, equal words, item's words): the widest
        agreement on a hit's diagonal, from the first to the last window that counts."""
        for row, item, shift in self.diagonals(h, at):
            a, b = h[at[row]:at[row + 1]], self.h[self.at[item]:self.at[item + 1]]
            first, end = max(0, shift), min(len(a), shift + len(b))
            same = a[first:end] == b[first - shift:end - shift]
            width = min(self.span, len(b))
            need = needed(width)
            c = np.concatenate(([0], np.cumsum(same)))
            good = np.flatnonzero(c[width:] - c[:-width] >= need) if len(same) >= width else ()
            if len(good):
                lo, hi = int(good[0]), int(good[-1]) + width
                yield row, item, first + lo, hi - lo, int(c[hi] - c[lo]), len(b)


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items (item_id, text) in blocks of about ``BLOCK_WORDS`` words."""
    b = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = b.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    n = int(-(-total // BLOCK_WORDS))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n or 1))
    return [b.filter(key == k) for k in range(n)]


def _index(spark, block: DataFrame, least: int):
    """Broadcast seeds of one block; its size is bounded by BLOCK_WORDS."""
    rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=repr)
    return spark.sparkContext.broadcast(Index(rows, least=least))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal, item_words): every document
    and item that overlap, with the widest overlap."""
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema.fields, *benchmark.schema.fields]}
    schema = (f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, first_word long, n_words long, n_equal long, "
              "item_words long")
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = _index(spark, block, least)

        def find(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    h, at = words(*text_bytes(part.column("text")))
                    best: dict[tuple[int, int], tuple] = {}
                    for row, item, *span in index.overlaps(h, at):
                        best[row, item] = max(best.get((row, item), (0, 0)), (span[1], -span[0], *span))
                    if best:
                        ids = part.column("doc_id").to_pylist()
                        rows = [(ids[r], index.ids[i], *v[2:]) for (r, i), v in sorted(best.items())]
                        cols = [pa.array(c) for c in zip(*rows)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in rows], part.schema.field("doc_id").type), *cols[1:]],
                            ["doc_id", "item_id", "first_word", "n_words", "n_equal", "item_words"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(find, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents that overlap with no item."""
    for block in blocks(benchmark):
        shared = _index(docs.sparkSession, block, least)

        def keep(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, "text"):
                    h, at = words(*text_bytes(part.column("text")))
                    ok = np.ones(part.num_rows, bool)
                    ok[[row for row, *_ in shared.value.overlaps(h, at)]] = False
                    yield part.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark, docs, sf_dir):
    """Pipeline stage: documents that overlap with a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))
