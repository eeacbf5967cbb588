r"""Phrase collocation mining by multikey quicksort of suffix pointers (operator 12).

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]`` and those
into words ``[^\x20\x09]+``. A suffix is the next ``most`` words of its piece.
Suffixes are routed by their leading words; a task sorts the pointers of its
suffixes by three-way partitions, word by word, to that depth. Every equal
partition is a phrase and its size the phrase's count; partitions smaller than
``least`` are abandoned, since nothing in them can be frequent.

Steps: (1) blocks of a few MB become word streams with a dictionary of their own;
(2) word counts per language; only frequent words get a number, others end a
suffix, as no phrase with them can be frequent; (3) numbers go back to the blocks;
(4) prefixes that more than ``HOT`` suffixes share are found level by level; (5) a
block's equal suffixes become one with their count and are routed by their
shortest prefix that is not hot; (6) the sort; (7) scores by joins of counts.

Scale: a word or phrase is one row a block, however often it occurs there. A hot
word's suffixes are spread by their next words, and so on to the full depth,
where equal suffixes are one row a block. There are at most ``HOT_MOST`` hot
prefixes a length (each holds its share of all words), which is what the driver
and the tasks see of them. Counts are exact; words are compared as such, not by
hashes.

Defined cases: a null text is empty, a null language is ``und``; texts without
words give nothing; repeated rows count as often as they occur; null ids do not
matter, and no other column is read; an empty table gives an empty result; a long
text is cut between pieces, so a block exceeds its size only by one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.blocks import pack, rows_of, unpack
from seqlab.llm.common import _LOW, checkpointed, mix, numbered, shuffle_partitions, sized, slices, table, text_bytes, tidy

MOST_WORDS = 5
LEAST = 100             # occurrences of a frequent phrase
RATIO = 100             # percent of a phrase's occurrences that lie in a longer one which replaces it
TOP = 2000
BLOCK_BYTES = 4 << 20
BUCKET = 1 << 20        # suffixes of a bucket
HOT_MOST = 1 << 22      # hot prefixes of one length
SHIFT = 40              # bits of a word number

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


# ---------------------------------------------------------------- words

def runs(data: np.ndarray, offs: np.ndarray, most: int = BLOCK_BYTES):
    """(first byte, last byte, row bounds, rows) of runs of about ``most`` bytes; a longer
    row is cut after the last break of each run, where no suffix crosses."""
    i, at = 0, int(offs[0])
    while i + 1 < len(offs):
        if offs[i + 1] - at > most:
            own = np.flatnonzero(_BREAK[data[at:at + most]])
            if len(own):
                end = at + int(own[-1]) + 1
            else:
                k, step = at + most, 0
                while k < offs[i + 1] and not step:
                    own = np.flatnonzero(_BREAK[data[k:min(k + most, offs[i + 1])]])
                    k, step = (k + int(own[0]) + 1, 1) if len(own) else (min(k + most, int(offs[i + 1])), 0)
                end = k
            yield at, end, np.array([at, end]), np.array([i])
            at = end
            if at == offs[i + 1]:
                i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offs, at + most, "right")) - 1)
        yield at, int(offs[j]), np.concatenate(([at], offs[i + 1:j + 1])), np.arange(i, j)
        i, at = j, int(offs[j])


def word_stream(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, index of each word, whether it starts a piece, its row)."""
    n = len(data)
    low = _LOW[data]
    ok = _WORD[low]
    row0 = offs[:-1][offs[:-1] < n]
    begins = ok.copy()
    begins[1:] &= ~ok[:-1]
    begins[row0] = ok[row0]
    ends = ok.copy()
    ends[:-1] &= ~ok[1:]
    last = row0[row0 > 0] - 1
    ends[last] = ok[last]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    at = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at.tobytes()), pa.py_buffer(low[ok].tobytes())).dictionary_encode()
    row = np.searchsorted(offs, start, "right") - 1
    breaks = np.cumsum(_BREAK[low], dtype=np.int32)[start] if n else np.zeros(0, np.int32)
    first = np.ones(len(start), bool)
    first[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), first, row


def word_blocks(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, langs, words, counts, stream): a block's distinct (language, word) with their
    counts, and its words as indices of those; the first word of a piece is complemented."""
    def cut(batches):
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", size):
                data, offs = text_bytes(part.column("text"))
                code = pc.fill_null(part.column("lang"), "und").dictionary_encode()
                lang = code.indices.to_numpy(zero_copy_only=False)
                for a, b, bounds, rows in runs(data, offs, size):
                    vocabulary, word, first, row = word_stream(data[a:b], bounds - a)
                    if not len(word):
                        continue
                    width = len(vocabulary)
                    pair, of, count = np.unique(lang[rows[row]].astype(np.int64) * width + word, return_inverse=True, return_counts=True)
                    of = of.astype(np.int32)
                    one = pa.array([0, len(pair)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([seq]), pa.ListArray.from_arrays(one, code.dictionary.take(pa.array(pair // width))),
                         pa.ListArray.from_arrays(one, vocabulary.take(pa.array(pair % width))),
                         pa.ListArray.from_arrays(one, pa.array(count)), pa.array([pack(np.where(first, ~of, of))], pa.binary())],
                        ["block", "langs", "words", "counts", "stream"])
                    seq += 1
                    tidy()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    return checkpointed(rows.mapInArrow(cut, "block long, langs array<string>, words array<string>, counts array<long>, stream binary"))


def _entries(blocks: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("langs", "words", "counts")
    return (blocks.select("block", F.posexplode(zipped).alias("place", "e"))
            .select("block", "place", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("c")))


def _with_numbers(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """(block, ids, first): the numbers (from 1; 0: not frequent) of a block's words. Every
    word of a block keeps its row in the join, so their number follows the text, not how
    many words are frequent."""
    numbers = frequent.select("lang", "word", (F.col("id") + 1).alias("id"))
    found = (_entries(blocks).drop("c").join(numbers, ["lang", "word"], "left").withColumn("id", F.coalesce("id", F.lit(0)))
             .groupBy("block").agg(F.collect_list("place").alias("place"), F.collect_list("id").alias("id")))

    def run(batches):
        for row in rows_of(batches):
            number = np.zeros(row["size"], np.int64)
            number[row["place"]] = row["id"]
            s = unpack(row["stream"], np.int32)
            first = s < 0
            ids = number[np.where(first, ~s, s)]
            # a run of infrequent words is one break
            keep = (ids > 0) | np.append(True, ids[:-1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([pack(ids[keep])]),
                                              pa.array([pack(first[keep].view(np.uint8))])], ["block", "ids", "first"])

    rows = blocks.select("block", F.size("words").alias("size"), "stream").join(found, "block")
    return checkpointed(rows.mapInArrow(run, "block long, ids binary, first binary"))


# ---------------------------------------------------------------- suffixes

def suffixes(row: dict, most: int) -> np.ndarray:
    """(suffix, word) numbers of all suffixes of two words or more; 0 follows a suffix's end."""
    ids, first = unpack(row["ids"], np.int64), unpack(row["first"], np.uint8).astype(bool)
    w = np.zeros((len(ids), most), np.int64)
    w[:, 0] = ids
    for j in range(1, most):
        on = (w[:len(ids) - j, j - 1] > 0) & ~first[j:]
        w[:len(ids) - j, j] = np.where(on, ids[j:], 0)
    return w[w[:, 1] > 0] if most > 1 else w[w[:, 0] > 0]


def _place(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Index of each code in sorted ``codes``, -1 if it isn't there."""
    if not len(codes):
        return np.full(len(code), -1, np.int64)
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return np.where(codes[at] == code, at, -1)


def hot_places(w: np.ndarray, hot: list[np.ndarray]):
    """For each level of ``hot`` the index of the suffixes' prefix in it (-1: not hot). A level's
    codes are the index of the prefix one word shorter and the last word's number."""
    place = None
    for d, codes in enumerate(hot):
        code = w[:, d] if d == 0 else (np.maximum(place, 0) << SHIFT) + w[:, d]
        found = _place(codes, code)
        place = found if d == 0 else np.where((place >= 0) & (w[:, d] > 0), found, -1)
        yield place


def next_hot(numbers: DataFrame, hot: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """(code, count) of the hot prefixes one word longer than those of the last level."""
    d = len(hot)

    def run(batches):
        for row in rows_of(batches):
            w = suffixes(row, d + 1)
            *_, place = hot_places(w, hot)
            on = (place >= 0) & (_place(hot[0], w[:, d]) >= 0)      # a hot prefix has hot words only
            code, count = np.unique((place[on] << SHIFT) + w[on, d], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(count, pa.int64())], ["code", "c"])

    found = numbers.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    return sorted((r["code"], r["c"]) for r in found.collect())     # each has ``least`` of all words: at most HOT_MOST


def _routed(numbers: DataFrame, hot: list[np.ndarray], n: int, most: int) -> DataFrame:
    """A block's distinct suffixes with their counts and the length of the prefix that routes them, by bucket."""
    def run(batches):
        for row in rows_of(batches):
            w = suffixes(row, most)
            if not len(w):
                continue
            w = w[np.lexsort(w.T[::-1])]
            head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]).any(1)))
            count = np.diff(np.append(head, len(w)))
            w = w[head]
            depth = np.ones(len(w), np.int64)
            for place in hot_places(w, hot):
                depth += place >= 0
            h = np.zeros(len(w), np.uint64)
            for j in range(most):
                h = np.where(depth > j, mix(h * np.uint64(0x9E3779B97F4A7C15) + w[:, j].astype(np.uint64)), h)
            bucket = (h % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, at = np.unique(bucket[order], return_index=True)
            out = {"bucket": own, "suffixes": [], "counts": [], "depths": []}
            for a, b in zip(at, np.append(at[1:], len(order))):
                i = order[a:b]
                out["suffixes"].append(pack(np.ascontiguousarray(w[i].T).reshape(-1)))
                out["counts"].append(pack(count[i]))
                out["depths"].append(pack(depth[i].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()], list(out))
            tidy()

    return numbers.mapInArrow(run, "bucket int, suffixes binary, counts binary, depths binary").repartition(n, "bucket")


def multikey_quicksort(w: np.ndarray, weight: np.ndarray, least: int):
    """(pointer, words, count) of the prefixes whose weights sum up to ``least``.

    ``w`` is (word, suffix). A partition's pointers agree in the first ``d`` words and are
    split by their next word into smaller, equal and larger ones; the equal ones go on with
    the word after it. Partitions below ``least`` are abandoned, and so are ended suffixes."""
    stack = [(np.flatnonzero(w[0] > 0), 0)]
    while stack:
        pointers, d = stack.pop()
        total = int(weight[pointers].sum())
        if total < least:
            continue
        key = w[d][pointers]
        pivot = key[len(key) >> 1]
        same = key == pivot
        if same.all():
            equal, size = pointers, total
        else:
            equal = pointers[same]
            size = int(weight[equal].sum())
            if total - size >= least:
                rest, key = pointers[~same], key[~same]
                stack.append((rest[key < pivot], d))
                stack.append((rest[key > pivot], d))
        if pivot > 0 and size >= least:
            yield equal[0], d + 1, size
            if d + 1 < len(w):
                stack.append((equal, d + 1))


def _sorted(most: int, least: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.to_pydict()
        w = np.concatenate([unpack(s, np.int64).reshape(most, -1) for s in group["suffixes"]], 1)
        weight = np.concatenate([unpack(c, np.int64) for c in group["counts"]])
        depth = np.concatenate([unpack(c, np.uint8) for c in group["depths"]])
        phrase, count = [], []
        for i, n, size in multikey_quicksort(w, weight, least):
            if n >= max(2, depth[i]):       # shorter prefixes are hot: their suffixes are in several buckets
                phrase.append((w[:n, i] - 1).tolist())
                count.append(size)
        tidy()
        return pa.table([pa.array(phrase, pa.list_(pa.int64())), pa.array(count, pa.int64())], ["phrase", "f"])
    return run


# ---------------------------------------------------------------- counts and scores

def phrase_counts(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of 1 to ``most`` words as (phrase: word numbers, f), the frequent words
    (id, lang, word, f) and (lang, n), the number of all words of a language."""
    spark = docs.sparkSession
    blocks = word_blocks(docs)
    counts = checkpointed(_entries(blocks).groupBy("lang", "word").agg(F.sum("c").alias("f")))
    langs = checkpointed(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = checkpointed(numbered(counts.filter(F.col("f") >= least), "lang", "word", name="id").select("id", "lang", "word", "f"))
    total = langs.agg(F.sum("n")).first()[0] or 0
    numbers = _with_numbers(blocks, frequent)
    limit = max(bucket // 2, total // HOT_MOST)
    words = sorted(r["id"] + 1 for r in frequent.filter(F.col("f") >= limit).select("id").collect())    # at most HOT_MOST
    hot, prefixes, phrases = [], [(w,) for w in words], []
    if words:
        hot.append(np.array(words, np.int64))
    while hot and len(hot) < most - 1 and len(hot[-1]):
        found = next_hot(numbers, hot, limit)
        prefixes = [(*prefixes[c >> SHIFT], c & ((1 << SHIFT) - 1)) for c, _ in found]
        phrases += [([w - 1 for w in p], c) for p, (_, c) in zip(prefixes, found) if c >= least]
        hot.append(np.array([c for c, _ in found], np.int64))
    n = max(2 * shuffle_partitions(spark), -(-total // bucket))
    schema = "phrase array<long>, f long"
    longer = _routed(numbers, hot, n, most).groupBy("bucket").applyInArrow(_sorted(most, least), schema)
    every = longer.union(spark.createDataFrame(phrases, schema)).union(frequent.select(F.array("id"), "f"))
    return checkpointed(every), frequent, langs



def scored(counts: DataFrame, frequent: DataFrame, langs: DataFrame) -> DataFrame:
    """(phrase, lang, a, l, r, n, score) of phrases of two words and more, at the cut with the lowest score."""
    first = frequent.select(F.col("id").alias("_id"), "lang")
    candidates = (counts.filter(F.size("phrase") > 1).join(first, F.col("phrase")[0] == F.col("_id")).drop("_id")
                  .withColumnRenamed("f", "a").join(sized(langs), "lang"))
    cuts = (candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
            .withColumn("left", F.slice("phrase", F.lit(1), F.col("k")))
            .withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select(F.col("phrase").alias(side), F.col("f").alias(name)), side)
    # 1000 * a * n stays below 10^38 up to 10^17 words; div is exact
    score = F.expr("(1000BD * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return (cuts.groupBy("phrase", "lang", "a", "n").agg(best)
            .select("phrase", "lang", "a", "best.l", "best.r", "n", "best.score"))


def within(counts: DataFrame) -> DataFrame:
    """(phrase, longest): the greatest count among longer phrases that contain the phrase."""
    own = counts.filter(F.size("phrase") > 2)
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.size("phrase") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("phrase") - n + 1), lambda i: F.slice("phrase", i, n))))
    return own.select("f", F.explode(parts).alias("phrase")).groupBy("phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, ratio: int = RATIO, top: int = TOP,
                 bucket: int = BUCKET) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, frequent, langs = phrase_counts(docs, most, least, bucket)
    kept = (scored(counts, frequent, langs).join(within(counts), "phrase", "left")
            .filter(F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(ratio) * F.col("a"))).drop("longest"))
    kept = checkpointed(kept)
    words = (kept.select("phrase", F.posexplode("phrase").alias("place", "id")).join(frequent.select("id", "word"), "id")
             .groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
             .select("phrase", F.array_join("w.word", " ").alias("text")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "text")
    return (kept.join(words, "phrase").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score"))


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, list_slice(w, i, i + k - 1) AS ph
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {MOST_WORDS + 1}) r(k) WHERE len(w) >= k)),
c AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= {LEAST}),
cut AS (SELECT lang, ph, f, unnest(range(1, len(ph))) AS k FROM c WHERE len(ph) > 1),
s AS (SELECT cut.lang, cut.ph, cut.f AS a, cut.k, l.f AS l, r.f AS r, t.n,
             (1000::HUGEINT * cut.f * t.n) // (l.f::HUGEINT * r.f) AS score
      FROM cut JOIN total t ON t.lang = cut.lang
      JOIN c l ON l.lang = cut.lang AND l.ph = list_slice(cut.ph, 1, cut.k)
      JOIN c r ON r.lang = cut.lang AND r.ph = list_slice(cut.ph, cut.k + 1, len(cut.ph))),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (SELECT lang, list_slice(ph, i, i + m - 1) AS ph, max(f) AS f
           FROM (SELECT lang, ph, f, m, unnest(range(1, len(ph) - m + 2)) AS i FROM c, range(2, {MOST_WORDS}) r(m) WHERE len(ph) > m)
           GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.ph = b.ph
         WHERE i.f IS NULL OR 100 * i.f < {RATIO} * b.a)
SELECT lang, CAST(row_number() OVER w AS BIGINT) AS rank, array_to_string(ph, ' ') AS phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' '))
QUALIFY row_number() OVER w <= {TOP}
"""
