r"""Language-model scoring by a weighted backoff automaton (operator 1).

Model: n-grams of words (``ORDER``) over the training texts, each text closed by
an end token and preceded by a start context. The lowest level discounts each
known word by D = n1 / (n1 + 2 n2) and gives what it takes away to the unknown
word: p(w) = (c - D) / N, p(unknown) = D V / N. Every higher level is smoothed
by the level below: p(w | h) = (c(hw) + MU p(w | h')) / (c(h) + MU). All counts
are of the whole training corpus.

Automaton: the known n-grams of fewer than ``ORDER`` words are states; a known
continuation is an arc with log10 p(w | h); a failure arc leads to the state
without the first word and weighs log10 (MU / (c(h) + MU)); the empty state has an
arc for every word. A text is read once from left to right, carrying the state
and adding up weights.

Scale: the corpus's n-grams are counted in hash ranges (see ``blocks``); a block
of documents asks for the counts of its own n-grams and builds the automaton
that its texts can reach, so the model is never in one place. Most n-grams of two
and more words occur in one block only, and their count there is the corpus's:
blocks first exchange the leading bits of their keys, and only keys whose bits
another key has too are then exchanged whole. Many texts of a
block are read in step with each other; a long text is read in pieces, each
started ``ORDER - 1`` words early, after which the state is the same as if read
from the start.

Defined cases: null and empty texts have the end token only; a null id counts
as the text '' for the fold; repeated rows are scored and counted as often as
they occur; without training texts every word is unknown and has probability 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.blocks import blocked, cuts, n_buckets, opened, pack, pack_sorted, rows_of, unpack, unpack_sorted
from seqlab.llm.common import chain, checkpointed, in_fold, shuffles_freed, table, words

ORDER = 3
MU = 3000.0
HELD_MOD, HELD_FOLD = 7, 2
PIECE = 512             # tokens of a text read in one run
END = np.uint64(0x5D2E8A1F3B7C9461)     # stands for the end token; a word's hash meets it with chance 2^-64
START = np.uint64(0xA3C59AC2F1083E57)


def held_out(ids: list, mod: int = HELD_MOD, fold: int = HELD_FOLD) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod == fold for i in ids], bool)


class Grams:
    """Tokens of a block's texts and their n-grams: per order the distinct keys
    (sorted), the key of each position, and which positions have one."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, order: int = ORDER, places: bool = True):
        """Without ``places`` the keys alone are made."""
        h, at = words(data, offs)
        n = len(offs) - 1
        self.at = at + np.arange(n + 1)
        self.tok = np.empty(len(h) + n, np.uint64)
        doc = np.repeat(np.arange(n), np.diff(at))
        self.tok[np.arange(len(h)) + doc] = h
        self.tok[self.at[1:] - 1] = END
        self.doc = np.repeat(np.arange(n), np.diff(self.at))
        self.place = np.arange(len(self.tok)) - self.at[self.doc]      # within its text
        self.keys, self.of, self.has = [], [], []
        gram = self.tok
        for o in range(1, order + 1):
            if o > 1:
                before = np.concatenate(([START], gram[:-1]))
                before[self.place == 0] = START
                gram = chain(before, self.tok) if o > 2 else chain(before + np.uint64(1), self.tok)
            has = self.place >= o - 2
            if not places:
                keys = np.sort(gram[has])
                self.keys.append(keys[np.diff(keys, prepend=keys[:1] - np.uint64(1)) != 0])
                continue
            keys, of = np.unique(gram[has], return_inverse=True)
            full = np.full(len(gram), -1, np.int64)
            full[has] = of
            self.keys.append(keys)
            self.of.append(full)
            self.has.append(has)

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        use = train[self.doc]
        return [np.bincount(of[has & use], minlength=len(k)) for k, of, has in zip(self.keys, self.of, self.has)]


def _by_range(block: int, n: int, at: list[np.ndarray], columns: dict) -> pa.RecordBatch:
    """A message for each hash range that has keys: of every column a list of byte
    strings, column[name](order, first key, end)."""
    full = [b for b in range(n) if any(c[b + 1] > c[b] for c in at)]
    lists = [pa.array([[f(o, c[b], c[b + 1]) for o, c in enumerate(at)] for b in full], pa.list_(pa.binary())) for f in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *lists],
                                      ["bucket", "block", *columns])


def mark_bits(raw: int) -> int:
    """Leading bits of a key that are exchanged first: a corpus of ``raw`` bytes has
    less than raw / 2 keys an order, so few keys share them by chance."""
    return min(64, int(raw).bit_length() + 1)


def _marks(blocks: DataFrame, n: int, order: int, bits: int) -> DataFrame:
    """The leading bits of every block's keys of two and more words."""
    def ask(batches):
        for row in rows_of(batches):
            _, data, offs = opened(row)
            keys = Grams(data, offs, order, places=False).keys[1:]
            short = [k >> np.uint64(64 - bits) for k in keys]
            yield _by_range(row["block"], n, [cuts(k, n) for k in keys], {"marks": lambda o, i, j: pack_sorted(short[o][i:j])})

    return blocks.mapInArrow(ask, "bucket int, block long, marks array<binary>")


def _met(group: pd.DataFrame) -> pd.DataFrame:
    """For each block's marks, whether another key has the same one."""
    replies: list[list[bytes]] = [[] for _ in range(len(group))]
    for o in range(len(group["marks"].iloc[0])):
        marks = [unpack_sorted(m[o]) for m in group["marks"]]
        _, of, c = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
        met = c[of] > 1
        at = np.concatenate(([0], np.cumsum([len(m) for m in marks])))
        for i in range(len(marks)):
            replies[i].append(_bits(met[at[i]:at[i + 1]]))
    return pd.DataFrame({"block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy(), "met": replies})


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def _flags(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=4), count=int.from_bytes(data[:4], "little")).astype(bool)


def _exchanged(grams: Grams, met: list[dict] | None) -> list[np.ndarray]:
    """Per order, which keys of the block are exchanged whole: all words, and the
    longer keys whose marks were met."""
    return [np.ones(len(grams.keys[0]), bool),
            *[np.concatenate([np.zeros(0, bool), *[_flags(r["met"][o]) for r in met or ()]]) for o in range(len(grams.keys) - 1)]]


def _requests(blocks: DataFrame, n: int, order: int, mod: int, fold: int) -> DataFrame:
    """Keys and own counts of ``blocks`` (with their column ``met``)."""
    def ask(batches):
        for row in rows_of(batches):
            ids, data, offs = opened(row)
            grams = Grams(data, offs, order)
            use = _exchanged(grams, row["met"])
            keys = [k[u] for k, u in zip(grams.keys, use)]
            counts = [c[u].astype(np.uint32) for c, u in zip(grams.counts(~held_out(ids, mod, fold)), use)]
            yield _by_range(row["block"], n, [cuts(k, n) for k in keys],
                            {"keys": lambda o, i, j: pack_sorted(keys[o][i:j]), "counts": lambda o, i, j: pack(counts[o][i:j])})

    return blocks.mapInArrow(ask, "bucket int, block long, keys array<binary>, counts array<binary>")


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for each block's keys, and the bucket's sums over known words."""
    order = len(group["keys"].iloc[0])
    replies: list[list[bytes]] = [[] for _ in range(len(group))]
    sums = (0, 0, 0, 0)
    for o in range(order):
        keys = [unpack_sorted(k[o]) for k in group["keys"]]
        own = np.concatenate([unpack(c[o], np.uint32) for c in group["counts"]])
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, weights=own) if len(of) else np.zeros(0)
        if o == 0:
            sums = (int((total > 0).sum()), int(total.sum()), int((total == 1).sum()), int((total == 2).sum()))
        at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        for i in range(len(keys)):
            replies[i].append(pack(total[of[at[i]:at[i + 1]]].astype(np.uint64)))
    first = np.arange(len(group)) == 0
    return pd.DataFrame({"block": group["block"].to_numpy(), "bucket": group["bucket"].to_numpy(), "reply": replies,
                         **{c: np.where(first, s, 0) for c, s in zip(("types", "tokens", "once", "twice"), sums)}})


_REPLY = "block long, bucket int, reply array<binary>, types long, tokens long, once long, twice long"


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block.

    State 0 is the empty context, 1 the start of a text, the others are the
    block's n-grams of fewer than ``order`` words, level by level."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], corpus: dict, mu: float = MU):
        order, n_docs = len(counts), corpus["docs"]
        n, v = corpus["tokens"], corpus["types"]
        d = corpus["once"] / (corpus["once"] + 2 * corpus["twice"]) if corpus["once"] else 0.0
        d = min(0.9, max(0.1, d))
        self.words = len(counts[0])
        base = np.cumsum([2, *[len(c) for c in counts[:-1]]])           # first state of each level
        states = int(base[-1])
        p = np.where(counts[0] > 0, (counts[0] - d) / max(n, 1), d * v / max(n, 1)) if n else np.ones(self.words)
        self.root = np.log10(p)
        self.root_next = np.where(counts[0] > 0, base[0] + np.arange(self.words), 0) if order > 1 else np.zeros(self.words, np.int64)
        self.fail = np.zeros(states, np.int64)
        self.fail_w = np.zeros(states)
        self.fail_w[1] = np.log10(mu / (n_docs + mu))
        keys, weights, nexts = [], [], []
        for o in range(2, order + 1):
            has = grams.has[o - 1]
            ids, where = np.unique(grams.of[o - 1][has], return_index=True)
            at = np.flatnonzero(has)[where]                             # a place of each o-gram
            opening = grams.place[at] == 0
            prefix = np.where(opening, -1, grams.of[o - 2][at - 1])     # -1: the start context
            suffix = grams.of[o - 2][at]
            known = np.where(opening, n_docs, counts[o - 2][np.maximum(prefix, 0)])
            if o > 2:
                known = np.where(opening, 0, known)
            p = (counts[o - 1][ids] + mu * p[suffix]) / (known + mu)
            arc = counts[o - 1][ids] > 0
            state = np.where(opening, 1, base[o - 2] + prefix)
            keys.append((state * self.words + grams.of[0][at])[arc])
            weights.append(np.log10(p[arc]))
            nexts.append((base[o - 1] + ids if o < order else base[o - 2] + suffix)[arc])
            if o < order:
                self.fail[base[o - 1] + ids] = base[o - 2] + suffix
        for o in range(1, order):
            with np.errstate(divide="ignore"):
                self.fail_w[base[o - 1]:base[o - 1] + len(counts[o - 1])] = np.log10(mu / (counts[o - 1] + mu))
        sort = np.argsort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.keys = np.concatenate(keys)[sort] if keys else sort
        self.weights = np.concatenate(weights)[sort] if keys else np.zeros(0)
        self.nexts = np.concatenate(nexts)[sort] if keys else sort
        self.order = order

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of many readers: (weight, next state)."""
        out, nxt = np.zeros(len(state)), np.empty(len(state), np.int64)
        left = np.arange(len(state))
        s = state
        while len(left):
            done = s == 0
            i = left[done]
            out[i] += self.root[word[i]]
            nxt[i] = self.root_next[word[i]]
            left, s = left[~done], s[~done]
            key = s * self.words + word[left]
            at = np.searchsorted(self.keys, key)
            hit = at < len(self.keys)
            hit[hit] = self.keys[at[hit]] == key[hit]
            i = left[hit]
            out[i] += self.weights[at[hit]]
            nxt[i] = self.nexts[at[hit]]
            left, s = left[~hit], s[~hit]
            out[left] += self.fail_w[s]
            s = self.fail[s]
        return out, nxt

    def score(self, word: np.ndarray, at: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """log10 probability of each text word[at[i]:at[i+1]]."""
        early = self.order - 1
        n = np.diff(at)
        pieces = -(-n // piece)
        text = np.repeat(np.arange(len(n)), pieces)
        k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = at[:-1][text] + k * piece
        end = np.minimum(first + piece, at[1:][text])
        lead = np.minimum(early, first - at[:-1][text])                 # words read again to reach the state
        state = np.where(first - lead == at[:-1][text], int(self.order > 1), 0)     # a text's start is known
        pos, total = first - lead, np.zeros(len(text))
        order = np.argsort(-(end - pos), kind="stable")
        pos, end, lead, state = pos[order], end[order], lead[order], state[order]
        length, sums = end - pos, np.zeros(len(order))
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, "left"))               # readers that have a t-th word
            w, state[:m] = self.read(state[:m], word[pos[:m] + t])
            sums[:m] += np.where(t >= lead[:m], w, 0.0)
        total[order] = sums
        return np.bincount(text, weights=total, minlength=len(n))


def _by_block(replies: DataFrame, name: str) -> DataFrame:
    """A block's replies in the order of the hash ranges."""
    return replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", name))).alias(name))


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, mod: int = HELD_MOD, fold: int = HELD_FOLD) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): tokens, base score and model score
    under the model of all documents outside the held-out fold."""
    blocks = blocked(docs)
    n = n_buckets(blocks)
    size = blocks.agg(F.sum("raw")).first()[0] or 0
    with shuffles_freed(blocks.sparkSession):
        if order > 1:
            marks = _marks(blocks, n, order, mark_bits(size)).repartition(n, "bucket")
            met = checkpointed(_by_block(marks.groupBy("bucket").applyInPandas(
                lambda g: _met(g), "block long, bucket int, met array<binary>"), "met"))
            blocks = blocks.join(met, "block", "left")
        else:
            blocks = blocks.withColumn("met", F.lit(None).cast("array<struct<bucket:int,met:array<binary>>>"))
        asked = _requests(blocks, n, order, mod, fold).repartition(n, "bucket")
        replies = checkpointed(asked.groupBy("bucket").applyInPandas(lambda g: _answer(g), _REPLY))
    corpus = {k: v or 0 for k, v in replies.agg(*[F.sum(c).alias(c) for c in ("types", "tokens", "once", "twice")]).first().asDict().items()}

    corpus["docs"] = blocks.select(F.explode("ids").alias("id")).filter(~in_fold(F.col("id"), mod, fold)).count()
    joined = blocks.join(_by_block(replies, "reply").withColumnRenamed("reply", "replies"), "block")

    def run(batches):
        for row in rows_of(batches):
            ids, data, offs = opened(row)
            grams = Grams(data, offs, order)
            counts = grams.counts(~held_out(ids, mod, fold))
            for o, use in enumerate(_exchanged(grams, row["met"])):
                counts[o][use] = np.concatenate([unpack(r["reply"][o], np.uint64) for r in row["replies"]]).astype(np.int64)
            word = grams.of[0]
            c = counts[0][word]
            base = np.log10((c + 1) / (corpus["tokens"] + corpus["types"] + 1))
            model = Automaton(grams, counts, corpus, mu)
            held = held_out(ids, mod, fold)
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(np.diff(grams.at)),
                 pa.array(np.bincount(grams.doc[c > 0], minlength=m)), pa.array(np.full(m, corpus["tokens"], np.int64)),
                 pa.array(np.bincount(grams.doc, weights=base, minlength=m)), pa.array(model.score(word, grams.at))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_score(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB SQL (bitwise, reflected polynomial)."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
            "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), "
            "lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} % {HELD_MOD} = {HELD_FOLD} AS held,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+'), ' ') AS toks FROM documents),
t AS (SELECT doc_id, held, w, i, CASE WHEN i = 1 THEN '  ' ELSE toks[i - 1] END AS h
      FROM (SELECT *, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM d)),
uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
bi AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held GROUP BY h, w),
ctx AS (SELECT h, sum(c) AS c FROM bi GROUP BY h),
g AS (SELECT sum(c) AS n, count(*) AS v, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2 FROM uni),
k AS (SELECT n::DOUBLE AS n, v::DOUBLE AS v, least(0.9, greatest(0.1, n1::DOUBLE / (n1 + 2 * n2))) AS d FROM g),
s AS (
  SELECT t.doc_id, t.held, coalesce(uni.c, 0) AS c,
    log10((coalesce(uni.c, 0) + 1) / (k.n + k.v + 1)) AS base,
    CASE WHEN uni.c IS NOT NULL THEN (uni.c - k.d) / k.n ELSE k.d * k.v / k.n END AS p, bi.c AS c2, ctx.c AS ch
  FROM t CROSS JOIN k LEFT JOIN uni ON uni.w = t.w LEFT JOIN bi ON bi.h = t.h AND bi.w = t.w LEFT JOIN ctx ON ctx.h = t.h)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known,
  (SELECT CAST(n AS BIGINT) FROM k) AS train_tokens, sum(base) AS base_score,
  sum(log10((coalesce(c2, 0) + {MU} * p) / (coalesce(ch, 0) + {MU}))) AS score
FROM s GROUP BY doc_id
"""

# The same with two words of context (three-word counts smoothed by the level above).
OP1_SQL_3 = rf"""
WITH d AS (
  SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} % {HELD_MOD} = {HELD_FOLD} AS held,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x20\x09-\x0D]+'), ' ') AS toks FROM documents),
t AS (SELECT doc_id, held, w, i, CASE WHEN i = 1 THEN '  ' ELSE toks[i - 1] END AS h,
        CASE WHEN i = 2 THEN '  ' WHEN i > 2 THEN toks[i - 2] END AS hh
      FROM (SELECT *, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM d)),
uni AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
bi AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held GROUP BY h, w),
tri AS (SELECT hh, h, w, count(*) AS c FROM t WHERE NOT held AND i > 1 GROUP BY hh, h, w),
ctx AS (SELECT h, sum(c) AS c FROM bi GROUP BY h),
ctx2 AS (SELECT hh, h, sum(c) AS c FROM tri GROUP BY hh, h),
g AS (SELECT sum(c) AS n, count(*) AS v, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2 FROM uni),
k AS (SELECT n::DOUBLE AS n, v::DOUBLE AS v, least(0.9, greatest(0.1, n1::DOUBLE / (n1 + 2 * n2))) AS d FROM g),
s AS (
  SELECT t.doc_id, t.held, coalesce(uni.c, 0) AS c,
    log10((coalesce(uni.c, 0) + 1) / (k.n + k.v + 1)) AS base,
    CASE WHEN uni.c IS NOT NULL THEN (uni.c - k.d) / k.n ELSE k.d * k.v / k.n END AS p,
    (coalesce(bi.c, 0) + {MU} * p) / (coalesce(ctx.c, 0) + {MU}) AS p2, tri.c AS c3, ctx2.c AS chh
  FROM t CROSS JOIN k LEFT JOIN uni ON uni.w = t.w LEFT JOIN bi ON bi.h = t.h AND bi.w = t.w LEFT JOIN ctx ON ctx.h = t.h
  LEFT JOIN tri ON tri.hh = t.hh AND tri.h = t.h AND tri.w = t.w LEFT JOIN ctx2 ON ctx2.hh = t.hh AND ctx2.h = t.h)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known,
  (SELECT CAST(n AS BIGINT) FROM k) AS train_tokens, sum(base) AS base_score,
  sum(log10((coalesce(c3, 0) + {MU} * p2) / (coalesce(chh, 0) + {MU}))) AS score
FROM s GROUP BY doc_id
"""
