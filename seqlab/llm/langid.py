"""Language ID by compression (operator 7).

Each learned language gets a zstandard raw-content dictionary, cut from a
bounded sample of its labelled texts. A text is encoded with every dictionary,
piece by piece over its whole length; the smallest total wins. The margin is
what the winner saves against the second, as a share of the second's size; a
text is rejected when its margin is below ``REJECT_MARGIN`` (or it has no letter).

Before encoding, letters are lowered and ASCII characters that are no letters
become spaces. Learning takes a documented, bounded sample: at most
``SAMPLE_DOCS`` documents of a language, the first ``SAMPLE_CHARS`` characters
of each, until the dictionary's ``DICT_BYTES`` are full. Every language is learned;
languages are taken ``LANGS_AT_ONCE`` at a time, both in learning and in a task,
which keeps each text's two smallest sizes between such blocks (the compiled
dictionaries of one block take about 100 MB).

Defined cases: null text or a text without a letter gives ``und``, score 0,
rejected; a null ``lang`` is never learned from, an empty one is a language
like others; equal sizes go to the first language by code point, margin 0;
repeated rows give equal results, and the order of rows does not matter; without any labelled row all texts are
``und``; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlab.llm.common import free_name, in_fold, small_batches, table

SAMPLE_DOCS = 256
SAMPLE_CHARS = 1024
DICT_BYTES = 64 << 10
LANGS_AT_ONCE = 64
PIECE = 4096            # bytes encoded at a time, each piece against the fresh dictionary
STRONG_BELOW = 512      # pieces shorter than this are encoded by the slower, closer search,
LEAD = 256              # after so many bytes of the dictionary's end: the encoder stores a few bytes alone as they are
REJECT_MARGIN = 0.002
UND = "und"
HELD_MOD, HELD_FOLD = 4, 2

_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP)


def _params(strong: bool) -> zs.ZstdCompressionParameters:
    return zs.ZstdCompressionParameters(
        window_log=18, chain_log=17 if strong else 16, hash_log=17, search_log=5 if strong else 3, min_match=4,
        target_length=48 if strong else 0, strategy=zs.STRATEGY_BTLAZY2 if strong else zs.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False)


class Coder:
    """Encoded sizes of a text under every language's dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in dictionaries]
        self.leads = [content[-LEAD:] for _, content in dictionaries]
        self.coders = []
        for strong in (False, True):
            params, own = _params(strong), []
            for _, content in dictionaries:
                d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                own.append(zs.ZstdCompressor(compression_params=params, dict_data=d))
            self.coders.append(own)

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        total = [0] * len(self.langs)
        for i in range(0, len(raw), PIECE):
            piece = raw[i:i + PIECE]
            short = len(piece) < STRONG_BELOW
            for k, c in enumerate(self.coders[short]):
                total[k] += len(c.compress(self.leads[k] + piece if short else piece))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        return predictions([self], [text])[0]


def predictions(coders, texts: list) -> list[tuple[str, float]]:
    """(lang, margin) of every text over the languages of all ``coders``, which come in
    code-point order; one of them is needed at a time."""
    todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    best: dict[int, tuple[int, str]] = {}
    second: dict[int, int] = {}
    for coder in coders:
        for i in todo:
            for lang, size in zip(coder.langs, coder.sizes(texts[i])):
                if i not in best:
                    best[i] = size, lang
                elif size < best[i][0]:
                    second[i], best[i] = best[i][0], (size, lang)
                else:
                    second[i] = min(size, second.get(i, size))
    out = [(UND, 0.0)] * len(texts)
    for i, (size, lang) in best.items():
        out[i] = lang, (second[i] - size) / second[i] if second.get(i) else 1.0
    return out


def learn(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, dictionary) in code-point order from rows (doc_id, text, lang).

    Counts by language, then for every ``LANGS_AT_ONCE`` languages a scan for the rows whose
    hash of id and text falls under the language's threshold (about twice the sample), of which
    a window keeps the sample. What reaches the driver at once is bounded by the parameters.
    """
    good = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = [(r["lang"], r["count"]) for r in good.groupBy("lang").count().toLocalIterator()]
    counts.sort()
    known = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    h = F.pmod(known, F.lit(1 << 52)) / F.lit(float(1 << 52))
    # a text prefix that occurs several times counts with its least hash, whatever the order of the rows
    first = Window.partitionBy("lang").orderBy("_h", "text")
    content: dict[str, bytes] = {}
    for i in range(0, len(counts), LANGS_AT_ONCE):
        # languages of few rows keep all of them; Binomial(n, 2 * 256 / n) < 256 is a chance below 1e-30
        picked = reduce(lambda a, b: a | b, [(F.col("lang") == lang) & (F.col("_h") < min(1.0, 2 * SAMPLE_DOCS / n))
                                             for lang, n in counts[i:i + LANGS_AT_ONCE]])
        rows = (good.withColumn("_h", h).filter(picked)
                .groupBy("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).agg(F.min("_h").alias("_h"))
                .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SAMPLE_DOCS)
                .orderBy("lang", "_n").select("lang", "text").collect())
        for r in rows:
            content[r["lang"]] = (content.get(r["lang"], b"") + plain(r["text"]) + b"\n")[:DICT_BYTES]
    return sorted((lang, c.ljust(8)) for lang, c in content.items())     # zstandard takes no shorter dictionary


def classify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], name: str = "_lid") -> DataFrame:
    """``docs`` with a struct ``name`` of lang_pred, score (the margin) and rejected. The
    dictionaries are broadcast, ``LANGS_AT_ONCE`` (4 MB) at a time."""
    schema = "lang_pred string, score double, rejected boolean"
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(dictionaries[i:i + LANGS_AT_ONCE]) for i in range(0, len(dictionaries), LANGS_AT_ONCE)]
    made: dict[int, Coder] = {}

    def coders():
        for i, own in enumerate(shared):
            if i not in made:
                made.clear()        # one block at a time; a single one stays
                made[i] = Coder(own.value)
            yield made[i]

    def predict(texts: pa.Array) -> pa.Array:
        out = predictions(coders(), texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64()),
             pa.array([p == UND or s < REJECT_MARGIN for p, s in out], pa.bool_())], ["lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    return docs.withColumn(name, F.arrow_udf(predict, schema)(F.col("text")))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = in_fold(F.col("doc_id"), HELD_MOD, HELD_FOLD)
    dictionaries = learn(docs.filter(~held))
    return (classify(docs.select("doc_id", "text"), dictionaries)
            .select("doc_id", held.alias("held_out"), "_lid.lang_pred", "_lid.score", "_lid.rejected"))


def stage_language(spark, docs, sf_dir):
    """Pipeline stage: documents whose language is rejected go."""
    cols = docs.columns
    held = in_fold(F.col("doc_id"), HELD_MOD, HELD_FOLD)
    dictionaries = learn(docs.filter(~held))
    name = free_name("_lid", cols)
    return classify(docs, dictionaries, name).filter(~F.col(f"{name}.rejected")).select(*[f"`{c}`" for c in cols])
