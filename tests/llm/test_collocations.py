import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqlab.llm import collocations
from tests.llm import cases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, most):
    """rows (lang, text) to per-language counts of phrases and of words."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    return f, n


def model(rows, most, least, ratio, top):
    f, n = phrases(rows, most)
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(len(q) > len(p) and b >= least and 100 * b >= ratio * a
                         and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(12)] + ["É", "über", "字"]
    shared = "Common Passage here\tand there"
    out = []
    for _ in range(n):
        w = [rng.choice(v[:rng.randint(2, len(v))]) + rng.choice(["", "", "", ".", ",", "!\n", "\x0b"]) for _ in range(rng.randint(0, 30))]
        out.append((rng.choice(["en", "de", None, "und"]), " ".join(w) + (f" {shared} {rng.choice(v)}" if rng.random() < 0.5 else "")))
    return out + [("en", None), ("en", ""), (None, " \t\n "), ("x\ty", "a b a b a b a b"), ("de", "a  b\t\ta b"), ("fr", "one two " * 400), ("fr", "A" * 5000)]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("most, least, ratio, top, bucket", [(5, 4, 100, 2000, 1 << 20), (5, 4, 100, 25, 40), (3, 7, 80, 2000, 10), (2, 3, 100, 5, 1 << 20)])
def test_equals_plain_counting(spark, most, least, ratio, top, bucket):
    """Small buckets make words and passages hot, so their suffixes are routed deeper."""
    rows = corpus()
    docs = spark.createDataFrame([(t, lang, "x", "y") for lang, t in rows], "text string, lang string, phrase string, f string").repartition(5)
    assert got(collocations.collocations(docs, most, least, ratio, top, bucket)) == model(rows, most, least, ratio, top)


def test_registered_query_on_odd_documents(spark, tmp_dir):
    data = cases.rows() * 40
    cases.frame(spark, data).write.parquet(f"{tmp_dir}/documents.parquet")
    want = model([(r[2], r[1]) for r in data], 5, 100, 100, 2000)
    assert got(collocations.op12_collocations(spark, tmp_dir)) == want and len(want) > 20


def test_empty_table(spark, tmp_dir):
    cases.empty(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    assert collocations.op12_collocations(spark, tmp_dir).collect() == []


def test_numbers_join_keeps_a_row_for_every_word(spark):
    """Rows of the join follow the words of the blocks, not how many of them are frequent; a block without any stays."""
    rows = spark.sparkContext.parallelize([("en", "a b a b. c"), ("de", "a x"), (None, "y z")], 3)
    docs = spark.createDataFrame(rows, "lang string, text string")
    blocks = collocations.word_blocks(docs)
    frequent = spark.createDataFrame([(4, "en", "a", 2), (5, "en", "b", 2)], "id long, lang string, word string, f long")
    found = []
    numbers = collocations._with_numbers(blocks, frequent)
    for r in numbers.collect():
        found += [int(i) for i in collocations.unpack(r["ids"], np.int64) if i]
    assert numbers.count() == blocks.count() and sorted(found) == [5, 5, 6, 6]


def test_multikey_quicksort_counts_prefixes():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 4, (5, 3000))
    for j in range(1, 5):
        w[j] = np.where(w[j - 1] == 0, 0, w[j])
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for i in range(3000):
        for n in range(1, 6):
            if w[n - 1, i]:
                want[tuple(w[:n, i])] += int(weight[i])
    found = {tuple(w[:n, i]): c for i, n, c in collocations.multikey_quicksort(w, weight, 30)}
    assert found == {p: c for p, c in want.items() if c >= 30}


@pytest.mark.parametrize("size", [16, 50, 1000])
def test_long_texts_are_cut_between_pieces(spark, size):
    texts = ["a b c. " * 30, "", "x" * 120, "one two, three four " * 9, "é ü. " * 40, "no break at all " * 12, "tail."]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    seen, at = Counter(), 0
    for a, b, bounds, rows in collocations.runs(data, offs, size):
        assert a == at and bounds[0] == a and bounds[-1] == b and len(bounds) == len(rows) + 1
        at = b
        vocabulary, word, first, _ = collocations.word_stream(data[a:b], bounds - a)
        w = [vocabulary[i].as_py() for i in word]
        for i in range(1, len(w)):
            if not first[i]:
                seen[w[i - 1], w[i]] += 1
    assert at == len(data)
    f, _ = phrases([("x", t) for t in texts], 2)
    assert seen == {p: c for p, c in f["x"].items() if len(p) == 2}
