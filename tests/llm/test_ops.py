import hashlib
import itertools
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqlab.llm import chat, decontaminate, fingerprint, fixity, langid, lmscore, mixing, neardup, passages, tokencount
from seqlab.llm.common import components
from tests.llm import cases


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


# ---------------------------------------------------------------- 1 language model

@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score_equals_a_plain_model(spark, order):
    data = cases.rows()
    got = lmscore.score(cases.frame(spark), order=order, mu=20.0).collect()
    assert len(got) == len(data)
    counts, n_docs = [Counter() for _ in range(order)], 0
    texts = [(r[0], cases.word_list(r[1]) + [None]) for r in data]
    fold = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in texts}
    for i, w in texts:
        if not fold[i]:
            n_docs += 1
            for k in range(len(w)):
                for o in range(order):
                    if k - o >= -1:
                        counts[o][tuple((["<s>"] + w)[k + 1 - o:k + 2])] += 1
    uni = counts[0]
    n, v = sum(uni.values()), len(uni)
    n1, n2 = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2)))

    def p(h, w):
        if not h:
            return (uni[w,] - d) / n if (w,) in uni else d * v / n
        c = n_docs if h == ("<s>",) else counts[len(h) - 1][h]
        return (counts[len(h)][(*h, w)] + 20.0 * p(h[1:], w)) / (c + 20.0)

    want = defaultdict(list)
    for i, w in texts:
        s = sum(math.log10(p(tuple((["<s>"] + w)[max(0, k + 2 - order):k + 1]), w[k])) for k in range(len(w)))
        base = sum(math.log10((uni[x,] + 1) / (n + v + 1)) for x in w)
        want[i].append((len(w), sum((x,) in uni for x in w), round(base, 6), round(s, 6)))
    for i, own in by_id(got).items():
        assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in own) == sorted(want[i])
        assert all(r["train_tokens"] == n and r["held_out"] == fold[i] for r in own)


def test_lm_pieces_of_a_long_text_do_not_change_its_score():
    data = np.frombuffer(" ".join(["a b c a b d"] * 300).encode(), np.uint8)
    grams = lmscore.Grams(data, np.array([0, len(data)]), 3)
    counts = grams.counts(np.array([True]))
    model = lmscore.Automaton(grams, counts, {"docs": 1, "tokens": len(grams.tok), "types": 5, "once": 1, "twice": 0}, 5.0)
    whole = model.score(grams.of[0], grams.at, piece=10 ** 6)
    assert np.allclose(whole, model.score(grams.of[0], grams.at, piece=7))


def test_lm_registered_query_reads_two_words_of_context(spark, tmp_dir):
    cases.frame(spark).select("doc_id", "text").write.parquet(f"{tmp_dir}/documents.parquet")
    got = by_id(lmscore.op1_lm_score(spark, tmp_dir).collect())
    scores = lambda rows: {i: sorted(round(r["score"], 6) for r in own) for i, own in rows.items()}
    assert scores(got) == scores(by_id(lmscore.score(cases.frame(spark), order=3).collect()))
    assert scores(got) != scores(by_id(lmscore.score(cases.frame(spark), order=2).collect()))


def test_lm_keys_alone_are_the_keys():
    data = np.frombuffer(b"a b a b c" * 50 + b"d" * 9 + b" x y", np.uint8)
    offs = np.array([0, 0, 120, len(data)])
    for a, b in zip(lmscore.Grams(data, offs, 3).keys, lmscore.Grams(data, offs, 3, places=False).keys):
        assert a.tolist() == b.tolist()
    assert [len(k) for k in lmscore.Grams(data[:0], np.array([0]), 3, places=False).keys] == [0, 0, 0]


@pytest.mark.parametrize("bits", [1, 9, 64])
def test_lm_marks_decide_only_what_is_exchanged(spark, monkeypatch, bits):
    """Many blocks; marks of any length (chance meetings or none) give the same scores."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j * j + j) % 40}" for j in range(30))) for i in range(120)],
                                 "doc_id long, text string").repartition(7, "doc_id")
    want = {r["doc_id"]: r for r in lmscore.score(docs.coalesce(1)).collect()}
    monkeypatch.setattr(lmscore, "mark_bits", lambda raw: bits)
    got = lmscore.score(docs).collect()
    assert len(got) == 120
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w["n_tokens"], w["n_known"], w["train_tokens"])
        assert math.isclose(r["score"], w["score"], rel_tol=1e-9) and math.isclose(r["base_score"], w["base_score"], rel_tol=1e-9)


def test_lm_empty(spark):
    assert lmscore.score(cases.empty(spark)).collect() == []


# ---------------------------------------------------------------- 2 fixity

def leaves(spark, rows):
    return spark.createDataFrame(rows, "offset long, length long, digest string")


def test_fixity_finds_changed_missing_and_extra_records(spark):
    a = [(i * 1000, 1000, f"d{i}") for i in range(5000)]
    b = list(a)
    b[17] = (17000, 1000, "other")
    b[4000] = (4000000, 10, "short")
    del b[2500]
    b.append((9_000_000, 5, "new"))
    got = {(r["offset"], r["status"], r["expected"], r["found"]) for r in fixity.audit(leaves(spark, a), leaves(spark, b)).collect()}
    assert got == {(17000, "changed", "d17", "other"), (4000000, "changed", "d4000", "short"),
                   (2500000, "missing", "d2500", None), (9_000_000, "extra", None, "new")}


def test_fixity_of_equal_and_empty_replicas(spark):
    a = leaves(spark, [(i * 10, 10, f"d{i}") for i in range(50)])
    none = leaves(spark, [])
    assert fixity.audit(a, a).collect() == []
    assert fixity.audit(none, none).collect() == []
    assert fixity.audit(a, none).count() == 50


def test_fixity_records_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "", "y"), (2, "ü", "é" * 10, "z")],
                                  "page_id long, url string, html string, digest string")
    rows = fixity.records(pages).collect()
    assert len(rows) == 4 and all(r["length"] > 0 and len(r["digest"]) == 64 for r in rows)


# ---------------------------------------------------------------- 3 passages

def test_passages_equal_brute_force(spark):
    data = cases.rows()
    got = passages.passages(cases.frame(spark), passages._digests,
                            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t, *_ in data:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s:s + 50]
            first[w] = min(first.get(w, math.inf), key(i))
    want = []
    for i, t, *_ in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < key(i):
                gone[s:s + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_suffix_sort_orders_by_bytes_and_survives_collisions():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    s = passages.Suffixes(data, 20)
    start = rng.integers(0, 2900, 700)
    group = rng.integers(0, 5, 700)
    text = lambda i: data[i:i + 20].tobytes()
    for misled in (False, True):
        if misled:                                                       # all hashes collide
            s.g[:] = 0
        order, same = s.sort(start, group)
        got = [(group[o], text(start[o])) for o in order]
        assert got == sorted((g, text(i)) for g, i in zip(group, start))
        assert same.tolist() == [False, *[a == b for a, b in zip(got, got[1:])]]


def test_passage_stage_keeps_columns_and_whole_characters(spark):
    out = passages.stage_passages(spark, cases.frame(spark), "").collect()
    assert out[0].asDict().keys() == set(cases.SCHEMA.names)
    assert all(r["n_chars"] == len(r["text"]) and "�" not in r["text"] for r in out)
    assert passages.stage_passages(spark, cases.empty(spark), "").collect() == []
    mask = np.zeros(7, bool)
    mask[2] = True
    assert passages.whole_characters(np.frombuffer("aéb字".encode(), np.uint8), mask).tolist() == [False, True, True, False, False, False, False]


# ---------------------------------------------------------------- 4 token counts

def test_token_counts_equal_direct_encoding(spark):
    encode = tokencount.encoder(tokencount.VOCABULARY)
    want = Counter((r[0], len(encode(r[1] or ""))) for r in cases.rows())
    for size in (3, 50, 1 << 16):
        blocks, manifest = tokencount.write_flat(cases.frame(spark), block_tokens=size)
        got = tokencount.scan(blocks).join(manifest, ["file", "ordinal"], "left").collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want and all(r["closed"] for r in got)


def test_token_scan_of_flat_files_on_disk(spark, tmp_dir):
    e = tokencount.SEPARATOR
    np.array([1, 2, e, e, 3, 4, 5, e, 9, 9], np.uint16).tofile(f"{tmp_dir}/a.bin")
    np.array([e], np.uint16).tofile(f"{tmp_dir}/b.bin")
    np.array([], np.uint16).tofile(f"{tmp_dir}/c.bin")
    for size in (2, 4, 6, 64):
        got = tokencount.scan(tokencount.flat_files(spark, tmp_dir, size)).collect()
        assert sorted((r["file"][-5:], r["ordinal"], r["n_tokens"], r["closed"]) for r in got) == [
            ("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 2, False), ("b.bin", 0, 0, True)]


def test_token_scan_of_one_long_file(spark, tmp_dir, monkeypatch):
    e, n = tokencount.SEPARATOR, (1 << 30) + 5                          # 2 GiB and 10 bytes, nearly all a hole
    at = [0, 7, 70_000_000, 70_000_001, 900_000_000, n - 2]
    with open(f"{tmp_dir}/long file.bin", "wb") as f:
        f.truncate(2 * n)
        for i in at:
            f.seek(2 * i)
            f.write(np.array([e], np.uint16).tobytes())
    monkeypatch.setattr(tokencount, "SPAN_BLOCKS", 3)                   # states pass between spans
    got = sorted(tuple(r)[1:] for r in tokencount.scan(tokencount.flat_files(spark, tmp_dir, 1 << 24)).collect())
    assert got == [(k, b - a - 1, True) for k, (a, b) in enumerate(zip([-1, *at], at))] + [(6, 1, False)]


def test_token_counts_empty(spark):
    blocks, _ = tokencount.write_flat(cases.empty(spark))
    assert tokencount.scan(blocks).collect() == []


# ---------------------------------------------------------------- 5 decontamination

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi"


def overlapping(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    left = {r["doc_id"] for r in decontaminate.without_contaminated(d, b).collect()}
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d, b).collect()}, left


def test_masks_meet_every_pair_of_substitutions():
    span = decontaminate.SPAN
    for i in range(span):
        for j in range(i):
            assert any(i not in m and j not in m for m in decontaminate.masks())


def test_contaminated_documents_are_found_and_clean_ones_left(spark):
    w = ITEM.split()
    two = list(w[:13])
    two[3] = two[8] = "x"
    three = list(two)
    three[11] = "x"
    docs = [(1, "start " + ITEM.upper() + " end"), (2, "a b " + " ".join(two) + " c"), (3, "a b " + " ".join(three) + " c"),
            (4, None), (5, ""), (6, " ".join(w[:6])), (7, "one two three four five six"), (8, "one two three four FIVE"),
            (None, ITEM), (1, "start " + ITEM.upper() + " end"), (9, " ".join(["one"] * 5000)), (10, "go now")]
    items = [(100, ITEM), (101, "one two three four five"), (102, None), (103, ""), (104, ITEM), (105, "go now")]
    got, left = overlapping(spark, [(*d, "s", "t") for d in docs], items)
    assert set(got) == {(d, i) for d in (1, 2, None) for i in (100, 104)} | {(7, 101), (8, 101)}
    assert left == {3, 4, 5, 6, 9, 10}
    r = got[1, 100]
    assert (r["first_word"], r["n_words"], r["n_equal"], r["item_words"]) == (1, 16, 16, 16)
    assert got[2, 100]["n_equal"] == 11


def test_short_items_allow_the_substitutions_of_their_length(spark):
    docs, items, want = [], [], set()
    for k in range(decontaminate.LEAST_WORDS, decontaminate.SPAN):
        item = [f"q{k}w{i}" for i in range(k)]
        items.append((k, " ".join(item)))
        for gone in itertools.combinations(range(k), k - math.ceil(0.8 * k)):
            want.add((len(docs), k))
            docs.append(" ".join(["pre", *(f"{w}," if i in gone else w for i, w in enumerate(item)), "post"]))
        docs.append(" ".join(["pre", *(f"{w}," if i <= k - math.ceil(0.8 * k) else w for i, w in enumerate(item)), "post"]))
    got, left = overlapping(spark, [(i, t, "s", "t") for i, t in enumerate(docs)], items)
    assert set(got) == want and left == set(range(len(docs))) - {d for d, _ in want}
    assert all((r["n_words"], r["n_equal"]) == (k, math.ceil(0.8 * k)) for (_, k), r in got.items())


def test_benchmark_in_several_blocks_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 20))) for i in range(40)]
    docs = [(i, f"pre {items[i][1]} post", "s", "t") for i in range(0, 40, 3)]
    one = overlapping(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 150)
    many = overlapping(spark, docs, items)
    assert set(one[0]) == set(many[0]) == {(i, i) for i in range(0, 40, 3)} and one[1] == many[1] == set()


def test_decontaminate_empty(spark):
    assert overlapping(spark, [], [(1, ITEM)]) == ({}, set())
    assert overlapping(spark, [(1, ITEM, "s", "t")], [])[1] == {1}


def aligned(text, item, least):
    """(first word, words, equal words, item's words) of the widest agreement, by laying
    the two side by side in every way."""
    a, b = cases.word_list(text), cases.word_list(item)
    width, best = min(13, len(b)), None
    if len(b) < max(1, least):
        return None
    for shift in range(-len(b) + 1, len(a)):
        same = [(p, a[p] == b[p - shift]) for p in range(max(0, shift), min(len(a), shift + len(b)))]
        good = [k for k in range(len(same) - width + 1) if 5 * sum(e for _, e in same[k:k + width]) >= 4 * width]
        if good:
            run = same[good[0]:good[-1] + width]
            best = max(best or (0, 0), (len(run), -run[0][0], sum(e for _, e in run)))
    return best and (-best[1], best[0], best[2], len(b))


@pytest.mark.parametrize("least", [1, 5])
def test_overlaps_equal_the_alignment_of_every_pair(spark, least):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([1, 2, 3, 4, 5, 8, 12, 13, 20, 40, 60])]
    items += [(20, "la " * 30), (21, "la lo " * 12), (22, None), (23, ""), (24, items[8][1])]
    docs = [(0, None), (1, ""), (2, "la " * 200), (3, "lo la " * 50), (4, "x " * 10 + "la " * 14)]
    for k in range(60):
        w = rng.choice(vocabulary, 50).tolist()
        part = (items[rng.integers(4, 11)][1] or "").split()
        for p in rng.integers(0, len(part), rng.integers(0, 4)):
            part[p] = "changed"
        docs.append((5 + k, " ".join(w[:20] + part + w[20:]).upper()))
    want = {(d, i, *hit) for d, t in docs for i, b in items if t and b and (hit := aligned(t, b, least))}
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                     spark.createDataFrame(items, "item_id long, text string"), least).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 40


def test_repeats_on_both_sides_need_little_memory():
    index = decontaminate.Index([(0, "la " * 2000)])
    h, at = lmscore.words(np.frombuffer(b"la " * 20000, np.uint8), np.array([0, 60000]))
    tracemalloc.start()
    found = max((n, -first, equal) for _, _, first, n, equal, _ in index.overlaps(h, at))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == (2000, 0, 2000) and peak < 100 << 20


# ---------------------------------------------------------------- 6 fingerprints

def plain_sketch(text, k=fingerprint.K):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]

    def h(b, seed):
        return xxhash.xxh64_intdigest(b, seed)

    def long_bytes(x):
        return x.to_bytes(8, "little")

    hs = [h(x.encode(), 42) for x in w]

    def fold(xs):
        s = 42
        for x in xs:
            s = h(long_bytes(x), s)
        return s >> 16

    n = fingerprint.SHINGLE
    all_ = {fold(hs[i:i + n]) for i in range(len(hs) - n + 1)} if len(hs) >= n else ({fold(hs)} if hs else set())
    return sorted(all_)[:k]


def test_fingerprints_equal_a_plain_sketch(spark):
    data = cases.rows()
    got = by_id(fingerprint.with_next(cases.frame(spark), {"sketch": fingerprint.sketch(F.col("text"))}).collect())
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    for r, nxt in zip(order, order[1:] + order[:1]):
        own = [g for g in got[r[0]] if g["text"] == (r[1] or "")]
        assert any(g["sketch"] == plain_sketch(r[1]) and g["next_text"] == (nxt[1] or "") and g["next_sketch"] == plain_sketch(nxt[1]) for g in own)
    assert sum(map(len, got.values())) == len(data)


def test_neighbours_across_blocks(spark):
    ids = [0, 1, 1023, 1024, 5000, 5001, 10 ** 12, -3]
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(d, {}).collect()}
    want = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(want, want[1:] + want[:1])}


def test_estimates_and_merge(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    a, b = words[:3000], words[1000:]
    s = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(
        fingerprint.sketch(F.col("a"), 256).alias("a"), fingerprint.sketch(F.col("b"), 256).alias("b"))
    r = s.select(fingerprint.resemblance(F.col("a"), F.col("b"), 256).alias("r"), fingerprint.containment(F.col("a"), F.col("b"), 256).alias("c"),
                 fingerprint.distinct_count(F.col("a"), 256).alias("n"), fingerprint.merge(F.col("a"), F.col("b"), 256).alias("m")).first()
    assert abs(r["r"] - 0.5) < 0.12 and abs(r["c"] - 2 / 3) < 0.15 and abs(r["n"] / 2996 - 1) < 0.25
    parts = s.select(F.lit(1).alias("k"), F.explode(F.array("a", "b")).alias("sketch"))
    assert fingerprint.merged(parts, ["k"], k=256).first()["sketch"] == r["m"]
    del rng


def test_fingerprint_empty(spark):
    assert fingerprint.with_next(cases.empty(spark), {"sketch": fingerprint.sketch(F.col("text"))}).collect() == []


# ---------------------------------------------------------------- 7 language ID

def test_language_id(spark):
    data = cases.rows(n=400)
    df = cases.frame(spark, data)
    d = langid.learn(df.filter("lang is not null"))
    assert [x for x, _ in d] == ["de", "en", "fr"]
    got = by_id(langid.classify(df.select("doc_id", "text", "lang", "score"), d).collect())
    long = [g for own in got.values() for g in own if g["lang"] and g["text"] and len(g["text"]) > 120]
    # some texts hold a passage in another language than their own
    assert len(long) > 100 and np.mean([g["_lid"]["lang_pred"] == g["lang"] for g in long]) > 0.9
    for i in (11000, 11001, 11002, 11003):
        assert got[i][0]["_lid"].asDict() == {"lang_pred": "und", "score": 0.0, "rejected": True}
    assert all(0 <= g["_lid"]["score"] <= 1 for own in got.values() for g in own)
    kept = langid.stage_language(spark, df, "")
    clean = {g["doc_id"] for g in long if not g["_lid"]["rejected"]}
    assert kept.columns == df.columns and len(clean & {r["doc_id"] for r in kept.collect()}) > 0.97 * len(clean)


def test_language_id_without_labels(spark):
    assert langid.learn(cases.empty(spark)) == []
    assert langid.classify(cases.empty(spark), []).collect() == []
    assert {r["_lid"]["lang_pred"] for r in langid.classify(cases.frame(spark), []).collect()} == {"und"}


# ---------------------------------------------------------------- 8 near duplicates

def plain_components(data, k):
    ids = {r[0] for r in data if r[0] is not None}
    sets = [(r[0], cases.shingle_set(r[1], k)) for r in data if r[0] is not None]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            n = len(s & t)
            if n and 100 * n >= 80 * (len(s) + len(t) - n):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    data = cases.rows(n=120)
    got = neardup.near_duplicates(cases.frame(spark, data), k).collect()
    want = plain_components(data, k)
    assert len(got) == len(data) and len(set(want.values())) < len(want)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])


def test_chains_and_families_are_decided(spark, monkeypatch):
    """A family of drifting copies: neighbours are alike, ends are not, and members
    hang on others than their bucket's least one."""
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 7)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(60):
        if i % 3 == 0:
            base = list(base)
            base[int(rng.integers(60))] = f"n{i}"
        own = list(base)
        own[int(rng.integers(60))] = f"m{i}"
        own[int(rng.integers(60))] = f"k{i}"
        data.append((int(rng.permutation(10 ** 6)[0]) * 100 + i, " ".join(own), "en", "s", 1, *"xyzbkw"))
    got = neardup.near_duplicates(cases.frame(spark, data), 2).collect()
    want = plain_components(data, 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 1 < len(set(want.values())) < 60


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    u = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    s = np.concatenate((u[:2000], u[1000:]))
    regs = neardup.registers(s, np.array([0, 2000, 4000]))
    assert abs(neardup.estimate(regs[0].tobytes(), regs[1].tobytes(), 2000, 2000) - 1 / 3) < 0.12
    v = np.array([1, 2, 3, 2 ** 63, 2 ** 64 - 1, (1 << 53) - 1], np.uint64)
    assert [int(x) >> 10 for x in neardup.compress(v)] == [63, 62, 62, 0, 0, 11]
    assert 0 < neardup._by_chance(5, 5) < 0.001


def test_near_duplicates_empty_and_stage(spark):
    assert neardup.near_duplicates(cases.empty(spark)).collect() == []
    out = neardup.stage_near_duplicates(spark, cases.frame(spark), "")
    want = plain_components(cases.rows(), 5)
    assert out.columns == cases.SCHEMA.names
    assert {r["doc_id"] for r in out.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (500, 500)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- 9 chat windows

def turns():
    odd = "<|turn|>user<|text|> <~| [~I </s></s> [INST] [~~/ <"
    return [(1, 0, "system", "be brief"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, None, "assistant", "last"),
            (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "no id"), (3, 0, None, "who"), (4, 0, "system", "alone"),
            (5, 0, "user", "w " * 900), (5, 1, "assistant", "done"), (5, 2, "system", "late")] + [
            (6, i, ["system", "user", "assistant"][min(i, 1 + i % 2)] if i else "system", f"turn {i} " + "word " * (i % 37)) for i in range(200)]


def test_chat_windows_round_trip_and_budget(spark):
    data = turns()
    t = spark.createDataFrame([(*r, "z") for r in data], "conv_id long, turn long, role string, text string, window string")
    w = chat.windows(t)
    rows = w.collect()
    back = defaultdict(list)
    for r in chat.read_back(w).orderBy("window").collect():
        back[r["conv_id"]].append(r)
    key = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == conv), key=key)
        assert [(x["role"], x["text"]) for r in back[conv] for x in r["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert [x for r in back[conv] for x in r["targets"]] == [r[3] or "" for r in own if r[2] == "assistant"]
    assert all(r["tokens"] <= chat.BUDGET or r["oversize"] for r in rows) and sum(r["oversize"] for r in rows) == 1
    long = [r for r in rows if r["conv_id"] == 6]
    assert len(long) > 5 and all(r["formatted"].startswith("<|turn|>system<|text|>turn 0 </s>") for r in long)
    assert any(r["repeated"] == 3 for r in long) and all(r["repeated"] <= 3 for r in long)


def test_chat_empty(spark):
    assert chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


# ---------------------------------------------------------------- 10 mixing

def test_mixture(spark):
    data = cases.rows()
    got = mixing.mixture(cases.frame(spark)).collect()
    again = mixing.mixture(cases.frame(spark).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    size = defaultdict(int)
    for r in data:
        size[r[3]] += len(cases.word_list(r[1]))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken, source = defaultdict(int), {r[0]: r[3] for r in data}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        assert (r["mix_start"] is None) == (r["taken"] == 0)
        taken[s] += r["taken"]
    assert len(got) == len(data) and all(abs(taken[s] - target[s]) <= 0.5 for s in names)


def test_mix_stage_emits_what_it_takes(spark):
    df = cases.frame(spark)
    out = mixing.stage_mix(spark, df, "")
    assert out.columns == [*df.columns, "copy_", "mix_start", "mix_words"]
    rows = out.collect()
    want = mixing.mixture(df).collect()
    assert sum(r["mix_words"] for r in rows) == sum(r["taken"] for r in want)
    assert all(len(cases.word_list(r["text"])) == r["mix_words"] for r in rows)
    at = 0
    for r in sorted(rows, key=lambda r: r["mix_start"]):                 # the mix has no gap
        assert r["mix_start"] == at
        at += r["mix_words"]


def test_mix_empty(spark):
    assert mixing.mixture(cases.empty(spark)).collect() == []
    assert mixing.stage_mix(spark, cases.empty(spark), "").collect() == []
