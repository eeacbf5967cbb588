"""Many languages, null ids, order of rows; columns that stages use themselves; op6 as registered."""

import hashlib
import random

import pytest
import zstandard as zs
from pyspark.sql import functions as F

import corpus_pipeline
from seqlab.llm import fingerprint, langid
from tests.llm import cases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_gone", "_key", "_words", "_row", "_copy", "_copyh", "_copym", "_lid", "_nth", "_of"]


def tongues(n, per=4, seed=9):
    """Texts of n made-up languages, each with syllables of its own."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)]
        for _ in range(per):
            text = " ".join("".join(rng.choice(own) for _ in range(2)) for _ in range(40))
            out.append((len(out), text, f"l{k:03d}", "s", len(text)))
    return out


def plain_sizes(dictionary, text):
    """Encoded size of a text, written without the library's coder."""
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    total = 0
    for i in range(0, len(raw), 4096):
        piece = raw[i:i + 4096]
        strong = len(piece) < 512
        params = zs.ZstdCompressionParameters(
            window_log=18, chain_log=17 if strong else 16, hash_log=17, search_log=5 if strong else 3, min_match=4, target_length=48 if strong else 0,
            strategy=zs.STRATEGY_BTLAZY2 if strong else zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        total += len(zs.ZstdCompressor(compression_params=params, dict_data=d).compress((dictionary[-256:] if strong else b"") + piece))
    return total


@pytest.mark.parametrize("at_once", [7, 64])
def test_every_language_is_learned_and_blocks_change_nothing(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", at_once)
    rows = tongues(30)
    learned = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert [lang for lang, _ in learned] == [f"l{k:03d}" for k in range(30)]
    asked = rows[::9]
    got = {r["doc_id"]: r["_lid"] for r in langid.classify(spark.createDataFrame(asked, SCHEMA), learned).collect()}
    for i, text, lang, *_ in asked:
        sizes = sorted((plain_sizes(d, text), own) for own, d in learned)
        assert got[i]["lang_pred"] == sizes[0][1] == lang
        assert got[i]["score"] == (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def test_three_hundred_languages(spark):
    learned = langid.learn(spark.createDataFrame(tongues(300, per=1), SCHEMA))
    assert len(learned) == 300


def test_rows_without_id_are_learned_and_order_does_not_matter(spark):
    rng = random.Random(4)
    rows = [(None, cases.sentence(rng, "de", 12), "de", "s", 0) for _ in range(7000)]
    rows += [(i, cases.sentence(rng, "fr", 12), "fr", "s", 0) for i in range(600)]
    rows += [(i + 9000, rows[7000 + i % 50][1], "fr", "s", 0) for i in range(600)]      # copies under other ids
    rows += [(1, "x", "one", "s", 1)]
    first = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert [lang for lang, _ in first] == ["de", "fr", "one"] and len(first[0][1]) > 10000
    rng.shuffle(rows)
    assert langid.learn(spark.createDataFrame(rows, SCHEMA).repartition(5)) == first


@pytest.mark.parametrize("k", range(5))
def test_columns_of_the_user_survive_every_stage(spark, tmp_dir, k):
    spark.createDataFrame([(1, cases.sentence(random.Random(1), "en", 30))], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    df = cases.frame(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    df = df.withColumns({c: F.concat(F.lit(f"{c}/"), F.col("doc_id").cast("string")) for c in CLASHING})
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, df, tmp_dir)
    assert out.columns[:len(df.columns)] == df.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}/{r['doc_id']}" for r in rows for c in CLASHING)
    plain = stage(spark, df.drop(*CLASHING), tmp_dir).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in plain)


def shown(sketch_a, sketch_b):
    return 0.0 <= sketch_a <= 1.0 and 0.0 <= sketch_b <= 1.0


def test_registered_fingerprints(spark, tmp_dir):
    texts = {1: "aé" * 30, 5: None, 6: "", 8: "🙂 one two three four five six seven", 9: "🙂 one two three four five six seven", 12: "z"}
    spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fingerprint string").repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.op6_fingerprint(spark, tmp_dir).collect()}
    ids = sorted(texts)
    edited = {}
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, u = texts[i] or "", texts[nxt] or ""
        m = len(t) // 4
        edited[i] = (t[:len(t) - m] + u[:m])
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        assert shown(got[i]["near_edited"], got[i]["near_next"])
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[8]["near_next"] == 1.0
    assert got[5]["fingerprint"] == got[6]["fingerprint"]
    # the fingerprint of an edited text is that of a document with the text
    spark.createDataFrame([(i, t, "x") for i, t in edited.items()], "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_dir}/e/documents.parquet")
    again = {r["doc_id"]: r["fingerprint"] for r in fingerprint.op6_fingerprint(spark, f"{tmp_dir}/e").collect()}
    assert again == {i: r["edited_fingerprint"] for i, r in got.items()}


def test_registered_fingerprint_of_the_only_document(spark, tmp_dir):
    spark.createDataFrame([(3, "one two three four five six")], "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    r = fingerprint.op6_fingerprint(spark, tmp_dir).first()
    t = "one two three four five six"
    assert r["edited_sha256"] == hashlib.sha256((t[:-(len(t) // 4)] + t[:len(t) // 4]).encode()).hexdigest() and r["near_next"] == 1.0


def test_long_runs_of_blanks_do_not_change_the_ids():
    import base64

    import tiktoken

    from seqlab.llm import tokencount
    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("flat", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    encode = tokencount.encoder(tokencount.VOCABULARY)
    rng = random.Random(3)
    for blanks in (" ", "\n", " \n\t", "　 ", "\xa0", "\x85\r"):
        for n in (9999, 10000, 10001, 30000):
            run = "".join(rng.choice(blanks) for _ in range(n))
            for text in (run, f"a{run}", f"{run}b", f"one two{run}three, 4{run}!", f"x{run}\x1cy", f"'s {run}'s"):
                assert encode(text) == whole(text)
    assert len(encode(" " * 1_000_000 + "end")) > 100       # the tokenizer alone ends the process here
