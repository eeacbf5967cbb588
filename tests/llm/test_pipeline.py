"""The pipeline stage by stage against plain Python on a small corpus."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from seqlab.llm import langid
from tests.llm import cases
from tests.llm.test_ops import plain_components

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi"


def corpus(spark, path):
    data = cases.rows(n=300)
    data += [(50_000 + i, f"{cases.sentence(__import__('random').Random(i), 'en', 40)} {ITEM.upper()} end", "en", "s1", 9, *"xyzbkw") for i in range(3)]
    cases.frame(spark, data).drop("copy").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def plain_cut(rows):
    """Texts without the characters that a 50-byte string of a smaller id covers."""
    key = lambda i: math.inf if i is None else i
    first = {}
    for r in rows:
        b = (r["text"] or "").encode()
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], math.inf), key(r["doc_id"]))
    out = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = set()
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < key(r["doc_id"]):
                gone.update(range(s, s + 50))
        at, left = 0, []
        for ch in r["text"] or "":
            n = len(ch.encode())
            if not gone & set(range(at, at + n)):
                left.append(ch)
            at += n
        if left or not b:
            out.append((r["doc_id"], "".join(left)))
    return Counter(out)


def leaked(text):
    w, item = cases.word_list(text), cases.word_list(ITEM)
    for shift in range(-len(item), len(w)):
        same = [0 <= shift + k < len(w) and w[shift + k] == item[k] for k in range(len(item))]
        if any(0 <= shift + k and shift + k + 13 <= len(w) and sum(same[k:k + 13]) >= 11 for k in range(len(item) - 12)):
            return True
    return False


def test_every_stage_equals_plain_python(spark, tmp_dir):
    docs = corpus(spark, tmp_dir)
    cols = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "decontaminate", "mix_sources"]
    inputs, outputs = [], []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        path = f"{tmp_dir}/{k}"
        stage(spark, docs, tmp_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        outputs.append(docs.collect())
        assert docs.columns[:len(cols)] == cols and (k == 4 or docs.columns == cols)
    ids = [Counter(r["doc_id"] for r in rows) for rows in outputs]

    train = [r for r in inputs[0] if zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 != 2]
    coder = langid.Coder(langid.learn(spark.createDataFrame(train, "struct<" + ",".join(f"{c}:{t}" for c, t in spark.read.parquet(f"{tmp_dir}/documents.parquet").dtypes) + ">")))
    said = [coder.predict(r["text"]) for r in inputs[0]]
    assert ids[0] == Counter(r["doc_id"] for r, (p, s) in zip(inputs[0], said) if p != "und" and s >= langid.REJECT_MARGIN)

    want = plain_components([(r["doc_id"], r["text"]) for r in inputs[1]], 5)
    assert ids[1] == Counter(r["doc_id"] for r in inputs[1] if r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])
    assert len(outputs[1]) < len(inputs[1])

    assert Counter((r["doc_id"], r["text"]) for r in outputs[2]) == plain_cut(inputs[2])
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[2]) and any(len(r["text"]) < 60 for r in outputs[2])

    assert ids[3] == Counter(r["doc_id"] for r in inputs[3] if not leaked(r["text"]))
    assert sum(leaked(r["text"]) for r in inputs[3]) >= 1

    size, taken = defaultdict(int), defaultdict(int)
    for r in inputs[4]:
        size[r["source"]] += len(cases.word_list(r["text"]))
    for r in outputs[4]:
        taken[r["source"]] += r["mix_words"]
        assert len(cases.word_list(r["text"])) == r["mix_words"]
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * size[s] for s in size)


def test_run_gives_the_last_stage(spark, tmp_dir):
    corpus(spark, tmp_dir)
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, tmp_dir).collect()), key=repr) for _ in range(2))
    assert a == b and a


def test_pipeline_of_an_empty_table(spark, tmp_dir):
    cases.empty(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).collect() == []
