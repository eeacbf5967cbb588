"""Small documents with every odd case, and plain re-computations to test against."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("score", T.StringType()), T.StructField("copy", T.StringType()), T.StructField("rep", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("words", T.StringType()),
])

PARTS = {
    "en": "the of and ing tion er th re on at en nd ha es".split(),
    "de": "der die und schen keit ein zu ge ver ü ung ich".split(),
    "fr": "le la de et eau ou è é ment tion ai ux".split(),
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed=5, n=60):
    rng = random.Random(seed)
    out, shared = [], sentence(rng, "en", 30)
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        text = sentence(rng, lang, rng.choice([1, 3, 8, 40, 120]))
        kind = i % 10
        if kind == 1 and out:
            text = out[-1][1]                                            # exact copy
        elif kind == 2 and i > 30:
            w = (out[-3][1] or "").split()                               # near copy
            if len(w) > 20:
                w[7] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = f"{text} {shared} {sentence(rng, lang, 5)}"            # shared passage
        elif kind == 4:
            text = ("ab" * 40 + "é") * 3 + text                          # repeats inside one text
        out.append((i * 7, text, lang, f"s{i % 4}", len(text)))
    out += [
        (11000, None, "en", None, None), (11001, "", "en", "s1", 0), (11002, " \t\n ", None, "s1", 4), (None, "no id here at all", "en", "s0", 17),
        (11003, "42 !! 7", "en", "s0", 7), (11004, "ÜBER straße İ 字 🙂 x", "de", "s2", 20), (11005, sentence(rng, "de", 6000), "de", "s3", 1),
        (11006, "</s>[INST] ok [/INST]", "en", "s3", 21), (out[5][0], *out[5][1:]), (11007, "one", "en", "s0", 3), (11008, "ONE", "en", "s0", 3),
    ]
    return [(*r, "x", "y", "z", "b", "k", "w") for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    return (text or "").encode().lower().split()


def shingle_set(text, k):
    w = word_list(text)
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
