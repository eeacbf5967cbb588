"""Exact random split, order statistics, sorted files in parts, bounded ordered lists, the counted broadcast join."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqlab.operators import joins
from seqlab.operators.encode import exact_split, kth_smallest
from seqlab.operators.groups import ordered_chunks
from seqlab.sinks.text import part_manifest, read_sorted_lines, write_lines


@pytest.mark.parametrize("bits", [5, 12, 13, 60])
def test_kth_smallest_equals_sorting(spark, bits):
    rng = random.Random(bits)
    values = [rng.randrange(1 << bits) for _ in range(200)] + [rng.randrange(1 << min(bits, 3)) for _ in range(100)] + [0, (1 << bits) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    ordered = sorted(values)
    for k in (1, 2, 57, 150, len(values)):
        value, taken, equal = kth_smallest(df, "v", k, bits)
        assert value == ordered[k - 1] and equal == values.count(value) and taken == k - sum(v < value for v in values)


def test_split_is_exact_with_repeated_and_missing_keys(spark):
    keys = list(range(40)) + [7] * 30 + [None] * 30
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "id long, i long").repartition(4)
    for percent, n in ((70, 70), (0, 0), (100, 100), (33, 33), (1, 1)):
        rows = exact_split(df, "id", percent, seed=3).collect()
        assert len(rows) == 100 and sum(r["is_train"] for r in rows) == n
    h = lambda k: int(hashlib.md5(f"3/{'' if k is None else k}".encode()).hexdigest()[:15], 16)
    rows = exact_split(df, "id", 70, seed=3).collect()
    assert max(h(r["id"]) for r in rows if r["is_train"]) <= min(h(r["id"]) for r in rows if not r["is_train"])
    other = exact_split(df.limit(40), "id", 70, seed=4)
    assert other.where("is_train").count() == 28
    assert exact_split(df.limit(0), "id").collect() == []


def test_parts_read_as_one_sorted_file(spark, tmp_dir):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé字") for _ in range(rng.randint(0, 6))) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    write_lines(df, F.col("w"), f"{tmp_dir}/s", sort_by=["w"])
    df.repartitionByRange(6, "w").sortWithinPartitions("w").select("w").write.text(f"{tmp_dir}/many")
    for path in (f"{tmp_dir}/s", f"{tmp_dir}/many"):
        rows = sorted(read_sorted_lines(spark, path).collect())
        ordered = sorted(words, key=lambda w: w.encode())
        assert [r["line"] for r in rows] == ordered and [r["line_no"] for r in rows] == list(range(500))
        text = "".join(w + "\n" for w in ordered).encode()
        assert all(text[r["first_byte"]:].startswith(r["line"].encode() + b"\n") for r in rows)
    parts = part_manifest(spark, f"{tmp_dir}/many").orderBy("part").collect()
    assert len(parts) > 1 and sum(p["n_bytes"] for p in parts) == len(text)
    for p, q in zip(parts, parts[1:]):
        assert q["first_line"] == p["first_line"] + p["n_lines"] and q["first_byte"] == p["first_byte"] + p["n_bytes"]


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_lists_of_bounded_length_join_to_the_order(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1, 2, 3]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, i int").repartition(5)
    got = defaultdict(dict)
    for r in ordered_chunks(df, ["k"], ["t"], ["i", "t"], chunk_rows=7, block_rows=block).collect():
        got[r["k"]][r["chunk"]] = [tuple(x) for x in r["rows"]]
    assert got.keys() == {"hot", "a", None}
    for k, chunks in got.items():
        assert sorted(chunks) == list(range(len(chunks)))
        assert all(len(chunks[c]) == 7 for c in range(len(chunks) - 1)) and 1 <= len(chunks[len(chunks) - 1]) <= 7
        want = sorted(((i, t) for key, t, i in rows if key == k), key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
        assert [x for c in range(len(chunks)) for x in chunks[c]] == want


def test_broadcast_join_only_for_counted_small_sides(spark, monkeypatch):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice("ab"), i, rng.randint(0, 500)) for i in range(60)], "k string, i int, s int").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(rng.choice("abc"), rng.randint(0, 500)) for _ in range(40)], "rk string, rs int").withColumn("rt", F.timestamp_seconds("rs"))

    def run(strategy):
        return joins.nearest_join(left, right, left_keys=["k"], right_keys=["rk"], left_ts="t", right_ts="rt", right_cols=["rs"], strategy=strategy)

    def broadcasts(df):
        return "BroadcastHashJoin LeftOuter" in df._jdf.queryExecution().executedPlan().toString().replace("\n", " ") or \
            "__cands" in df._jdf.queryExecution().analyzed().toString()
    rows = sorted(run("scan").collect())
    auto = run("auto")
    assert broadcasts(auto) and sorted(auto.collect()) == rows
    for name, bound in (("BROADCAST_ROWS", 39), ("BROADCAST_KEY_ROWS", 3)):
        with monkeypatch.context() as m:
            m.setattr(joins, name, bound)
            auto = run("auto")
            assert not broadcasts(auto) and sorted(auto.collect()) == rows
    none = joins.nearest_join(left, right.limit(0), left_keys=["k"], right_keys=["rk"], left_ts="t", right_ts="rt", right_cols=["rs"], strategy="auto")
    assert {r["rs"] for r in none.collect()} == {None}
