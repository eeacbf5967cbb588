"""Heavy keys, bursts of one time and NULLs: the same rows at every block size."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.functions.codes import DIRECTION_CODES, MODE_CODES, SPEED_CODES
from seqlab.functions.scan import _cut_points, global_rank, running, with_order_blocks
from seqlab.operators.features import filter_range, sliding_features, strict_int
from seqlab.operators.joins import nearest_join
from seqlab.operators.labels import index_labels, label_index
from seqlab.operators.online import perceptron_keyed
from seqlab.operators.sessionize import sessionize
from seqlab.plans.logs import log_features
from seqlab.sources.logs import read_lines_ordered
from seqlab.streaming.jobs import parse_instances

T0 = dt.datetime(2024, 1, 1)
TARGETS = (2, 6, 40, 1_000_000)


def events(spark, n=400):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        burst = i % 3 == 0
        t = None if i % 23 == 0 else T0 + dt.timedelta(minutes=0 if burst else rnd.randint(0, 5000))
        rows.append((rnd.choice([None, 1, 1, 1, 1, 2, 3]), t, i, rnd.choice(["on", "on", "off", "header"]), float(i)))
    return spark.createDataFrame(rows, "u long, t timestamp_ntz, i long, kind string, v double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_blocks_are_even_and_follow_the_order(spark):
    ev = events(spark)
    out = with_order_blocks(ev, ["u"], ["t", "i"], 40).where("u = 1").orderBy(F.col("t").asc_nulls_first(), "i").collect()
    blocks = [r.blk for r in out]
    assert blocks == sorted(blocks) and None not in blocks
    sizes = [blocks.count(b) for b in set(blocks)]
    assert len(sizes) > 3 and max(sizes) <= 80
    assert with_order_blocks(ev, ["u"], ["t", "i"], 1000).where("blk is not null").count() == 0


def test_cut_points_of_a_key_are_few_and_even(spark):
    """A hot key's row has its cuts only, about one per block, and a key without a sample still is one block."""
    hot = spark.range(60_000).select(F.lit(None).cast("long").alias("u"), (F.col("id") * 7919 % 60_000).alias("t"))
    cuts = _cut_points(hot.union(spark.createDataFrame([(1, 5), (1, None)], hot.schema)), ["u"], ["t"], 2_000).collect()
    assert len(cuts) == 1 and cuts[0]["__hk0"] is None
    at = [c.t for c in cuts[0]["__cuts"]]
    assert at == sorted(at) and 20 <= len(at) <= 40
    assert max(b - a for a, b in zip([0, *at], [*at, 60_000])) < 4_000
    same = spark.range(10).select(F.lit(1).alias("u"), F.lit(7).alias("t"))
    for target in (2, 9):
        assert len({r.blk for r in with_order_blocks(same, ["u"], ["t"], target).collect()} - {None}) == 1


@pytest.mark.parametrize("target", TARGETS)
def test_next_values_of_a_key_take_one_pass(spark, target):
    """No frame reaches to the last row of its window: such a frame is computed anew from every row."""
    ev = events(spark).withColumn("f", F.when(F.col("kind") == "header", F.col("i")))
    b = with_order_blocks(ev, ["u"], ["t", "i"], target)
    out = running(b, ["u"], ["t", "i"], block="blk", firsts={"next": F.col("f")})
    assert not re.search(r"(?<!unboundedpreceding\$\(\)), unboundedfollowing", out._jdf.queryExecution().toString().lower())
    got = sorted(out.collect(), key=lambda r: (r.u is not None, r.u or 0, r.t is not None, r.t or T0, r.i))
    ahead, want = {}, []
    for r in reversed(got):
        ahead[r.u] = r.f if r.f is not None else ahead.get(r.u)
        want.append(ahead[r.u])
    assert [r.next for r in got] == want[::-1] and len(got) == 400


def test_running_and_windows_at_every_block_size(spark):
    ev = events(spark)
    sums, windows = [], []
    for target in TARGETS:
        b = with_order_blocks(ev, ["u"], ["t", "i"], target)
        sums.append(rows_of(running(b, ["u"], ["t", "i"], block="blk", sums={"s": F.col("v")}, prevs={"p": F.col("i")},
                                    lasts={"l": F.when(F.col("kind") == "header", F.col("i"))}).drop("blk")))
        windows.append(rows_of(sliding_features(b, "u", ["t", "i"], width=4, feature_cols=["v"], target_cols={"y": "v"},
                                                start_cols={"first": "i"}, block="blk", bucket_rows=8)))
    assert all(s == sums[0] for s in sums) and len(sums[0]) == 400
    assert all(w == windows[0] for w in windows) and len(windows[0]) == 400 - 4 * 3


def test_sessions_at_every_block_size(spark):
    ev = events(spark)
    got = [rows_of(sessionize(with_order_blocks(ev, ["u"], ["t", "i"], target), file_col="u", order_cols=["t", "i"],
                              kind_col="kind", time_col="t", settings_cols=["v"], block_col="blk")) for target in TARGETS]
    assert all(g == got[0] for g in got) and got[0]


def test_nearest_join_keeps_every_left_row(spark):
    ev = events(spark)
    left = ev.where("i % 2 = 0").select("u", "t", "i")
    right = ev.where("i % 2 = 1").select(F.col("u").alias("ru"), F.col("t").alias("rt"), F.col("v").alias("rv"))
    kw = dict(left_keys=["u"], right_keys=["ru"], left_ts="t", right_ts="rt", right_cols=["rt", "rv"])
    plans = [dict(strategy="broadcast"), dict(block_unit="minute"), dict(block_unit="day"), dict(block_unit=None),
             *[dict(block_rows=n) for n in TARGETS]]
    got = [rows_of(nearest_join(left, right, **kw, **p)) for p in plans]
    assert all(g == got[0] for g in got) and len(got[0]) == left.count()


def test_lexical_windows_follow_the_text_order(spark):
    ids = ["device-0", "device-1", "device(1)-0", "device(1)-1", "device(1)-2", "device 2-0"]
    rows = [("u", s, k, "a", "b", "c", str(k)) for k, s in enumerate(ids)]
    df = spark.createDataFrame(rows, "user string, session_id string, temp int, speed string, direction string, mode string, w_temp string")
    got = {r.session_id: (r.temp1, r.temp2, r.temp3, r.temp) for r in log_features(df).collect()}
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    assert got == {ids[order[j]]: tuple(order[j:j + 4]) for j in range(len(ids) - 3)}


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x long").repartition(5)
    assert all(r.x == r.rank for r in global_rank(df, "x").collect())
    assert global_rank(df.where("x < 0"), "x").collect() == []


def test_null_keys_and_labels_stay(spark):
    rows = [(None, 1, [1.0], 0), ("a", 1, [1.0], 1), (None, 2, [2.0], 1), ("b", 1, [0.5], 0)]
    df = spark.createDataFrame(rows, "k string, i int, x array<double>, y int")
    assert perceptron_keyed(df, "k", ["i"], "x", "y", 2, 1).count() == 4
    weights = perceptron_keyed(df, "k", ["i"], "x", "y", 2, 1, emit="weights").collect()
    assert sorted(r.k or "" for r in weights) == ["", "a", "b"]
    labels = spark.createDataFrame([(5,), (None,), (3,), (5,)], "label int")
    assert rows_of(index_labels(labels)) == rows_of(spark.createDataFrame([(5, 1), (None, None), (3, 0), (5, 1)], "label int, i int"))
    assert rows_of(label_index(labels)) == [(3, 0), (5, 1)]


def test_integers_with_sign_and_white_space(spark):
    df = spark.createDataFrame([(" 25 ",), ("+26",), ("-3",), ("25.0",), ("",), (None,)], "s string")
    assert [r.v for r in df.select(strict_int("s").alias("v")).collect()] == [25, 26, -3, None, None, None]
    assert filter_range(df.limit(2), ["s"], 24, 28).count() == 2


def test_bad_instance_lines(spark):
    lines = spark.createDataFrame([("1,2,0",), ("",), ("1,0",), ("1,x,0",), (None,)], "value string")
    assert [r.x for r in parse_instances(lines, 2, on_bad="drop").collect()] == [[1.0, 2.0]]
    with pytest.raises(Exception, match="not an instance line"):
        parse_instances(lines, 2).collect()


def test_missing_instance_line_is_named(spark):
    with pytest.raises(Exception, match="not an instance line: NULL"):
        parse_instances(spark.createDataFrame([(None,)], "value string"), 2).collect()


def test_line_ends_are_the_same_in_both_readers(spark, tmp_dir):
    with open(f"{tmp_dir}/1.txt", "wb") as f:
        f.write(b"a\r\n\r\nb\nc")
    a = [r.line for r in read_lines_ordered(spark, tmp_dir).orderBy("block", "pos").collect()]
    b = [r.line for r in read_lines_ordered(spark, tmp_dir, whole_files=True).orderBy("pos").collect()]
    assert a == b == ["a", "", "b", "c"]


def test_fixed_codes_are_spelled_out():
    """The oracles read the code tables of the engine; here they stand as fixed values."""
    assert list(SPEED_CODES.values()) == list(range(6)) and list(DIRECTION_CODES.values()) == list(range(3))
    assert list(MODE_CODES.values()) == list(range(5))
    assert np.prod([5, 6, 3, 5]) == 450
