"""Golden cases of the joins, windows, filters, labels and formats."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seqlab.functions.address import header_user, parse_address
from seqlab.operators.features import encode_categories, filter_range, sliding_features
from seqlab.operators.groups import filter_min_group
from seqlab.operators.joins import nearest_join
from seqlab.operators.labels import combine_labels, label_dictionary, label_index, split_label
from seqlab.sinks.text import dataset_line, dictionary_line, libsvm_line


def T(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M:%S")


@pytest.mark.parametrize("strategy", ["broadcast", "scan"])
def test_nearest_join_golden(spark, strategy):
    left = spark.createDataFrame(
        [(1, "上海", T("2016-12-01 08:20:00")), (2, "上海", T("2016-12-01 08:20:00")),
         (3, "上海", T("2016-12-01 08:20:00")), (4, "上海", T("2016-12-01 08:20:00")),
         (5, None, T("2016-12-01 08:20:00"))], "sid int, city string, start timestamp")
    left = left.withColumn("day", F.to_date("start")).withColumn("case", F.col("sid"))
    w = [(1, "07:00:00"), (1, "08:00:00"), (1, "09:00:00"), (2, "08:00:00"), (2, "08:40:00"),
         (3, "08:20:00"), (3, "09:00:00")]
    right = spark.createDataFrame(
        [(c, "上海", T(f"2016-12-01 {t}"), t) for c, t in w] + [(4, "上海", T("2016-12-02 08:00:00"), "08:00:00")],
        "case int, city string, wts timestamp, wtime string")
    right = right.withColumn("wday", F.to_date("wts"))
    got = {}
    for case in (1, 2, 3, 4, 5):
        l = left.where(F.col("case") == case)
        r = right.where(F.col("case") == case)
        out = nearest_join(l, r, left_keys=["city", "day"], right_keys=["city", "wday"], left_ts="start",
                           right_ts="wts", right_cols=["wtime"], strategy=strategy).collect()
        assert len(out) == 1
        got[case] = out[0].wtime
    assert got == {1: "08:00:00", 2: "08:00:00", 3: "08:20:00", 4: None, 5: None}


def test_nearest_join_max_gap(spark):
    left = spark.createDataFrame([(1, "a", T("2024-01-01 10:00:00"))], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", T("2024-01-01 12:00:00"), 7)], "k string, rt timestamp, v int")
    for strategy in ("broadcast", "scan"):
        near = nearest_join(left, right, left_keys=["k"], right_keys=["k"], left_ts="t", right_ts="rt",
                            right_cols=["v"], strategy=strategy)
        assert near.first().v == 7
        capped = nearest_join(left, right, left_keys=["k"], right_keys=["k"], left_ts="t", right_ts="rt",
                              right_cols=["v"], strategy=strategy, max_gap_seconds=3600)
        assert capped.first().v is None


def _windows(spark, ids, order):
    df = spark.createDataFrame([("u", i, int(i.split("-")[1]), n) for n, i in enumerate(ids)],
                               "user string, sid string, seq int, n int")
    return sliding_features(df, "user", order, width=4, feature_cols=["n"], target_cols={"t": "sid"},
                            start_cols={"first": "sid"})


def test_sliding_lexical_and_natural_order(spark):
    ids = ["201612-1", "201612-2", "201612-9", "201612-10", "201612-11"]
    lex = sorted((r.first, r.t) for r in _windows(spark, ids, ["sid"]).collect())
    assert lex == [("201612-1", "201612-2"), ("201612-10", "201612-9")]
    nat = sorted((r.first, r.t) for r in _windows(spark, ids, ["seq"]).collect())
    assert nat == [("201612-1", "201612-10"), ("201612-2", "201612-11")]
    assert _windows(spark, ids[:3], ["sid"]).count() == 0
    assert _windows(spark, ids[:4], ["sid"]).count() == 1


def test_sliding_blocked_equals_plain(spark):
    rows = [(u, i, i * 10 + u) for u in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "u int, i int, v int").withColumn("b", F.floor(F.col("i") / 7))
    kw = dict(width=4, feature_cols=["v"], target_cols={"t": "v"}, start_cols={"i": "i"})
    a = sliding_features(df, "u", ["i"], block="b", bucket_rows=5, **kw)
    b = sliding_features(df, "u", ["i"], **kw)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 3 * 47


def test_range_filter_boundaries(spark):
    rows = [(24, 28, 26, 25, "10"), (23, 25, 25, 25, "1"), (25, 25, 25, 29, "1"), (25, 25, 25, 25, ""),
            (25, 25, 25, 25, None), (28, 24, 24, 24, "3")]
    df = spark.createDataFrame(rows, "t1 int, t2 int, t3 int, t int, w string")
    out = filter_range(df, ["t1", "t2", "t3", "t"], 24, 28, required=["w"])
    assert sorted(r.w for r in out.collect()) == ["10", "3"]


def test_bad_integer_fails_or_drops(spark):
    df = spark.createDataFrame([("25.0",), ("25",)], "t string")
    with pytest.raises(Exception, match="not an integer"):
        filter_range(df, ["t"], 24, 28).collect()
    assert filter_range(df, ["t"], 24, 28, on_bad="drop").count() == 1


def test_unknown_category_fails(spark):
    df = spark.createDataFrame([("low",), ("turbo",)], "speed string")
    with pytest.raises(Exception, match="unknown category"):
        encode_categories(df, {"speed": {"low": 2}}).collect()
    assert encode_categories(df, {"speed": {"low": 2}}, on_bad="null").where(F.col("speed").isNull()).count() == 1


def test_labels_round_trip_all_450(spark):
    df = spark.range(450).select(F.col("id").cast("int").alias("x"))
    parts = split_label("x")
    back = df.select("x", *parts).select("x", combine_labels(["temp", "speed", "direction", "mode"]).alias("y"))
    assert back.where(F.col("x") != F.col("y")).count() == 0
    codes = spark.createDataFrame([(0, 0, 0, 0), (4, 5, 2, 4), (1, 2, 1, 1)], "temp int, speed int, direction int, mode int")
    assert [r.l for r in codes.select(combine_labels(["temp", "speed", "direction", "mode"]).alias("l")).collect()] \
        == [0, 449, 126]
    idx = label_index(codes.select(combine_labels(["temp", "speed", "direction", "mode"]).alias("label")))
    d = {r.label: r.label_text for r in label_dictionary(idx).collect()}
    assert d[126] == "1,1,1,2" and d[449] == "4,4,2,5"
    line = label_dictionary(idx).select(dictionary_line("label_index", "label_text").alias("l")).collect()
    assert sorted(r.l for r in line)[0] == "0:{0,0,0,0}"


def test_formats(spark):
    df = spark.createDataFrame([(1, 2, 3, 7)], "a int, b int, c int, label int")
    r = df.select(dataset_line(["a", "b", "c"], "label").alias("d"), libsvm_line(["a", "b", "c"], "label").alias("s")).first()
    assert r.d == "1,2,3#7"
    assert r.s == "7 1:1 2:2 3:3"


def test_parse_address(spark):
    df = spark.createDataFrame([("ID:u1", "中国内蒙古包头"), ("ID:u2", "中国上海上海"), ("ID:u3", "None"),
                                ("ID:u4", "中国黑龙江哈尔滨")], "f0 string, addr string")
    p, c = parse_address("addr")
    got = [tuple(r) for r in df.select(header_user("f0"), p, c).collect()]
    assert got == [("u1", "内蒙古", "包头"), ("u2", "上海", "上海"), ("u3", None, None), ("u4", "黑龙江", "哈尔滨")]


def test_min_group_keeps_groups_over_k(spark):
    rows = [("a", i) for i in range(4)] + [("b", i) for i in range(3)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "u string, i int")
    out = filter_min_group(df, "u", k=3)
    got = sorted({(r.u, r.n_sessions) for r in out.collect()}, key=repr)
    assert got == sorted([("a", 4), (None, 5)], key=repr)


def test_nearest_join_equals_brute_force(spark):
    import random
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    left = [(i, rnd.choice(["a", "b", None]), base + dt.timedelta(minutes=rnd.randint(0, 300))) for i in range(80)]
    right = [(rnd.choice(["a", "b", "c"]), base + dt.timedelta(minutes=rnd.randint(0, 300)), rnd.randint(0, 3))
             for _ in range(60)]
    ldf = spark.createDataFrame(left, "id int, k string, t timestamp_ntz")
    rdf = spark.createDataFrame(right, "rk string, rt timestamp_ntz, v int")

    def brute(max_gap):
        out = {}
        for i, k, t in left:
            cands = [(abs((rt - t).total_seconds()), rt, v) for rk, rt, v in right if k is not None and rk == k]
            best = min(cands) if cands else None
            if best and max_gap is not None and best[0] > max_gap:
                best = None
            out[i] = (best[1], best[2]) if best else (None, None)
        return out

    plans = [dict(strategy="broadcast"), dict(strategy="scan"), dict(strategy="scan", block_unit="minute"),
             dict(strategy="scan", block_unit="auto", block_rows=3), dict(strategy="scan", block_unit=None)]
    for gap in (None, 1800):
        want = brute(gap)
        for plan in plans:
            got = nearest_join(ldf, rdf, left_keys=["k"], right_keys=["rk"], left_ts="t", right_ts="rt",
                               right_cols=["rt", "v"], max_gap_seconds=gap, **plan)
            assert {r.id: (r.rt, r.v) for r in got.collect()} == want, (plan, gap)


def test_sort_sessions_rank_equals_row_number(spark):
    import random
    from pyspark.sql import Window
    from seqlab.operators.groups import sort_sessions
    rnd = random.Random(4)
    rows = [(str(rnd.randint(1, 300)), f"2024-01-{rnd.randint(1, 28):02d} {rnd.randint(0, 23):02d}:{i % 60:02d}", i)
            for i in range(500)]
    df = spark.createDataFrame(rows, "u string, t string, i int")
    key = F.concat_ws(" ", "u", "t", F.lpad(F.col("i").cast("string"), 4, "0"))
    got = {r.i: r.pos for r in sort_sessions(df, key, rank_col="pos").collect()}
    want = {r.i: r.pos for r in df.withColumn("pos", F.row_number().over(Window.orderBy(key))).collect()}
    assert got == want


def test_sessionize_under_one_hot_user(spark):
    """A third of all events moved to one user: blocked and plain scans agree."""
    from seqlab.operators.sessionize import sessionize
    from seqlab.plans.events import event_kinds
    from seqlab.sources.tables import table
    ev = table(spark, "/root/testdata/sf0.01", "events")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    # Users above 50 rows are cut at equal depth: the hot user's scan spans many blocks.
    kinds = event_kinds(hot, target_rows=50)
    assert kinds.where(F.col("user_id") == 7).select("blk").distinct().count() > 30
    kw = dict(file_col="user_id", order_cols=["ts", "event_id"], kind_col="kind", time_col="ts",
              settings_cols=["event_type", "value"], header_cols=["signup_id"])
    a = sessionize(kinds, block_col="blk", **kw)
    b = sessionize(kinds, block_col=None, checkpoint_runs=False, **kw)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where(F.col("user_id") == 7).count() > 100
