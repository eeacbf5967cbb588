"""Sessionization: golden log, carry-over option, blocked scans vs a
row-by-row model of the state machine."""

import os
import random

from pyspark.sql import functions as F

from seqlab.functions.scan import running
from seqlab.operators.sessionize import filter_min_events, sessionize
from seqlab.plans.logs import log_sessions

GOLDEN = """ID:u1,中国黑龙江哈尔滨
/,d,poweron,low,auto,cool,26,25,2016-12-01 08:00
/,d,poweron,mid,auto,cool,26,26,2016-12-01 08:10
/,d,poweroff,mid,auto,cool,26,26,2016-12-01 08:30
/,d,poweron,high,vdir,heat,20,27,2016-12-01 20:00
ID:u2,None
/,d,poweroff,low,auto,cool,26,25,2016-12-02 09:00
/,d,poweroff,low,auto,cool,26,25,2016-12-02 09:05
/,d,poweron,low,auto,auto,26,24,2016-12-02 10:00
/,d,poweron,low,auto,auto,26,24,2016-12-02 10:05
/,d,poweroff,low,auto,auto,26,24,2016-12-02 11:00
/,d,poweron,low,auto,auto,26,24,2016-12-02 12:00

ID:u3,中国上海上海
/,d,poweron,low,auto,cool,26,25,2016-12-03 08:00
/,d,poweroff,low,auto,cool,26,25,2016-12-03 08:30
"""

EXPECTED = [
    ("u1", "201612-1", 2, "2016-12-01 08:00", "2016-12-01 08:10", "low", "auto", "cool", "26", "25", "黑龙江", "哈尔滨"),
    ("u1", "201612-2", 1, "2016-12-01 20:00", "2016-12-01 20:00", "high", "vdir", "heat", "20", "27", "黑龙江", "哈尔滨"),
    ("u2", "201612-3", 2, "2016-12-02 10:00", "2016-12-02 10:05", "low", "auto", "auto", "26", "24", None, None),
]


def _golden(tmp_dir):
    os.makedirs(f"{tmp_dir}/logs")
    with open(f"{tmp_dir}/logs/201612.csv", "w", encoding="utf-8") as f:
        f.write(GOLDEN)
    return f"{tmp_dir}/logs"


def test_golden_log(spark, tmp_dir):
    path = _golden(tmp_dir)
    got = sorted(tuple(r) for r in log_sessions(spark, path).collect())
    assert got == EXPECTED


def test_golden_log_without_carry_over(spark, tmp_dir):
    path = _golden(tmp_dir)
    got = sorted(tuple(r) for r in log_sessions(spark, path, carry_over=False).collect())
    assert got == [EXPECTED[0], EXPECTED[2]]


def test_min_events_drops_single_event_session(spark, tmp_dir):
    path = _golden(tmp_dir)
    got = sorted(r.session_id for r in filter_min_events(log_sessions(spark, path)).collect())
    assert got == ["201612-1", "201612-3"]


def test_whole_file_reader_numbers_lines(spark, tmp_dir):
    from seqlab.sources.logs import read_lines_ordered
    path = _golden(tmp_dir)
    df = read_lines_ordered(spark, path, whole_files=True)
    assert df.agg(F.max("pos")).first()[0] > 0
    lines = [r.line for r in df.orderBy("pos").collect()]
    assert lines[0].startswith("ID:u1") and lines[12] == ""


def _model(rows, carry_over):
    """Row-by-row state machine over one unit (written from the rules)."""
    out, seq, count, pending, user = [], 0, 0, None, None
    for kind, hdr, setting, t in rows:
        if kind == "stop":
            break
        if kind == "header":
            user, count = hdr, 0
            if not carry_over:
                pending = None
        elif kind == "on":
            if count == 0:
                seq += 1
                pending = dict(seq=seq, user=user, setting=setting, start=t)
            count += 1
            pending["n"], pending["end"] = count, t
        else:
            if pending is not None:
                out.append((pending["seq"], pending["n"], pending["start"], pending["end"], pending["user"],
                            pending["setting"]))
            pending, count = None, 0
    return out


def _random_units(seed, n_units=25):
    rnd = random.Random(seed)
    rows, expected = [], {True: [], False: []}
    for u in range(n_units):
        seqrows = []
        for i in range(rnd.randint(0, 60)):
            kind = rnd.choices(["on", "off", "header", "stop"], [6, 3, 1, 0.1])[0]
            seqrows.append((kind, f"h{u}-{i}" if kind == "header" else None, f"s{i}", i))
        for kind, hdr, setting, t in seqrows:
            rows.append((u, t, t // 3, kind, hdr, setting, t))
        for co in (True, False):
            expected[co] += [(u,) + r for r in _model(seqrows, co)]
    return rows, expected


def test_blocked_sessionize_equals_row_model(spark):
    rows, expected = _random_units(7)
    df = spark.createDataFrame(rows, "unit int, pos int, blk int, kind string, hdr string, setting string, t int")
    for co in (True, False):
        for blk in ("blk", None):
            s = sessionize(df, file_col="unit", order_cols=["pos"], kind_col="kind", time_col="t",
                           settings_cols=["setting"], header_cols=["hdr"], block_col=blk, carry_over=co)
            got = sorted((r.unit, r.seq, r.n_on, r.start, r.end, r.hdr, r.setting) for r in s.collect())
            assert got == sorted(expected[co]), (co, blk)


def test_running_blocked_equals_window(spark):
    rnd = random.Random(3)
    div = {0: 1, 1: 3, None: 7}
    rows = [(k, i, i // div[k], rnd.choice([None, 1, 2]), rnd.choice([None, "a", "b"]))
            for k in (0, 1, None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, b int, v int, s string")
    spec = dict(sums={"sv": F.col("v")}, lasts={"ls": F.col("s")}, firsts={"fs": F.col("s")},
                prevs={"pv": F.col("v")}, starts={"st": (F.col("s"), "a")})
    a = running(df, ["k"], ["i"], block="b", **spec)
    b = running(df, ["k"], ["i"], **spec)
    cols = ["k", "i", "sv", "ls", "fs", "pv", "st"]
    assert sorted(map(tuple, a.select(cols).collect()), key=repr) == sorted(map(tuple, b.select(cols).collect()), key=repr)
    assert a.count() == len(rows)


def test_split_reads_of_one_big_file_equal_whole_file(spark, tmp_dir):
    """A log file cut into many splits (tiny maxPartitionBytes) gives the
    same ordered lines and sessions as reading it whole."""
    import random
    from seqlab.sources.logs import read_lines_ordered
    rnd = random.Random(2)
    lines, t = [], 0
    for dev in range(40):
        lines.append(f"ID:d{dev},中国上海上海")
        for _ in range(rnd.randint(5, 40)):
            t += 1
            state = "poweron" if rnd.random() < 0.7 else "poweroff"
            lines.append(f"/,d,{state},low,auto,cool,26,25,2016-12-{1 + t // 1440:02d} "
                         f"{(t // 60) % 24:02d}:{t % 60:02d}")
    lines += ["", "ID:ghost,None", "/,d,poweron,low,auto,cool,26,25,2016-12-31 00:00",
              "/,d,poweroff,low,auto,cool,26,25,2016-12-31 00:01"]
    os.makedirs(f"{tmp_dir}/big")
    with open(f"{tmp_dir}/big/7.log", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        split = read_lines_ordered(spark, f"{tmp_dir}/big")
        assert split.select("block").distinct().count() > 5
        ordered = [r.line for r in split.orderBy("block", "pos").collect()]
        assert ordered == lines
        a = sorted(tuple(r) for r in log_sessions(spark, f"{tmp_dir}/big").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = sorted(tuple(r) for r in log_sessions(spark, f"{tmp_dir}/big").collect())
    assert a == whole and len(a) > 20
    assert all(r[0] != "ghost" for r in a)
