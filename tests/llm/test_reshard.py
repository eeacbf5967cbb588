import itertools
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqlab.llm import reshard
from tests.llm import cases


def least_moved(old, capacity):
    """Cheapest of all integer plans, by trying every one."""
    best = None
    shards = sorted(old)

    def go(i, room, moved):
        nonlocal best
        if best is not None and moved >= best:
            return
        if i == len(shards):
            best = moved
            return
        s = shards[i]
        for parts in itertools.product(*[range(min(old[s], r) + 1) for r in room]):
            if sum(parts) == old[s]:
                go(i + 1, [r - p for r, p in zip(room, parts)], moved + sum(p for t, p in enumerate(parts) if t != s))
    go(0, capacity, 0)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_transfers_move_the_fewest_bytes(seed):
    rng = random.Random(seed)
    old = {s: rng.randint(0, 4) for s in rng.sample(range(5), 3)}
    capacity = [rng.randint(0, 4) for _ in range(3)]
    capacity[0] += max(0, sum(old.values()) - sum(capacity)) + seed % 3
    plan = reshard.transfers(old, capacity)
    assert all(n > 0 for *_, n in plan)
    for s in old:
        assert sum(n for a, _, n in plan if a == s) == old[s]
    for t, c in enumerate(capacity):
        assert sum(n for _, b, n in plan if b == t) <= c
    assert sum(n for s, t, n in plan if s != t) == least_moved(old, capacity)


def test_transfers_of_many_shards_and_too_little_room():
    rng = random.Random(3)
    old = {s: rng.randint(0, 10 ** 12) for s in range(300)}
    capacity = reshard.even(sum(old.values()), 400)
    plan = reshard.transfers(old, capacity)
    assert sum(n for s, t, n in plan if s != t) == sum(max(0, n - capacity[s]) for s, n in old.items())
    with pytest.raises(ValueError):
        reshard.transfers({0: 5}, [2, 2])


def crc(text):
    return zlib.crc32((text or "").encode())


def model(rows, old_shards, new_shards):
    """Multiset of (doc_id, size, crc, shard, slot)."""
    old = defaultdict(list)
    for r in rows:
        old[crc("" if r[0] is None else str(r[0])) % old_shards].append((r[0], len((r[1] or "").encode()) + 1, crc(r[1])))
    total = sum(z for own in old.values() for _, z, _ in own)
    cap = reshard.even(total, new_shards)
    has = {s: sum(z for _, z, _ in own) for s, own in old.items()}
    line = []       # bytes that leave, in order of the old shards, against free room, in order of the new ones
    room = [(t, max(0, c - has.get(t, 0))) for t, c in enumerate(cap)]
    out, over0 = defaultdict(list), 0
    for s in sorted(old):
        stay = min(has[s], cap[s]) if s < new_shards else 0
        at = 0
        for d in sorted(old[s], key=lambda d: (-d[1], d[0] is None, d[0] or 0, d[2])):
            middle, at = at + d[1] / 2, at + d[1]
            if middle < stay:
                out[s].append((False, s, middle, d))
                continue
            place, before = middle - stay + over0, 0
            for t, n in room:
                if before <= place < before + n:
                    out[t].append((True, s, middle, d))
                before += n
        over0 += has[s] - stay
    return sorted((repr(d[0]), d[1], d[2], t, k) for t, own in out.items() for k, (*_, d) in enumerate(sorted(own, key=lambda x: x[:3])))


def test_registered_query_on_odd_documents(spark, tmp_dir):
    cases.frame(spark).withColumns({c: F.lit("x") for c in ("shard", "slot", "size", "row", "path", "index", "to", "lo", "part")}).write.parquet(
        f"{tmp_dir}/documents.parquet")
    df = reshard.op11_reshard(spark, tmp_dir)
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = df.collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == model(cases.rows(), 12, 16)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rows_travel_whole_and_unaffected_files_stay(spark, tmp_dir):
    docs = spark.createDataFrame([(i, "w" * (5 + i % 9), "x") for i in range(4000)], "doc_id long, text string, shard string")
    rows = reshard.with_sizes(docs)
    old_shard = F.when(F.col("row.doc_id") % 3 == 0, 0).otherwise(F.col("row.doc_id") % 5).cast("int")     # uneven
    reshard.write_shards(rows, old_shard, ["row.doc_id"], f"{tmp_dir}/old", 60)
    old = reshard.layout(reshard.read_files(spark, rows.schema["row"].dataType, f"{tmp_dir}/old"))
    total = sum(r["bytes"] for r in old.files.collect())
    new = reshard.reshard(old, reshard.even(total, 6), f"{tmp_dir}/new")
    files = {r["path"]: r for r in new.files.collect()}
    before = {r["path"] for r in old.files.collect()}
    assert 10 < len(before & set(files)) < len(before)              # most files are named as before
    assert all(os.path.exists(p.removeprefix("file:").replace("//", "/")) for p in files)
    out = reshard.slots(new)
    assert sorted(out.select("row.*").collect()) == sorted(docs.collect())
    sizes = {r["shard"]: r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert sorted(sizes) == list(range(6)) and max(sizes.values()) - min(sizes.values()) <= 6 * 14
    # a layout that fits already is left alone
    same = reshard.reshard(old, [10 ** 9] * 6, f"{tmp_dir}/unused")
    assert {r["path"] for r in same.files.collect()} == before and not os.path.exists(f"{tmp_dir}/unused")


def test_second_move_reads_files_of_both_generations(spark, tmp_dir):
    docs = spark.createDataFrame([(i, "w" * (5 + i % 9)) for i in range(600)], "doc_id long, text string")
    rows = reshard.with_sizes(docs)
    reshard.write_shards(rows, (F.col("row.doc_id") % 2).cast("int"), ["row.doc_id"], f"{tmp_dir}/a", 12)
    lay = reshard.layout(reshard.read_files(spark, rows.schema["row"].dataType, f"{tmp_dir}/a"))
    total = sum(r["bytes"] for r in lay.files.collect())
    for name, n in (("b", 3), ("c", 2)):
        lay = reshard.reshard(lay, reshard.even(total, n), f"{tmp_dir}/{name}")
        out = reshard.slots(lay).collect()
        assert sorted(r["row"]["doc_id"] for r in out) == list(range(600)) and {r["shard"] for r in out} == set(range(n))
        for t in range(n):
            assert sorted(r["slot"] for r in out if r["shard"] == t) == list(range(sum(r["shard"] == t for r in out)))


def test_empty_table(spark, tmp_dir):
    cases.empty(spark).write.parquet(f"{tmp_dir}/documents.parquet")
    assert reshard.op11_reshard(spark, tmp_dir).collect() == []
