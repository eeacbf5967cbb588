import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from seqlab.llm import veccodes

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code string"


def model(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [Fraction(x) for x in e], y) for i, e, y in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    width = parts * max(1, -(-max(len(e) for _, e, _ in kept) // parts))
    m = width // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[math.floor(256 * x) for x in e] + [0] * (width - len(e)) for _, e, _ in kept]
    points = [[x[p * m:(p + 1) * m] for x in v] for p in range(parts)]
    books = [list(own[:entries]) for own in points]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in own] for own, book in zip(points, books)]
    for _ in range(rounds):
        for own, found, book in zip(points, assign(), books):
            members = defaultdict(list)
            for x, (_, k) in zip(own, found):
                members[k].append(x)
            for k, xs in members.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = assign()
    errors = [min(sum(found[p][i][0] for p in range(parts)), 2 ** 63 - 1) for i in range(len(v))]
    label = defaultdict(int)
    for (_, _, y), e in zip(kept, errors):
        label[y] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{found[p][k][1]:02x}" for p in range(parts)), errors[k], min(label[y], 2 ** 63 - 1), sha)
                  for k, (i, _, y) in enumerate(kept))


def vectors(seed=2, n=260, width=32):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(rng.randint(0, 10 ** 6), [f(rng.gauss(0, 0.3)) for _ in range(width)], rng.choice([1, 2, 3, None])) for _ in range(n)]
    same = [f(0.25)] * width
    rows += [(10 ** 7 + i, same, 7) for i in range(90)]                               # one vector of many rows
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], 1)]                           # repeated rows and ids
    rows += [(None, [f(0.1)] * width, 4), (5, None, 1), (6, [f(0.1)] * (width - 1) + [None], 1), (7, [math.nan] * width, 1),
             (8, [math.inf] + [0.0] * (width - 1), 1), (-3, [f(-0.001)] * width, None), (9, [], 2), (12, [f(0.5)] * 5, 2)]
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("width", [16, 32, 48])
def test_registered_query_equals_plain_rounds(spark, tmp_dir, width):
    rows = vectors(width=width)
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_dir}/embeddings.parquet")
    assert got(veccodes.op13_vector_codes(spark, tmp_dir)) == model(rows)


def test_components_beyond_64_bit_squares(spark, tmp_dir):
    rng = random.Random(8)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(rng.choice([1.0, -1.0]) * 10 ** rng.uniform(0, 38)) for _ in range(16)], i % 2) for i in range(90)]
    rows += [(100 + i, [f(rng.gauss(0, 1)) for _ in range(16)], 0) for i in range(40)]
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_dir}/embeddings.parquet")
    assert got(veccodes.op13_vector_codes(spark, tmp_dir)) == model(rows)


def test_few_rows_none_and_only_unusable_ones(spark, tmp_dir):
    for k, rows in enumerate(([(4, [0.5] * 16, 1), (2, [0.25] * 16, 1)], [], [(1, None, 1)])):
        spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp_dir}/{k}/embeddings.parquet")
        df = veccodes.op13_vector_codes(spark, f"{tmp_dir}/{k}")
        assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert got(df) == model(rows)


@pytest.mark.parametrize("bits, width", [(3, 2), (2, 3), (1, 5)])
def test_curve_visits_every_cell_by_unit_steps(bits, width):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width), -1).reshape(-1, width).astype(np.uint64)
    key = veccodes.hilbert(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(key)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_short_lists_leave_out_entries():
    """Blocks along the curve are small, so most entries are ruled out by the boxes."""
    rng = np.random.default_rng(0)
    x = rng.integers(-500, 500, (4096, 4))
    order = veccodes.curve_order(x.astype(float))
    row = {"rows": [veccodes.pack(order.astype(np.int32))], "points": [veccodes.pack(x[order].astype(np.int32).reshape(-1))], "narrow": True}
    cut = np.arange(0, 4096, veccodes.BLOCK_ROWS)
    for name, f in (("low", np.minimum), ("high", np.maximum), ("sums", np.add)):
        row[name] = [veccodes.pack(f.reduceat(x[order], cut).reshape(-1))]
    part = veccodes.Part(row, 0, 4, 256)
    book = rng.integers(-500, 500, (64, 4))
    _, entry, far = part.nearest(book.tolist(), look=True)
    d = ((x[order][:, None] - book) ** 2).sum(2)
    assert (entry == d.argmin(1)).all() and (far == d.min(1)).all()
    volume = (part.high - part.low).prod(1).mean()
    assert volume < 0.1 * 1000 ** 4
