"""op11 against brute force, and its products and heaps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hardneg


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 70), (64, 64, 64), (65, 33, 129), (0, 4, 3), (4, 0, 3)])
def test_products_are_exact(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    expected = (a.astype(object) @ b.astype(object)).astype(np.int64) if k else np.zeros((m, n))
    for leaf in (1, 2, 32):
        assert np.array_equal(hardneg.product(a, b, leaf), expected)


def test_sums_inside_may_run_over():
    a = np.full((8, 8), 2**29)
    assert (hardneg.product(a, a, 1) == 8 * 2**58).all()
    with pytest.raises(OverflowError):
        hardneg.product(np.full((2, 2), 2**31), np.full((2, 2), 2**31))


def test_heaps_hold_the_greatest():
    rng = np.random.default_rng(9)
    all_rows = []
    parts = [hardneg.Heaps(4, 3) for _ in range(3)]
    for h in parts:
        for _ in range(5):
            scores, ids = rng.integers(-5, 6, (4, 40)), rng.integers(0, 30, 40)
            allowed = rng.random((4, 40)) < 0.6
            h.offer_tile(np.arange(4), scores, ids, allowed)
            all_rows += [(r, -scores[r, c], ids[c]) for r in range(4) for c in range(40) if allowed[r, c]]
    whole = hardneg.Heaps(4, 3)
    for h in parts:
        whole.offer(*[x.to_numpy() for x in h.batch(["row", "score", "id"]).columns])
    for r in range(4):
        best = sorted({(s, i) for q, s, i in all_rows if q == r})[:3]
        assert [(-s, i) for s, i in zip(whole.score[r].tolist(), whole.id[r].tolist())] == best


def brute(rows, every, n_pos=5, n_neg=10):
    vectors = {}
    for k, label, v in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.setdefault(k, set()).add((label, tuple(math.floor(256 * x) for x in v)))
    each = [(k, *x) for k, some in vectors.items() for x in some]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, some in vectors.items():
        if a % every:
            continue
        label, v = min(some, key=lambda x: (x[0], b"".join(q.to_bytes(8, "little", signed=True) for q in x[1])))
        near = {(-dot(v, w), k, other == label) for k, other, w in each if k != a}
        for s, p, _ in sorted(x for x in near if x[2])[:n_pos]:
            window = sorted({x[:2] for x in near if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s})[:n_neg]
            out += [(a, p, i + 1, n, -s, -t) for i, (t, n) in enumerate(window)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in hardneg.mine(df, **options).collect())


def test_given_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in df.collect()]
    got = sorted(tuple(r) for r in hardneg.contract(df).collect())
    assert got == brute(rows, 100) and got


@pytest.mark.parametrize("block", [1 << 14, 3])
def test_ties_repeats_and_bad_rows(spark, block):
    r = random.Random(2)
    rows = [(k, r.choice([0, 0, 0, 1, 2, 3]), [r.choice([0.1, 0.5, 1.0, -0.25]) for _ in range(5)]) for k in range(-20, 400)]
    rows += rows[:60] + [(k, 1, [0.5] * 5) for k in range(500, 800)]  # repeats, and many equal vectors
    rows += [(900, None, [1.0] * 5), (910, 1, None), (920, 1, [1.0, None]), (930, 1, [math.nan]), (940, 1, [math.inf]), (950, 0, []), (960, 0, [0.5]), (970, 0, [0.5] * 9), (None, 1, [1.0]), (10, 2, [0.5, 0.25])]
    df = spark.createDataFrame([(*x, "x", "y") for x in rows], "vec_id long, label int, embedding array<float>, id string, q string")
    expected = brute([(k, x, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, x, v in rows], 10)
    assert found(df, anchors=F.col("id") % 10 == 0, block=block) == expected and len(expected) > 500


def test_tables_without_anchors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hardneg.contract(spark.createDataFrame([], schema)).collect() == []
    assert hardneg.contract(spark.createDataFrame([(1, 1, [1.0]), (2, None, [1.0])], schema)).collect() == []
    assert hardneg.contract(spark.createDataFrame([(100, 1, [1.0])], schema)).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        hardneg.contract(spark.createDataFrame([(100, 1, [3e38])], schema)).collect()
