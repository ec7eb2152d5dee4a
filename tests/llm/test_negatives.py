import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import negatives


def plain(rows, anchors, positives=5, wanted=10):
    """The definition over (id, label, components)."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in rows:
        if not anchors(a):
            continue
        others = sorted(((-score(v, w), b, same) for b, same, w in rows if b != a))
        near = [(-s, b) for s, b, other in others if other == label][:positives]
        for ps, p in near:
            hits = [(b, -s) for s, b, other in others if other != label and 30 * ps <= -100 * s <= 90 * ps][:wanted]
            out += [(a, p, k + 1, n, ps, ns) for k, (n, ns) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("size,width", [(3, 4), (900, 64), (1 << 20, 8), (1 << 34, 5), (1 << 61, 3)])
def test_products_are_exact(size, width):
    rng = np.random.default_rng(size % 97)
    rows, anchors = (rng.integers(-size, size, (n, width)) for n in (70, 9))
    rows[0], rows[1] = size, -size  # the extremes
    anchors[0], anchors[1] = size, -size
    for a, got in zip(anchors.tolist(), negatives.products(anchors, rows)):
        want = [sum(x * y for x, y in zip(a, r)) for r in rows.tolist()]
        assert got.tolist() == [min(max(w, -(1 << 63)), (1 << 63) - 1) for w in want]


@pytest.mark.parametrize("sign", [1, -1])
def test_products_of_one_sign(sign):
    rows = sign * np.arange(1, 13).reshape(4, 3)
    got = np.stack(list(negatives.products(rows, rows)))
    assert (got == rows @ rows.T).all()
    assert [len(x) for x in negatives.products(rows, np.zeros((0, 3), np.int64))] == [0] * 4
    assert [x.tolist() for x in negatives.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64))] == [[0, 0, 0]] * 2


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id string, anchor int, rank int")


def test_equals_the_definition_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "MOST_ROWS", 40)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rng = np.random.default_rng(3)
    # Few distinct vectors, so that scores tie; a third of all rows are one vector.
    kinds = rng.normal(0, 0.2, (25, 6)).astype(np.float32)
    picks = [0 if i % 3 == 0 else int(rng.integers(25)) for i in range(300)]
    rows = [(i, int(rng.integers(3)), kinds[k].tolist(), "x", 1, 2) for i, k in enumerate(picks)]
    got = negatives.mine(frame(spark, rows), F.col("id") % 10 == 0)
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows]
    want = plain(whole, lambda i: i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.5, 0.25]), (3, 2, [0.25]), (4, 1, [1.0, 0.5]), (5, 3, []), (6, 2, [0.5, 0.25]),
    ]
    odd = [
        (7, None, [1.0, 1.0]), (8, 1, None), (9, 1, [1.0, None]), (10, 1, [nan, 1.0]), (11, 2, [inf, 1.0]), (None, 1, [1.0, 1.0]),
        (2, 2, [0.5, 0.25]), (2, 2, [0.75, 0.25]), (0, 1, [1.0, 0.5]),
    ]
    rows = [(i, label, v, None, None, 5) for i, label, v in sound + odd]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("id") % 2 == 0).collect()))
    pad = [(i, label, [math.floor(256 * x) for x in v] + [0] * (2 - len(v))) for i, label, v in sound]
    want = plain(pad, lambda i: i % 2 == 0)
    assert want and got == want
    assert negatives.mine(frame(spark, []), F.col("id") % 2 == 0).count() == 0
    huge = [(i, i % 2, [3e38, -3e38], None, None, None) for i in range(4)]
    assert negatives.mine(frame(spark, huge), F.col("id") == 0).count() >= 0


def test_fewer_than_asked(spark):
    rows = [(0, 1, [1.0], "", 0, 0), (1, 1, [1.0], "", 0, 0), (2, 2, [0.5], "", 0, 0)]
    assert [tuple(r) for r in negatives.mine(frame(spark, rows), F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
    assert negatives.mine(frame(spark, rows[:1]), F.col("id") == 0).count() == 0
