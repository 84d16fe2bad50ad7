"""Hard negatives and their bounds against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import hard_negatives
from tidepool.llm.hard_negatives import Mining, Summary


def by_definition(rows, is_anchor, positives=5, negatives=5):
    """(anchor, positive, rank, negative, positive score, negative score) by multiplying everything out."""
    sound = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) or math.isinf(x * 256.0) for x in v):
            continue
        sound.append((i, label, tuple(int(math.floor(x * 256.0)) for x in v)))
    out = []
    for i, label, v in {s for s in sound if is_anchor(s[0])}:
        score = [(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in sound if j != i and len(w) == len(v)]
        near = sorted((-s, j) for s, j, other in score if other == label)[:positives]
        for s, j in near:
            hard = sorted((-n, k) for n, k, other in score if other != label and 80 * -s <= 100 * n <= 100 * -s)[:negatives]
            out += [(i, j, r + 1, k, clamp(-s), clamp(-n)) for r, (n, k) in enumerate(hard)]
    return sorted(out)


def clamp(x):
    return max(-(2**63), min(2**63 - 1, x))


def mined(spark, rows, every, mining):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "h", "dims", "sum", "rank", "is_anchor")})
    return sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % every == 0, mining=mining).collect())


def clustered(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    label = np.where(rng.random(n) < 0.4, 0, rng.integers(0, labels, n))
    return [(i, int(c), (centres[rng.integers(0, labels)] * 0.5 + centres[c] * 0.5 + rng.normal(size=dims) * 0.4).tolist()) for i, c in enumerate(label)]


@pytest.mark.parametrize("mining", [Mining(), Mining(shard_rows=60, block_rows=7), Mining(shard_rows=33, block_rows=3, segments=(2,)), Mining(segments=(1, 3, 5, 64), shard_rows=100)])
def test_negatives_by_brute_force(spark, mining):
    rows = clustered(700, 20, 6, 1)
    rows += [(i + 5000, label, v) for i, label, v in rows[:40]]  # equal vectors of other ids: ties
    rows += rows[:15] + [(0, 3, rows[5][2]), (20, 1, rows[7][2])]  # repeated rows, and rows that share an anchor's id
    rows += [(9000 + k, k % 3, [0.25] * 20) for k in range(60)] + [(9100, 1, [0.0] * 20), (9200, 2, [-0.25] * 20)]
    assert mined(spark, rows, 20, mining) == by_definition(rows, lambda i: i % 20 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [1.0, 1.9]), (3, 2, None), (4, 2, [nan, 1.0]), (5, 2, [1.0, inf]), (6, 2, [None, 1.0]), (7, None, [1.0, 2.0]), (None, 2, [1.0, 2.0]), (8, 2, []), (9, 2, [1.0, 2.0, 3.0]), (10, 1, [1.0]), (20, 3, [1.0]), (11, 2, [1e307, 1.0]), (12, 2, [1.0, 2.0])]
    made = mined(spark, rows, 10, Mining(block_rows=2))
    assert made == by_definition(rows, lambda i: i % 10 == 0) and (0, 1, 1, 12, 5 * 65536, 5 * 65536) in made
    assert mined(spark, rows[:0], 10, Mining()) == []
    assert mined(spark, rows[:2], 10, Mining()) == []


def test_scores_beyond_doubles_and_longs(spark):
    random.seed(3)
    rows = [(i, i % 3, [random.choice([-1, 1]) * random.random() * 10.0 ** random.choice([0, 3, 8, 12, 14]) for _ in range(6)]) for i in range(120)]
    for mining in (Mining(), Mining(shard_rows=25, block_rows=5, segments=(1, 2, 3))):
        assert mined(spark, rows, 6, mining) == by_definition(rows, lambda i: i % 6 == 0)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 64)) * 256 + 30, rng.normal(size=(50, 64)) * 256 - 10
    left, right = Summary(np.floor(a), (1, 4, 16, 64)), Summary(np.floor(b), (1, 4, 16, 64))
    exact, widths = left.points @ right.points.T, []
    rows, columns = np.divmod(np.arange(2000), 50)
    for number in range(4):
        low, high = hard_negatives.bounds(left, right, number)
        assert (low <= exact).all() and (exact <= high).all()
        pair_low, pair_high = hard_negatives.pair_bounds(left, right, number, rows, columns)
        assert np.allclose(pair_low.reshape(40, 50), low) and np.allclose(pair_high.reshape(40, 50), high)
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True) and widths[3] < 10
    keep, _ = hard_negatives.search(left, right, np.ones((40, 50), bool), np.full((40, 1), -np.inf), np.full((40, 1), np.inf), 3)
    assert len(keep) < 40 * 20
