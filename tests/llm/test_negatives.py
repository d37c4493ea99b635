"""Hard negatives against Python's own integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, slot string, ints string, rank int, anchor string"


@pytest.mark.parametrize("largest", [1, 200, 1 << 15, 1 << 27])
def test_scores_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, b = (rng.integers(-largest, largest + 1, (n, 150)) for n in (17, 23))
    a[0], b[0] = largest, largest
    b[1] = -largest
    want = a.astype(object) @ b.astype(object).T
    moduli = negatives.primes(largest * largest * 150)
    assert (negatives.exact_scores(a, b, moduli).astype(object) == want).all()


def test_primes():
    for bound in (0, 1, 10**6, 2**62):
        found = negatives.primes(bound)
        assert math.prod(found) > 2 * bound + 1 and len(set(found)) == len(found)
        assert negatives.DEPTH * (max(found) // 2) ** 2 <= 1 << 24


def brute(rows, scale=256):
    sound = []
    for key, vec, label in rows:
        if key is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        sound.append((key, [math.floor(scale * x) for x in vec], label))
    out, seen = [], set()
    for key, vec, label in sound:
        if key % 5 or (key, tuple(vec), label) in seen:
            continue
        seen.add((key, tuple(vec), label))
        scored = sorted((-sum(x * y for x, y in zip(vec, v, strict=True)), k, lab) for k, v, lab in sound if k != key and len(v) == len(vec))
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(k, -s) for s, k, lab in scored if lab != label and 50 * -minus <= 100 * -s <= 95 * -minus]
            out += [(key, positive, n, k, -minus, s) for n, (k, s) in enumerate(inside[:3], 1)]
    return sorted(out)


def cases(rng, size=1.0):
    rows = [(k, [rng.gauss(0.3, size) for _ in range(6)], rng.randrange(4) if k % 3 else 1) for k in range(160)]
    rows += [(200 + k, [0.5] * 6, k % 2) for k in range(40)]
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (305, [1.0] * 6, None), (310, [1.0, None] * 3, 1), (315, [float("nan")] * 6, 1), (320, [float("inf")] * 6, 1), (325, [0.0] * 6, 1), (330, [], 1), (335, [], 2), (340, [1.0, 2.0], 1), (345, [1.0, 1.5], 1), (346, [1.0, 0.9], 2)]
    rows += [(5, [9.0] * 6, 2), rows[10], rows[10], (400, [-0.0] * 6, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("slots", "size"), [(1 << 14, 1.0), (16, 1.0), (16, 3e5)])
def test_against_integers(spark, monkeypatch, slots, size):
    monkeypatch.setattr(negatives, "SLOT_VECTORS", slots)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", max(4, slots // 4))
    monkeypatch.setattr(negatives, "CELLS", 100)
    rows = cases(random.Random(int(size) + slots), size)
    df = spark.createDataFrame([(*r, "s", "i", 9, "a") for r in rows], SCHEMA).repartition(4)
    out = negatives.hard_negatives(df, F.col("vec_id") % 5 == 0)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())
    want = brute(rows)
    # A positive that several rows name has its negatives once for each.
    assert got == want and len(want) > 50


def test_empty_and_unanswered(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 5 == 0).collect() == []
    alone = spark.createDataFrame([(5, [1.0], 1, "", "", 1, ""), (6, [1.0], 2, "", "", 1, "")], SCHEMA)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 5 == 0).collect() == []
    huge = spark.createDataFrame([(5, [1e300], 1, "", "", 1, "")], SCHEMA)
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(huge, F.col("vec_id") % 5 == 0)
