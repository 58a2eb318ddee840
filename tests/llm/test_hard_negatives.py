"""Hard negatives against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows, anchors, positives=5, negatives=3, scale=256):
    usable = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = min(usable.get(i, (label, v)), (label, v))
    dim = max((len(v) for _, v in usable.values()), default=0)
    ints = {i: (label, [math.floor(scale * x) for x in v] + [0] * (dim - len(v))) for i, (label, v) in usable.items()}
    out = []
    for a in filter(anchors, ints):
        label, own = ints[a]
        scores = sorted(((-sum(x * y for x, y in zip(own, v)), i, other == label) for i, (other, v) in ints.items() if i != a))
        for p, positive in [(-s, i) for s, i, same in scores if same][:positives]:
            fits = [(-s, i) for s, i, same in scores if not same and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(a, positive, n + 1, i, p, s) for n, (s, i) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA, **kw):
    table = spark.createDataFrame(rows, schema).select("*", F.lit(1).alias("id"), F.lit(2).alias("node"), F.lit("x").alias("v")).repartition(3)
    got = hard_negatives.mine(table, F.col("id") % 5 == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, small", [(0, False), (1, True)])
def test_like_all_products(spark, monkeypatch, seed, small):
    """Ties, repeats, nulls, shorter vectors and a label with most rows; small nodes and blocks make many meetings."""
    if small:
        for name, size in (("PAGE", 4), ("NODE", 16), ("SLAB", 64), ("ANCHORS", 8)):
            monkeypatch.setattr(hard_negatives, name, size)
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 6))
    rows = [(int(i), [float(x) for x in centres[rnd.integers(6)] + 0.3 * rnd.normal(size=6)], int(rnd.choice([0, 0, 0, 1, 2]))) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1], i % 2) for i in range(60)] + [(3, rows[9][1], 1), (5, None, 0), (500, [1.0, None, 2.0], 0), (505, [float("nan")] * 6, 0), (510, [], 1), (515, [1.0, 2.0], 2)]
    rows += [(None, rows[0][1], 0), (520, rows[0][1], None), (525, [0.0] * 6, 0), (530, [1.0] * 6, 77), (535, [float("inf")] * 6, 1), (-5, rows[2][1], 2)]
    assert mined(spark, rows) == expected(rows, lambda i: i % 5 == 0)


def test_products_beyond_doubles(spark):
    """Scores near 2**60, where doubles no longer tell neighbours apart."""
    rows = [(i, [(0.7 if i % 2 else 1.0) * float(2 ** 22 + i), (0.7 if i % 2 else 1.0) * float(2 ** 22 - 3 * i)], i % 2) for i in range(12)]
    assert mined(spark, rows) == expected(rows, lambda i: i % 5 == 0) != []


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, None, 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 2)]) == []


def test_page_intervals_hold_all_scores():
    rnd = np.random.default_rng(4)
    parts = rnd.integers(-300, 300, (500, 8))
    tree = hard_negatives.Tree(np.arange(500).tobytes(), parts.astype("<i2").tobytes(), "<i2", 8)
    anchors = rnd.integers(-300, 300, (20, 8)).astype(float)
    least, most = tree.intervals(anchors)
    scores = anchors @ parts.T
    for page in range(least.shape[1]):
        own = scores[:, page * hard_negatives.PAGE:(page + 1) * hard_negatives.PAGE]
        assert (own >= least[:, [page]]).all() and (own <= most[:, [page]]).all()
