"""Hard negatives against all pairs in plain loops."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import negatives
from quillon.llm.negatives import hard_negatives, hilbert

SCHEMA = "vec_id long, label int, embedding array<float>, block string, q int"


def plain(rows, positives=5, wanted=3):
    held = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in held:
        if i % 50:
            continue
        score = sorted((-sum(a * b for a, b in zip(v, u)), j, other == label) for j, other, u in held if j != i)
        for p, j, same in [x for x in score if x[2]][:positives]:
            found = [(s, n) for s, n, alike in score if not alike and -50 * p <= -100 * s <= -95 * p][:wanted]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(found, 1)]
    return sorted(out)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    random.seed(seed)
    labels = rng.integers(4, size=n) * (np.arange(n) % 9 > 0)
    rows = [(i * 5, int(x), (centres[(x + rng.integers(2)) % 12] + rng.normal(size=dims) * random.choice([0, 0.1, 0.6])).tolist(), "x", 1) for i, x in enumerate(labels)]
    rows += [(10_000, None, [1.0] * dims, "x", 1), (10_050, 1, None, "x", 1), (10_100, 1, [float("nan")] * dims, "x", 1), (10_150, 2, [float("inf")] * dims, "x", 1), (10_200, 2, [None] * dims, "x", 1),
             (None, 2, [1.0] * dims, "x", 1), (10_250, 1, [], "x", 1), (10_300, 1, [1.0], "x", 1), (10_350, 9, [0.5] * dims, "x", 1), (10_400, 2, [0.0] * dims, "x", 1), (10_450, 3, [70.0] * dims, "x", 1)]
    return rows + rows[3:8] + [(50, 3, rows[0][2], "x", 1), (51, rows[0][1], rows[0][2], "x", 1)]


@pytest.mark.parametrize(("block", "pack", "grid", "dims"), [(256, 256, 16, 6), (5, 7, 3, 6), (16, 4, 2, 1)])
def test_hard_negatives(spark, monkeypatch, block, pack, grid, dims):
    for name, value in (("BLOCK", block), ("PACK", pack), ("GRID", grid)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(dims * block, 400, dims)
    out = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain(rows)
    assert len(expected) > 100 and sorted(tuple(r) for r in out.collect()) == expected


def test_bounds_prune_and_hold(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 5)) * 4
    rows = [(i, i % 2, (centres[i % 30] + rng.normal(size=5) * 0.05).tolist(), i % 50 == 0) for i in range(1200)]
    own = spark.createDataFrame(rows, "vec_id long, label long, e array<double>, anchor boolean").select("vec_id", "label", F.expr("transform(e, x -> floor(256 * x))").alias("q"), "anchor")
    blocks = negatives.Blocks(own, 5, 2**14)
    assert blocks.kind == "<i2" and blocks.table.count() >= 1200 / 8
    windows = blocks.anchors(5).withColumn("window", F.col("anchor"))
    packs = blocks._packs(windows).cache()
    reads = blocks._reads(packs, True).collect()
    assert 0 < sum(np.unpackbits(np.frombuffer(r.need, np.uint8)).sum() for r in reads) < 0.2 * 24 * 75  # anchors times blocks of their label


def test_errors_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []
    with pytest.raises(Exception, match="too large for scores"):
        hard_negatives(spark.createDataFrame([(0, 1, [1e12], "x", 1), (1, 1, [1e12], "x", 1)], SCHEMA), F.lit(True)).collect()


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (1, 5)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = [k.tobytes() for k in hilbert(cells, bits)]
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
