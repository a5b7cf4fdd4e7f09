"""Hard negatives against brute force, over odd rows and small blocks, and the bounds of bit-planes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosslight.llm import negatives as ng
from tests.compare import DATA, connection, difference

SCHEMA = "vec_id long, embedding array<double>, label int, score string, key string"


def brute(rows, every=3, share=80):
    """(anchor, positive, rank, negative, positive score, negative score) of plain loops; rows are (id, vector, label)."""
    fine = [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    last = 1 << 63
    out = []
    for k, (i, x, lab) in enumerate(fine):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), last if j is None else j, j, m) for n, (j, y, m) in enumerate(fine) if n != k]
        scored.sort(key=lambda s: s[:2])
        for minus, _, j, _ in [s for s in scored if s[3] == lab][:5]:
            p = -minus
            near = [s for s in scored if s[3] != lab and share * p <= -100 * s[0] <= 100 * p]
            out += [(i, j, r + 1, s[2], p, -s[0]) for r, s in enumerate(near[:5])]
    return sorted(out, key=str)


def found(spark, rows, every=3):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = ng.mine(ng.usable(frame, "vec_id", "embedding", F.col("label")), (F.col("id") % every == 0) & (F.col("id") != ng.NO_ID))
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()), key=str)


def odd_rows():
    dice = random.Random(5)
    rows = [(k, [dice.randrange(-9, 10) / 16 for _ in range(4)], k % 3) for k in range(150)]
    rows += [(k, rows[k - 200][1], k % 4) for k in range(200, 260)]  # ties
    rows += [(33, rows[33][1], 0), (33, rows[33][1], 0), (36, [0.5, 0.5], 1), (None, rows[3][1], 1), (None, rows[4][1], 0)]
    return rows + [(300, None, 1), (303, [None, 1.0], 1), (306, [math.nan] * 4, 1), (309, [math.inf] * 4, 1), (312, [1.0] * 4, None), (315, [], 2), (318, [0.0] * 4, 0), (321, [1.0] * 4, 9)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_ROWS", 16), ("SET_ANCHORS", 4), ("TROOP_SETS", 2), ("LANE_ROWS", 40)):
            monkeypatch.setattr(ng, name, value)
    assert found(spark, odd_rows()) == brute(odd_rows())


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    dice = random.Random(6)
    rows = [(k, [dice.randrange(-(1 << 20), 1 << 20) + 0.5 for _ in range(3)], k % 2) for k in range(60)]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="don't fit a long"):
        found(spark, [(k, [1e30], k % 2) for k in range(6)])


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, None, None)], [(0, [], 1), (1, [], 1), (2, [], 2)]])
def test_few_or_no_rows(spark, rows):
    assert found(spark, rows) == brute(rows)


def block_of(x, bits):
    n, dims = x.shape
    planes = np.packbits((x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1)
    return ng.Block({"keys": np.arange(n).tobytes(), "ids": np.arange(n).tobytes(), "labels": np.zeros(n, np.int64).tobytes(), "n": n, "dims": dims, "bits": bits, "planes": planes.tobytes()})


def test_planes_narrow_and_lose_nothing():
    rng = np.random.default_rng(7)
    x, anchors = np.floor(256 * rng.normal(0, 0.12, (900, 64))).astype(np.int64), np.floor(256 * rng.normal(0, 0.12, (20, 64))).astype(np.int64)
    block, scores = block_of(x, 10), x @ anchors.T
    assert (block.vectors() == x).all()
    least, most = np.quantile(scores, 0.99, axis=0).astype(np.int64), np.quantile(scores, 0.997, axis=0).astype(np.int64)
    rows, columns, exact, left = ng.tightened(block, anchors, np.ones(scores.shape, bool), lambda low, high, open_pairs: (least, most))
    assert set(zip(rows, columns)) == set(zip(*np.nonzero((scores >= least) & (scores <= most)))) and (exact == scores[rows, columns]).all()
    assert left == sorted(left, reverse=True) and left[-3] < 0.05 * scores.size and left[-1] == len(rows)


def test_op12_against_sql(spark):
    assert not difference(spark, ng.op12_hard_negatives, ng.ORACLE_SQL, connection(), DATA)
