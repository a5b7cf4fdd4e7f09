"""Whitening against a dense solver in double precision and whole numbers of any size."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from crosslight.llm import whitening as wh
from tests.compare import DATA

SCHEMA = "vec_id long, embedding array<double>, x string, component string"


def dense(rows, wanted=4):
    """n, sums, deviations, eigenvalues, vectors and trace of the rows that take part; rows are (id, vector)."""
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in fine), default=0)
    fine = [(i, x + [0] * (dims - len(x))) for i, x in fine]
    own = sorted({tuple(x) for _, x in fine})
    n, sums = len(own), [sum(c) for c in zip(*own)]
    centred = np.array(own, float).reshape(n, dims) - np.array(sums) / max(n, 1)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(n, 1)) if n else (np.zeros(0), np.zeros((0, 0)))
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in fine]
    return fine, n, sums, deviations, values[::-1][:wanted], vectors[:, ::-1][:, :wanted], values.sum()


def compare(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    usable = wh.usable(frame, "vec_id", "embedding")
    got = wh.whiten(usable, wh.fit(usable), "vec_id").collect()
    fine, n, sums, deviations, values, vectors, trace = dense(rows)
    kept = [k for k in range(len(values)) if values[k] > 1e-12 * trace]
    assert len(got) == len(fine) * len(kept)
    for k in kept:
        mine = sorted(((r.vec_id is None, r.vec_id or 0, r.deviation or 0), r.whitened) for r in got if r.component == k + 1)
        w = [(np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k]) for _, x in fine]
        want = sorted(((i is None, i or 0, d if d < 1 << 63 else 0), v) for (i, _), d, v in zip(fine, deviations, w))
        assert [m[0] for m in mine] == [v[0] for v in want]
        a, b = np.array(sorted(m[1] for m in mine)), np.array([v[1] for v in want])
        assert min(np.abs(a - np.sort(b)).max(), np.abs(a - np.sort(-b)).max()) < 1e-8
    for r in got:
        assert r.n == n and abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-10 and r.identity_error < 1e-10


def test_odd_rows(spark):
    dice = random.Random(3)
    rows = [(k, [dice.gauss(0, 0.2 + 0.1 * d) for d in range(6)]) for k in range(200)]
    rows += [(k, rows[k % 7][1]) for k in range(300, 340)]  # copies count once in the fit, and are whitened each
    rows += [(5, [0.1, 0.2]), (5, [0.1, 0.2]), (None, rows[9][1]), ((1 << 62) + 1, rows[8][1]), (400, None), (401, [None] * 6), (402, [math.nan] * 6), (403, [-math.inf] * 6), (404, []), (405, [-0.0] * 6)]
    compare(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, []), (2, [])], [(1, [0.1]), (2, [0.9]), (3, [0.4])], [(k, [k / 8, -k / 4, 1.0, 2.0, 3.0]) for k in range(9)]])
def test_few_rows_or_dimensions(spark, rows):
    compare(spark, rows)


def test_deviations_that_fit_no_long_are_null(spark):
    rows = [(k, [(1 << 22) * (k - 8) + 0.5, float((1 << 22) * (k * k % 17))]) for k in range(17)]
    compare(spark, rows)


def test_deviations_of_any_size(spark):
    rows = [(k, [2.0**20 * (k % 5), 2.0**19 * k]) for k in range(60)]
    compare(spark, rows)


@pytest.mark.parametrize("kind", ["flat", "steep", "ties", "low_rank"])
def test_lobpcg_against_dense(kind):
    rng = np.random.default_rng(11)
    turn, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    spectrum = {"flat": np.linspace(1.0, 1.3, 64), "steep": 2.0 ** -np.arange(64), "ties": np.r_[5, 5, 4, 4, np.ones(60)], "low_rank": np.r_[3, 2, np.zeros(62)]}[kind]
    matrix, calls = (turn * spectrum) @ turn.T, []
    values, vectors, residuals, steps = wh.lobpcg(lambda block: calls.append(block.shape[1]) or matrix @ block, 64, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert (np.linalg.norm(matrix @ vectors - vectors * values, axis=0) <= 1e-12 * spectrum.max()).all() and (residuals <= 1e-13 * spectrum.max()).all()
    assert steps < 150 and max(calls) <= 4 + wh.GUARD


def test_no_convergence_is_an_error():
    matrix = np.diag(np.linspace(1, 1.001, 300))
    with pytest.raises(ArithmeticError):
        wh.lobpcg(lambda block: matrix @ block, 300, 4, iterations=3)


def test_op13_over_the_whole_table(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    rows = list(zip(table["vec_id"], table["embedding"]))
    got = wh.op13_whitening(spark, str(DATA)).toPandas()
    fine, n, sums, deviations, values, vectors, trace = dense(rows)
    assert len(got) == 4 * len(fine) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    assert got[got["component"] == 1].set_index("vec_id")["deviation"].to_dict() == {i: d for (i, _), d in zip(fine, deviations)}
    for k in range(4):
        mine = got[got["component"] == k + 1].set_index("vec_id")["whitened"]
        want = np.array([(np.array(x) - np.array(sums) / n) @ vectors[:, k] / math.sqrt(values[k]) for _, x in fine])
        mine = mine.loc[[i for i, _ in fine]].to_numpy()
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
