"""Whitening of embeddings by LOBPCG.

The covariance matrix is never formed. Every iteration multiplies it with a block of a few directions
in one Spark job: each task centres its rows, projects them on the block and projects the result back,
and the partial products are summed by Spark. On the driver, Rayleigh and Ritz's method picks the best
directions out of the current iterate, its residuals and the previous directions. It ends when a
fresh product certifies that the residuals are small; then rows are whitened on the directions found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_batches, table

#: Directions that are iterated beside those asked for; they keep the distance to the next eigenvalue large.
GUARD = 8
#: Largest residual, as a share of the largest eigenvalue, that counts as converged, and the most iterations.
TOLERANCE, ITERATIONS = 1e-13, 500
#: Iterations after which products that were carried along are made anew, so that rounding doesn't add up.
REFRESH = 12
#: Vectors of a packed block, and bytes of a partition of blocks.
BLOCK_ROWS, PART_BYTES = 4_096, 1 << 26
#: Components whose eigenvalue is below this share of the trace are rounding, not variance.
LEAST_VARIANCE = 1e-12


def usable(embeddings: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """Rows whose vector and components are neither null nor non-finite, in whole numbers: the id, and x, the floor of `scale` times each component as a double.

    A shorter vector counts as one filled up with zeros.
    """
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(F.col(vector_col).isNotNull() & fine).select(id_col, F.transform(vector_col, lambda c: F.floor(scale * c.cast("double"))).alias("x"))
    shortest, longest = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != longest:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))))
    return rows


def packed(vectors: DataFrame) -> DataFrame:
    """Vectors (x) in blocks: n, dims, and the vectors as 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in range(0, len(batch), BLOCK_ROWS):
                x = np.stack(batch["x"].iloc[k : k + BLOCK_ROWS].to_list()).astype("<i8")
                rows.append((len(x), x.shape[1], x.tobytes()))
            yield pd.DataFrame(rows, columns=["n", "dims", "data"])

    return vectors.select("x").mapInPandas(run, "n int, dims int, data binary")


def summed(blocks: DataFrame, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a small matrix that `of_block` makes of a block's vectors.

    A task gives one matrix, some tasks add these up, and the driver gets no more than the root of their number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        total = None
        for batch in batches:
            for n, dims, data in zip(batch["n"], batch["dims"], batch["data"]):
                part = of_block(np.frombuffer(data, "<i8").reshape(n, dims))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"rows": [total.shape[0]], "data": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, total = None, None
        for batch in batches:
            for rows, data in zip(batch["rows"], batch["data"]):
                total = np.frombuffer(data) if total is None else total + np.frombuffer(data)
        if total is not None:
            yield pd.DataFrame({"rows": [rows], "data": [total.tobytes()]})

    some = max(1, math.isqrt(blocks.rdd.getNumPartitions() // 16))
    parts = blocks.mapInPandas(run, "rows int, data binary").repartition(some).mapInPandas(added, "rows int, data binary").collect()
    return sum(np.frombuffer(p["data"]).reshape(p["rows"], -1) for p in parts)


def exact_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Vectors, and the exact sum of each dimension as whole numbers of any size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, dims, data in zip(batch["n"], batch["dims"], batch["data"]):
                x = np.frombuffer(data, "<i8").reshape(n, dims)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # halves of a block's numbers don't leave a long
                yield pd.DataFrame({"row": np.arange(dims, dtype=np.int32), "n": np.int64(n), "high": high, "low": low})

    wide = "decimal(38,0)"
    sums = blocks.mapInPandas(run, "row int, n long, high long, low long").groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    found = sorted(sums.collect(), key=lambda r: r["row"])
    return (int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]) if found else (0, [])


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what a block's columns add to `against` (itself orthonormal); columns that add nothing are left out."""
    sizes = np.linalg.norm(block, axis=0)
    block = block[:, sizes > 0] / sizes[sizes > 0]
    for _ in range(2):  # once more, against rounding
        if against is not None and block.shape[1]:
            block = block - against @ (against.T @ block)
        if not block.shape[1]:
            return block
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-10 * max(1.0, strength.max())]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The largest eigenvalues of a symmetric matrix that is only known by `product`, its product with a block, and their unit eigenvectors.

    Values, vectors (columns), certified residual norms, and iterations. A run that doesn't converge is an error.
    """
    wanted, width = min(wanted, dims), min(wanted + guard, dims)
    iterate = orthonormal(np.random.default_rng(1).normal(size=(dims, width)))
    image, before, image_before = product(iterate), np.zeros((dims, 0)), np.zeros((dims, 0))
    fresh = True
    for step in range(iterations):
        values, turn = np.linalg.eigh(_even(iterate.T @ image))
        values, turn = values[::-1], turn[:, ::-1]
        iterate, image = iterate @ turn, image @ turn
        residual = image - iterate * values
        norms = np.linalg.norm(residual[:, :wanted], axis=0)
        if (norms <= tolerance * max(values[0], 0)).all():
            if fresh:
                return values[:wanted], iterate[:, :wanted], norms, step
            iterate = orthonormal(iterate)
            image, before, image_before, fresh = product(iterate), before[:, :0], image_before[:, :0], True
            continue
        search = orthonormal(residual, iterate)
        basis = np.hstack([iterate, search])
        image_search = product(search) if search.shape[1] else search
        images = np.hstack([image, image_search])
        if before.shape[1]:
            # Previous directions with their images, made orthogonal to the rest by the same combination of both.
            mix = basis.T @ before
            before, image_before = before - basis @ mix, image_before - images @ mix
            sizes, turn = np.linalg.eigh(_even(before.T @ before))
            kept = sizes > 1e-16 * max(sizes.max(), 1e-300)
            turn = turn[:, kept] / np.sqrt(sizes[kept])
            basis, images = np.hstack([basis, before @ turn]), np.hstack([images, image_before @ turn])
        fresh = (step + 1) % REFRESH == 0
        gram = basis.T @ basis
        lower = np.linalg.cholesky(_even(gram))
        inverse = np.linalg.inv(lower).T
        _, ritz = np.linalg.eigh(_even(inverse.T @ _even(basis.T @ images) @ inverse))
        choice = inverse @ ritz[:, ::-1][:, :width]
        away = choice.copy()
        away[:width] = 0  # the part that leads away from the iterate
        before, image_before = basis @ away, images @ away
        iterate, image = basis @ choice, images @ choice
        if fresh:
            iterate = orthonormal(iterate)
            image, before, image_before = product(iterate), before[:, :0], image_before[:, :0]
    raise ArithmeticError(f"residuals {norms} after {iterations} iterations")


def _even(matrix: np.ndarray) -> np.ndarray:
    """The symmetric part, without rounding's other one."""
    return (matrix + matrix.T) / 2


@dataclass
class Whitening:
    """What whitening needs; all of it is of the size of a few vectors."""

    n: int
    sums: list[int]
    components: np.ndarray  # columns, unit length
    eigenvalues: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, wanted: int = 4) -> Whitening:
    """Fits on each distinct vector (x, whole numbers) once.

    Components have unit length and stand by falling eigenvalue; those without variance are left out,
    so there are none for equal vectors or none at all. Copies are united before anything is shuffled.
    """
    small_batches(vectors.sparkSession, 8)
    rows, dims = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(8 * rows * (dims or 0) / PART_BYTES))
    blocks = cut(packed(vectors.select("x").distinct()).coalesce(parts))
    n, sums = exact_sums(blocks)
    if not sums:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0)
    mean = _ratio(sums, n)

    def product(block: np.ndarray) -> np.ndarray:
        def own(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(blocks, own) / n

    trace = float(summed(blocks, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0.0, 0.0)
    values, components, residuals, _ = lobpcg(product, len(sums), wanted)
    kept = values > LEAST_VARIANCE * trace
    values, components, residuals = values[kept], components[:, kept], residuals[kept]
    scaled = components / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled
        return np.hstack([w.T @ w, w.sum(axis=0)[:, None]])

    moments = summed(blocks, spread) / n
    covariance = moments[:, :-1] - np.outer(moments[:, -1], moments[:, -1])
    return Whitening(n, sums, components, values, residuals, trace, float(np.abs(covariance - np.eye(len(values))).max()))


def _ratio(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums])  # of whole numbers, rounded once


def whiten(vectors: DataFrame, fitted: Whitening, id_col: str) -> DataFrame:
    """For each row (the id, x) and component: component (from 1), n, deviation, whitened, explained, identity_error.

    deviation is the exact sum over dimensions of (n * x - sum)^2, null where it doesn't fit a long.
    Repeated rows are whitened each.
    """
    sums, n, k = fitted.sums, fitted.n, len(fitted.eigenvalues)
    mean, scaled = _ratio(sums, n) if n else np.zeros(0), fitted.components / np.sqrt(fitted.eigenvalues) if k else fitted.components
    whole = np.array(sums, dtype=object)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for xs in batches:
            if not len(xs) or not k:
                yield pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "w": pd.Series([], dtype=object)} if not len(xs) else {"deviation": pd.array([None] * len(xs), "Int64"), "w": [[]] * len(xs)})
                continue
            x = np.stack(xs.to_list())
            reach = (n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)) ** 2 * x.shape[1]
            away = n * x - whole.astype(np.int64) if reach < 1 << 63 else n * x.astype(object) - whole
            squares = [int(v) for v in (away * away).sum(axis=1)]
            yield pd.DataFrame({"deviation": pd.array([v if v < 1 << 63 else None for v in squares], "Int64"), "w": list((x - mean) @ scaled)})

    made = F.pandas_udf(run, "deviation long, w array<double>")
    each = vectors.select(F.col(id_col), made("x").alias("_made")).select(id_col, "_made.deviation", F.posexplode("_made.w").alias("_k", "whitened"))
    shares = F.array(*(F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues)) if k else F.array().cast("array<double>")
    return each.select(
        id_col, (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.try_element_at(shares, F.col("_k") + 1).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whiten(rows, fit(rows), "vec_id")
