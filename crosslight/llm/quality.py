"""Quality by compression: which dictionary, built of good or of bad text, makes a text smaller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, small_batches
from .labelled import labelled_tables, remainder, training_rows

#: Bounds of what is learned: whole texts of either label, their bytes in all, bytes of a dictionary; bytes of text for each byte of a dictionary.
ROWS_A_LABEL, BYTES_A_LABEL, DICTIONARY_BYTES, BYTES_FOR_ONE = 1_500, 1 << 24, 65_536, 10
#: A text is compressed in stretches of this many bytes, so that the dictionary counts all along it.
STRETCH, LEVEL = 2_048, 3
#: Bytes of a piece of a labelled text from which a dictionary is trained.
SAMPLE = 512


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic curve over the features."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _compressors(good: bytes, bad: bytes) -> list:
    import zstandard

    out = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def compressed_sizes(text: str, compressors: list) -> tuple[int, int, int]:
    """Bytes of the whole text, and of its stretches compressed with the good and the bad dictionary."""
    data = text.encode("utf-8", "replace")
    good, bad = compressors
    a = b = 0
    for at in range(0, len(data), STRETCH):
        piece = data[at : at + STRETCH]
        a += len(good.compress(piece))
        b += len(bad.compress(piece))
    return len(data), a, b


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised compressed-size difference, alone and with the text's length, and a constant."""
    n, good, bad = sizes.T.astype(float)
    gain = (bad - good) / np.maximum(good + bad, 1)
    return np.stack([gain, gain * np.log1p(n) / 10, np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton's method; the last column is the constant."""
    scale = np.r_[np.maximum(x[:, :-1].std(axis=0), 1e-9), 1.0] if len(x) else np.ones(x.shape[1])
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (y - p) - ridge * len(x) * w * np.r_[np.ones(len(w) - 1), 0])
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def learn(rows: DataFrame) -> Model:
    """Fit on a bounded set of labelled texts (text, label; `training_rows`).

    Of either label whole texts are taken by a hash of the text, at most ROWS_A_LABEL of them and
    BYTES_A_LABEL in all. Every other one makes the dictionaries, from stretches all along it; the rest
    make the curve, so that the curve sees texts that the dictionaries haven't. Without rows of both
    labels, or with too little text for zstandard to train on, every score is the share of label 1
    (0.5 without any row).
    """
    import zstandard

    spark = rows.sparkSession
    rows = cut(rows)
    sized = rows.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"), "label").toPandas()
    base = ((sized["label"] == 1).sum() + 1) / (len(sized) + 2)
    nothing = Model(b"", b"", (0.0, 0.0, float(np.log(base / (1 - base)))))
    chosen = []
    for _, own in sized[sized["size"] <= BYTES_A_LABEL].sort_values(["hash", "row"]).groupby("label"):
        own = own.head(ROWS_A_LABEL)
        chosen += own["row"][own["size"].cumsum() <= BYTES_A_LABEL].tolist()
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in chosen], "row long"))
    texts_of = rows.select(F.monotonically_increasing_id().alias("row"), "text", "label").join(wanted, "row").orderBy(F.xxhash64("text"), "row").collect()
    by = {y: [r.text for r in texts_of if r.label == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return nothing
    dictionaries = []
    for y in (1, 0):
        samples = [data[at : at + SAMPLE] for data in (t.encode("utf-8", "replace") for t in by[y][::2]) for at in range(0, len(data), SAMPLE)]
        size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // BYTES_FOR_ONE))
        try:
            dictionaries.append(zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes())
        except (zstandard.ZstdError, ValueError):
            return nothing
    compressors = _compressors(*dictionaries)
    texts, y = [], []
    for label in (0, 1):
        own = by[label][1::2] or by[label]
        texts += own
        y += [label] * len(own)
    x, y = features(np.array([compressed_sizes(t, compressors) for t in texts])), np.array(y, float)
    weights = logistic(x, y)
    # Both labels were taken alike, so the constant is moved to the shares that the labels have.
    weights[-1] += np.log(base / (1 - base)) - np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    return Model(*dictionaries, tuple(map(float, weights)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probability that a whole text is good: the id, score, n_bytes, good_bytes, bad_bytes.

    Null counts as empty; an empty text has no difference and gets the curve's constant. Texts of any
    length are compressed whole, stretch by stretch. Repeated rows are scored each; an empty table
    gives no row; other columns are not read. The dictionaries have a fixed bound and go with the tasks.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(model.good, model.bad) if model.good else None
        for texts in batches:
            sizes = np.array([compressed_sizes(t or "", compressors) if compressors else (len((t or "").encode("utf-8", "replace")), 0, 0) for t in texts], np.int64).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(features(sizes) @ np.array(model.weights), -30, 30)))
            yield pd.DataFrame({"score": p, "n_bytes": sizes[:, 0], "good_bytes": sizes[:, 1], "bad_bytes": sizes[:, 2]})

    return beside(docs, id_col, text_col, run, "score double, n_bytes long, good_bytes long, bad_bytes long")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = labelled_tables(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    model = learn(training_rows(docs, labels, "quality", held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_bytes", "good_bytes", "bad_bytes"
    )
