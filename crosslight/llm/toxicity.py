"""Toxic passages by maximum-scoring segments.

Each token has a log-odds score of toxic against other text, smoothed by a Dirichlet prior. A linear
scan finds every maximal segment of a document's scores. How high a segment scores by chance follows
an extreme-value law that is fitted on clean documents; segments beyond it are the toxic passages, and
their joint significance becomes the document's calibrated score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KNOWN, beside, cut, small_batches, tidied, words
from .labelled import labelled_tables, remainder, training_rows
from .quality import logistic

#: Tokens are counted in this many buckets by their hash: the bound of what is sent to the driver and the tasks.
BUCKETS = 1 << 20
#: Weight of the Dirichlet prior in tokens, the least z for a token to count, and the cost of any token in a segment.
PRIOR, LEAST_Z, COST = 2_000.0, 3.0, 0.15
#: A segment is significant if as high a one is expected in less than this many clean documents of the same length.
LEVEL = 0.01


@dataclass(frozen=True)
class Model:
    """Score of each token bucket, the extreme-value law's two parameters, and the calibration's weights."""

    scores: np.ndarray
    rate: float
    log_k: float
    weights: tuple[float, float]


def buckets_of(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    for token in set(tokens):
        if token not in known:
            known[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
    return np.fromiter((known[t] for t in tokens), np.int64, len(tokens))


def token_counts(rows: DataFrame) -> np.ndarray:
    """2 x BUCKETS counts of the documents with a token, over all labelled rows (text, label); added up in the tasks first."""

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, known = np.zeros((2, BUCKETS), np.int64), {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                sums[min(1, max(0, int(label))), np.unique(buckets_of(words(text), known))] += 1
            if len(known) > KNOWN:
                known.clear()
        label, bucket = np.nonzero(sums)
        yield pd.DataFrame({"label": label, "bucket": bucket, "n": sums[label, bucket]})

    parts = rows.mapInPandas(count, "label int, bucket int, n long")
    found = parts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 x BUCKETS rows
    out = np.zeros((2, BUCKETS))
    out[found["label"], found["bucket"]] = found["n"]
    return out


def token_scores(counts: np.ndarray) -> np.ndarray:
    """Log-odds under a Dirichlet prior in proportion to the whole corpus; what is not significant scores 0. Each token costs COST."""
    both = counts.sum(axis=0)
    prior = PRIOR * (both + 1e-9) / (both + 1e-9).sum() + 0.01
    odds, spread = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for k, sign in ((1, 1.0), (0, -1.0)):
        own = counts[k] + prior
        odds += sign * np.log(own / (own.sum() - own))
        spread += 1 / own
    odds[(odds / np.sqrt(spread) < LEAST_Z) & (odds > 0)] = 0
    return np.clip(odds, -1.0, 8.0) - COST


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass.

    Each new positive stretch is joined with earlier ones as long as that makes a higher segment:
    `low` is the running total before a candidate and `high` the total after it.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    total = np.cumsum(scores)
    rising = scores > 0
    starts = np.flatnonzero(rising & ~np.r_[False, rising[:-1]])
    ends = np.flatnonzero(rising & ~np.r_[rising[1:], False]) + 1
    stack: list[list] = []  # start, end, low, high, place of the nearest earlier candidate with a lower low
    for start, end in zip(starts.tolist(), ends.tolist()):
        low, high = (float(total[start - 1]) if start else 0.0), float(total[end - 1])
        while True:
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= low:
                at = stack[at][4]
            if at < 0 or stack[at][3] >= high:
                stack.append([start, end, low, high, at])
                break
            start, low = stack[at][0], stack[at][2]
            del stack[at:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def highest(scores: np.ndarray) -> float:
    """Score of the best segment."""
    if not len(scores):
        return 0.0
    total = np.r_[0.0, np.cumsum(scores)]
    return float((total - np.minimum.accumulate(total)).max())


def _scanned(rows: DataFrame, scores: np.ndarray) -> pd.DataFrame:
    """Best segment and length of each labelled row, a bounded sample."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            found = [buckets_of(words(t), known) for t in batch["text"]]
            yield pd.DataFrame({"best": [highest(scores[x]) for x in found], "n": [len(x) for x in found], "evidence": 0.0, "label": batch["label"].to_numpy()})

    return rows.mapInPandas(run, "best double, n long, evidence double, label int").toPandas()


def extreme_law(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and log K of P(best segment of n tokens >= x) = 1 - exp(-K n exp(-rate x)), by moments over clean documents."""
    rate, log_k = 1.0, 0.0
    n = np.log(np.maximum(n, 1))
    if len(best) >= 10:
        for _ in range(50):
            rest = best - n / rate
            rate = float(np.clip(np.pi / np.sqrt(6) / max(rest.std(), 1e-3), 0.05, 5.0))
        rest = best - n / rate
        log_k = float(rate * rest.mean() - 0.57722)
    return rate, log_k


def evidence(found: list[tuple[int, int, float]], n: int, rate: float, log_k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum over the significant segments of -log(expected number by chance / LEVEL), and those segments."""
    start = log_k + np.log(max(n, 1)) - np.log(LEVEL)
    kept = [x for x in found if rate * x[2] > start]
    return float(sum(rate * x[2] - start for x in kept)), kept


def learn(rows: DataFrame) -> Model:
    """Fit on a bounded set of labelled whole texts (text, label).

    The extreme-value law is fitted on the clean rows but the highest hundredth of them: where labels
    are noisy that hundredth holds toxic texts labelled clean, and a few of them would raise the law's
    scale and hide passages. Without rows of both labels every score is the share of label 1 (0.5
    without any row).
    """
    small_batches(rows.sparkSession)
    rows = cut(rows)  # it is read three times
    counts = token_counts(rows)
    scores = token_scores(counts)
    seen = _scanned(rows, scores)
    clean = seen[seen["label"] == 0]
    usual = clean["best"] <= clean["best"].quantile(0.99) if len(clean) else []  # the last hundredth holds what was labelled wrongly
    rate, log_k = extreme_law(clean["best"][usual].to_numpy(), clean["n"][usual].to_numpy()) if len(clean) else (1.0, 0.0)
    y = (seen["label"] > 0).to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(scores, rate, log_k, (0.0, float(np.log(share / (1 - share)))))
    strength = np.maximum(0, rate * seen["best"] - log_k - np.log(np.maximum(seen["n"], 1)) + np.log(LEVEL)).to_numpy()
    weights = logistic(np.stack([np.log1p(strength), np.ones(len(y))], axis=1), y)
    return Model(scores.astype(np.float32), rate, log_k, tuple(map(float, weights)))


def _assess(texts: pd.Series, model: Model, known: dict[str, int]) -> tuple[np.ndarray, list[int], list[list[dict]]]:
    """Scores, tokens and significant passages of whole texts."""
    floor = model.log_k - np.log(LEVEL)
    strengths, sizes, passages = [], [], []
    for text in texts:
        at = buckets_of(words(text or ""), known)
        scores = model.scores[at].astype(float)
        strength, kept = 0.0, []
        if model.rate * highest(scores) > floor + np.log(max(len(at), 1)):
            strength, kept = evidence(segments(scores), len(at), model.rate, model.log_k)
        strengths.append(strength)
        sizes.append(len(at))
        passages.append([{"start": a, "end": b, "score": s} for a, b, s in kept])
    z = model.weights[0] * np.log1p(np.array(strengths, float)) + model.weights[1]
    return 1 / (1 + np.exp(-z)), sizes, passages


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: the id, score, n_tokens, passages.

    `passages` lists the significant segments as (start, end, score) in tokens; a text without one,
    an empty and a null text get the calibration's lowest score and no passage. Texts of any length are
    scanned whole, in one pass. Repeated rows are scored each; an empty table gives no row; other
    columns are not read. The model has a fixed bound and is broadcast.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for texts in batches:
            if len(known) > KNOWN:
                known.clear()
            scores, sizes, passages = _assess(texts, sent.value, known)
            yield pd.DataFrame({"score": scores, "n_tokens": sizes, "passages": passages})

    return beside(docs, id_col, text_col, run, "score double, n_tokens long, passages array<struct<start:int,end:int,score:double>>")


def score_column(spark, model: Model, text_col: str) -> F.Column:
    """The score of `score` as a column beside the text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidied
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            if len(known) > KNOWN:
                known.clear()
            yield pd.Series(_assess(texts, sent.value, known)[0])

    return scored(F.col(text_col))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = labelled_tables(spark, sf_dir)
    held_out = remainder("doc_id", 5) == 0
    model = learn(training_rows(docs, labels, "toxic", held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", F.size("passages").alias("n_passages")
    )
