"""Mixing by soft membership: how often each document is taken so that domains reach target weights.

A naive Bayes classifier, fitted and calibrated on the labelled table, gives every document a
posterior over the domains. Documents then get rates r >= least so that the expected tokens of each domain,
sum of r x tokens x posterior, match the targets in the least-squares sense. The descent is
distributed: a step needs only one total for each domain. It moves a document's rate by its
posterior times the domains' residuals, so a rate follows from the posterior and the residuals so far.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KNOWN, beside, cut, small_batches, table, tidied
from .labelled import training_rows

#: Domains of the labelled table, in the order of posteriors.
DOMAINS = ("high", "low", "toxic")
#: Token buckets of the classifier, by a hash: the bound of the model.
BUCKETS = 1 << 18
#: Smoothing in documents, and how far a token's documents must be from chance, in standard deviations, to say anything.
SMOOTHING, LEAST_Z = 5.0, 3.0
#: Most steps of the descent, and the relative residual at which it ends.
STEPS, TOLERANCE = 30, 1e-3
TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Classifier:
    log_odds: np.ndarray  # buckets x domains
    weights: np.ndarray  # features x domains


def tokens_of(text: str) -> list[str]:
    """Lower-cased words and runs of signs."""
    return TOKEN.findall(text.lower())


def _features(totals: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Of the domains' summed log-odds, in proportion to what chance makes of as many tokens, and damped; and a constant."""
    return np.c_[totals / np.sqrt(np.maximum(distinct, 1))[:, None], np.sign(totals) * np.log1p(np.abs(totals)), np.ones(len(totals))]


def _softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _calibrated(x: np.ndarray, label: np.ndarray, n_domains: int, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights of a multinomial logistic regression, by steps of a bound of its curvature."""
    scale = np.r_[np.maximum(x[:, :-1].std(axis=0), 1e-9), 1.0]
    z, y = x / scale, np.eye(n_domains)[label]
    w, bound = np.zeros((x.shape[1], n_domains)), z.T @ z / len(z) / 2 + ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        w += np.linalg.solve(bound, z.T @ (y - _softmax(z @ w)) / len(z) - ridge * w)
    return w / scale[:, None]


class Buckets(dict):
    """Bucket of each token that was asked for."""

    def __missing__(self, token: str) -> int:
        self[token] = found = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return found


def distinct_buckets(tokens: list[str], known: Buckets) -> np.ndarray:
    own = set(map(known.__getitem__, set(tokens)))
    return np.fromiter(own, np.int64, len(own))


def _summed(texts: list, log_odds: np.ndarray, known: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, distinct tokens and summed log-odds (texts x domains) of whole texts."""
    sizes, distinct, totals = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros((len(texts), log_odds.shape[1]))
    for k, text in enumerate(texts):
        tokens = tokens_of(text or "")
        own = distinct_buckets(tokens, known)
        # In order, so that the sum is the same wherever a text is read.
        own.sort()
        sizes[k], distinct[k], totals[k] = len(tokens), len(own), log_odds[own].sum(axis=0)
    return sizes, distinct, totals


def learn(rows: DataFrame, n_domains: int = len(DOMAINS)) -> Classifier:
    """Fit on a bounded set of labelled texts (text, label: number of the domain). Without any row all domains are alike.

    Half of the rows, by a hash of the text, gives each token's log-odds of each domain (naive Bayes);
    the other half turns a document's sums of these into posteriors that hold on average.
    """

    @tidied
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, docs, known = np.zeros((n_domains, BUCKETS), np.int64), np.zeros(n_domains, np.int64), Buckets()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                sums[label, distinct_buckets(tokens_of(text), known)] += 1
                docs[label] += 1
        label, bucket = np.nonzero(sums)
        yield pd.DataFrame({"label": np.r_[label, np.arange(n_domains)], "bucket": np.r_[bucket, np.full(n_domains, -1)], "n": np.r_[sums[label, bucket], docs]})

    small_batches(rows.sparkSession)
    rows = cut(rows)  # it is read twice
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    found = rows.where(half == 0).mapInPandas(count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()  # n_domains x (BUCKETS + 1) rows at most
    counts, docs = np.zeros((n_domains, BUCKETS)), np.zeros(n_domains)
    totals = found[found["bucket"] < 0]
    docs[totals["label"]] = totals["n"]
    found = found[found["bucket"] >= 0]
    counts[found["label"], found["bucket"]] = found["n"]
    # Every domain is smoothed towards the rate over all, so that small ones don't win by rare tokens.
    rate = (counts.sum(axis=0) + 0.01) / (docs.sum() + 1)
    expected = docs[:, None] * rate
    odds = np.log((counts + SMOOTHING * rate) / (docs[:, None] + SMOOTHING)) - np.log(rate)
    odds[(np.abs(counts - expected) < LEAST_Z * np.sqrt(expected + 1e-9)) | (counts.sum(axis=0) < 3)] = 0
    odds = np.ascontiguousarray(odds.T, np.float32)

    @tidied
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets()
        for batch in batches:
            _, distinct, totals = _summed(batch["text"].tolist(), odds, known)
            yield pd.DataFrame({"label": batch["label"].to_numpy(), "distinct": distinct, "totals": list(totals)})

    rest = rows.where(half == 1).mapInPandas(describe, "label int, distinct long, totals array<double>").toPandas()  # a bounded set
    weights = np.zeros((2 * n_domains + 1, n_domains))
    if len(rest):
        weights = _calibrated(_features(np.stack(rest["totals"]), rest["distinct"].to_numpy()), rest["label"].to_numpy(), n_domains)
    return Classifier(odds, weights)


def posteriors(texts: list, model: Classifier, known: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and posteriors (texts x domains) of whole texts; a text without tokens gets what the constants say."""
    sizes, distinct, totals = _summed(texts, model.log_odds, known)
    return sizes, _softmax(_features(totals, distinct) @ model.weights)


def rates_of(p: np.ndarray, history: list[np.ndarray], least: float) -> np.ndarray:
    """Rates after the steps so far: each starts at max(1, least) and is projected onto r >= least."""
    rate = np.full(len(p), max(1.0, least))
    for step in history:
        rate = np.maximum(least, rate - p @ step)
    return rate


def fit(features: DataFrame, targets: np.ndarray, least: float = 0.0, growth: float = 1.0) -> list[np.ndarray]:
    """Steps of the descent over `features` (n_tokens, posterior: array). `targets` are shares that sum to 1.

    The expected total is `growth` times the tokens there are, whatever the table's size. A domain
    whose target lies below what the least rates give it stays at that. An empty table, or one without
    tokens, needs no step.
    """
    n = len(targets)

    def totals(history: list[np.ndarray], tries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain after the history and each of the steps to try (tries x n), and the Gram matrix; in one pass."""

        @tidied
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, gram = np.zeros((len(tries), n)), np.zeros((n, n))
            for batch in batches:
                if len(batch):
                    p, size = np.stack(batch["posterior"].to_numpy()), batch["n_tokens"].to_numpy(float)
                    so_far = rates_of(p, history, least)
                    for k, step in enumerate(tries):
                        sums[k] += (np.maximum(least, so_far - p @ step) * size) @ p
                    gram += (p * size[:, None]).T @ p
            yield pd.DataFrame({"at": np.arange(sums.size + gram.size), "x": np.r_[sums.ravel(), gram.ravel()]})

        rows = features.mapInPandas(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(tries) * n + n * n)
        for at, x in rows:
            out[at] = x
        return out[: len(tries) * n].reshape(-1, n), out[len(tries) * n :].reshape(n, n)

    history: list[np.ndarray] = []
    (now,), gram = totals(history, [np.zeros(n)])
    if now.sum() <= 0:
        return history
    total = growth * now.sum() / max(1.0, least)  # now holds the rates that the descent starts from
    goal = np.maximum(targets * total, now * least / max(1.0, least))
    # The plain step never leads away from the goal, but is short; longer ones, and steps scaled by the
    # inverse Gram matrix, by which rare domains move as fast as common ones, are tried in the same pass,
    # as are steps of one domain alone.
    plain = np.eye(n) / max(np.linalg.eigvalsh(gram).max(), 1e-12)
    scaled = np.linalg.pinv(gram + 1e-6 * np.trace(gram) * np.eye(n))
    for _ in range(STEPS):
        residual = now - goal
        if np.abs(residual).max() <= TOLERANCE * total:
            break
        tries = [f * (m @ residual) for m, factors in ((scaled, (1, 0.5, 0.2)), (plain, (1, 3, 9, 27))) for f in factors]
        tries += [f * residual * (np.arange(n) == k) / max(gram[k, k], 1e-12) for k in range(n) for f in (0.5, 1, 2)]
        sums, _ = totals(history, tries)
        off = np.linalg.norm(sums - goal, axis=1)
        if off.min() > 0.999 * np.linalg.norm(residual):
            break  # this is as near as the bounds allow
        history.append(tries[int(off.argmin())])
        now = sums[int(off.argmin())]
    return history


def domain_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts with the number of their domain: toxic, else high or low quality."""
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality") == 0, 1)
    return training_rows(docs, labels.withColumn("domain", domain), "domain")


def mix(docs: DataFrame, model: Classifier, targets: dict[str, float], least: float = 0.0, growth: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posterior and rate of every document: the id, n_tokens, posterior (array in the order of DOMAINS), rate.

    Null and empty texts have no token and thus no say in the totals; they get a posterior and a rate
    all the same. Domains without a target get none. Very long texts are read whole, and count by
    their tokens. Repeated rows count each; an empty table gives no row; other columns are not read.
    """
    features, history = _fitted(docs, model, targets, least, growth, id_col, text_col)

    @F.pandas_udf("double")
    def rate(posterior: pd.Series) -> pd.Series:
        return pd.Series(rates_of(np.stack(posterior.to_numpy()), history, least) if len(posterior) else np.zeros(0))

    return features.withColumn("rate", rate("posterior"))


def _fitted(docs: DataFrame, model: Classifier, targets: dict[str, float], least: float, growth: float, id_col: str, text_col: str) -> tuple[DataFrame, list[np.ndarray]]:
    small_batches(docs.sparkSession)
    shares = np.array([max(0.0, targets.get(d, 0.0)) for d in DOMAINS])
    if shares.sum() <= 0:
        raise ValueError("at least one domain needs a positive target")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Buckets()
        for texts in batches:
            if len(known) > KNOWN:
                known.clear()
            sizes, p = posteriors(texts.tolist(), sent.value, known)
            yield pd.DataFrame({"n_tokens": sizes, "posterior": list(p)})

    features = cut(beside(docs, id_col, text_col, describe, "n_tokens long, posterior array<double>"))
    return features, fit(features.select("n_tokens", "posterior"), shares / shares.sum(), least, growth)


def take(docs: DataFrame, model: Classifier, targets: dict[str, float], least: float = 0.0, growth: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as its rate says, columns as they are.

    A rate's fraction is rounded up or down by a hash of id and text, in proportion. The rate follows
    from the text alone once the descent is done, so it is computed beside the text, without a join.
    """
    _, history = _fitted(docs, model, targets, least, growth, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidied
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Buckets()
        for texts in batches:
            if len(known) > KNOWN:
                known.clear()
            yield pd.Series(rates_of(posteriors(texts.tolist(), sent.value, known)[1], history, least))

    own = docs.columns
    even = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    rated = docs.select(F.struct(*own).alias("doc"), rate(F.col(text_col)).alias("rate"), even.alias("even"))
    copies = (F.floor("rate") + F.when(F.col("rate") - F.floor("rate") > F.col("even"), 1).otherwise(0)).cast("int")
    rated = rated.select("doc", copies.alias("copies")).where("copies > 0")
    return rated.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


#: Shares of tokens that op1 asks for.
TARGETS = {"high": 0.80, "low": 0.15, "toxic": 0.05}


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed = mix(docs, learn(domain_rows(docs, labels)), TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate")
