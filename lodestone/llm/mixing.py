"""Soft-membership mixing of documents to target domain weights.

A naive-Bayes classifier, learned from a labelled table, gives every document a
posterior over domains, so a document may count for several.  Nonnegative rates
for all documents are then fitted by projected-gradient least squares: the
expected tokens of each domain, sum over documents of rate * tokens * posterior,
shall match its target.  The sums of a step have one number for each domain;
each step maps over a written table of posteriors, in which a document's rate is
replayed from the steps so far, so no state is carried and lost tasks can rerun.
"""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, hash_bytes
from .shared import dropped, texts, written

LOWER = bytes(range(256)).lower()
FEATURES = 1 << 14
#: Domains at most: the driver holds FEATURES numbers for each.
MOST_DOMAINS = 256
#: Evidence of a document is scaled to at most this many words, as words are not independent.
MOST_EVIDENCE = 20.0


def features(text: bytes) -> np.ndarray:
    """Feature of each word of a text, hashed to FEATURES."""
    return (hash_bytes(text.translate(LOWER))[0] % U(FEATURES)).astype(np.int64)


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes over hashed words: log odds by feature and domain."""

    domains: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray  # FEATURES x domains

    def posterior(self, text: bytes) -> tuple[np.ndarray, int]:
        at = features(text)
        score = np.log(self.prior)
        if len(at):
            score = score + self.weights[at].sum(axis=0) * min(1.0, MOST_EVIDENCE / len(at))
        score = np.exp(score - score.max())
        return score / score.sum(), len(at)


def fit_classifier(docs: DataFrame, labelled: DataFrame, max_rows: int = 20_000) -> Classifier:
    """Learn from at most about max_rows labelled rows (doc_id, domain), a sample by hash of the id.

    Rows with a null id or domain are not used; an id labelled twice counts with
    its least domain.  Domains are those of the sample; more than MOST_DOMAINS
    raise a ValueError, as the driver holds the model.
    """
    own = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    n_domains = own.select("domain").distinct().count()
    if n_domains > MOST_DOMAINS:
        raise ValueError(f"{n_domains} domains, {MOST_DOMAINS} at most")
    # max_rows rows give or take sampling noise: a proven bound, so it is broadcast
    sample = texts(docs).join(F.broadcast(own), "doc_id").select("text", "domain")

    def count(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        seen: Counter = Counter()
        for batch in batches:
            for text, domain in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("domain").to_pylist()):
                seen[domain] += 1
                total.setdefault(domain, np.zeros(FEATURES))[np.unique(features(text))] += 1.0
        for domain, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([domain]), pa.array([seen[domain]], pa.int64()), pa.array([x.tolist()], pa.list_(pa.float64()))], ["domain", "n", "seen"])

    rows = sample.mapInArrow(count, "domain string, n long, seen array<double>").select("domain", "n", F.posexplode("seen").alias("at", "x")).groupBy("domain", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("x > 0 or at = 0").collect()
    domains = tuple(sorted({r["domain"] for r in rows}))
    if not domains:
        return Classifier(("",), np.ones(1), np.zeros((FEATURES, 1)))
    k = {d: i for i, d in enumerate(domains)}
    seen, size = np.zeros((FEATURES, len(domains))), np.zeros(len(domains))
    for r in rows:
        seen[r["at"], k[r["domain"]]] = r["x"]
        size[k[r["domain"]]] = max(size[k[r["domain"]]], r["n"])
    share = (seen + 0.1) / (size + 0.2)
    return Classifier(domains, (size + 1) / (size + 1).sum(), np.log(share) - np.log(share.mean(axis=1, keepdims=True)))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p): p has one posterior for each domain.  Tokens are words, and one for the end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            own = [m.posterior(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n + 1 for _, n in own], pa.int64()), pa.array([p.tolist() for p, _ in own], pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def matrix(batch) -> np.ndarray:
    """The posteriors of a batch, a row for each document."""
    return batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def replayed(p: np.ndarray, steps: list[tuple[np.ndarray, float]], most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point of the next step) after the accelerated steps (direction, momentum) from rate 1; rates lie between 0 and most."""
    rate = point = np.ones(len(p))
    for direction, momentum in steps:
        after = np.clip(point - p @ direction, 0.0, most)
        point = after + momentum * (after - rate)
        rate = after
    return rate, point


@dataclass(frozen=True)
class Fit:
    """converged: whether every domain is within the tolerance of its target."""

    domains: tuple[str, ...]
    targets: np.ndarray
    reached: np.ndarray
    steps: list
    most: float = np.inf
    converged: bool = True


def less_poor(domains: tuple[str, ...], share: float = 0.25) -> dict[str, float]:
    """Emphasis under which domains of poor quality keep a quarter of their share."""
    return {d: share if d.endswith("-poor") else 1.0 for d in domains}


def fit_rates(table: DataFrame, domains: tuple[str, ...], weights: dict[str, float] | None = None, rounds: int = 80, tolerance: float = 1e-4, most: float = np.inf) -> Fit:
    """Steps whose replay gives each document's rate.

    weights: target share of each domain; by default the shares of the documents
    times less_poor.  The total is the largest for which no domain needs more
    tokens than it has.  most: the largest rate.  Gradients are taken in a metric
    in which a document's step doesn't depend on its length.  Where the targets
    aren't met within tolerance after all rounds, converged is False and a
    warning says how far off they are.
    """
    k = len(domains)

    def sums(steps, gram):
        size = 2 * k + (k * k if gram else 0)

        def run(batches):
            import pyarrow as pa

            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    p = matrix(batch)
                    t = batch.column("n_tokens").to_numpy().astype(np.float64)
                    rate, point = replayed(p, steps, most)
                    total[:k] += (rate * t) @ p
                    total[k : 2 * k] += (point * t) @ p
                    if gram:
                        total[2 * k :] += ((p * t[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

        # one row of k numbers for each task
        parts = table.select("n_tokens", "p").mapInArrow(run, "s array<double>")
        got = parts.agg(*[F.sum(F.col("s")[i]) for i in range(size)]).first()
        total = np.array([x or 0.0 for x in got])
        return total[:k], total[k : 2 * k], total[2 * k :].reshape(-1, k)

    have, _, gram = sums([], True)
    if not have.sum():
        return Fit(domains, have, have, [])
    if weights is None:
        share = have * np.array([less_poor(domains)[d] for d in domains])
        share = share / share.sum()
    else:
        share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
        share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    targets = share * np.min(have[share > 0] / share[share > 0])
    step = 1 / np.linalg.eigvalsh(gram).max()
    steps, reached, at, theta = [], have, have, 1.0
    for _ in range(rounds):
        ahead = (1 + np.sqrt(1 + 4 * theta * theta)) / 2
        before = np.abs(reached - targets).sum()
        steps.append((step * (at - targets), (theta - 1) / ahead))
        theta = ahead
        reached, at, _ = sums(steps, False)
        if np.abs(reached - targets).sum() > before:  # overshoot: the momentum starts anew
            theta = 1.0
        if np.abs(reached - targets).max() <= tolerance * targets.sum():
            break
    off = float(np.abs(reached - targets).max() / targets.sum())
    if off > tolerance:
        warnings.warn(f"domain totals are off their targets by up to {off:.2g} of all tokens", stacklevel=2)
    return Fit(domains, targets, reached, steps, most, off <= tolerance)


def rated(table: DataFrame, fit: Fit) -> DataFrame:
    """The table of posteriors with each document's rate."""
    steps, most = fit.steps, fit.most

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            p = matrix(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replayed(p, steps, most)[0], pa.float64())], [*batch.schema.names, "rate"])

    return table.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in table.schema)}, rate double")


def mix_to_targets(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), p (posteriors in order of domains), rate.

    Null text is empty: its posterior is the prior, its one token the end.
    Repeated rows get equal rates, a null doc_id stays null, an empty table gives
    no rows, other columns are ignored.  Without labelled rows all documents are
    of one domain "" and keep rate 1.
    """
    model = fit_classifier(docs, labelled)
    table = written(posteriors(docs, model))
    fit = fit_rates(table, model.domains, weights)
    names = F.array(*[F.lit(d) for d in model.domains])
    return rated(table, fit).select("doc_id", "n_tokens", names[F.array_position("p", F.array_max("p")).cast("int") - 1].alias("domain"), "p", "rate")


def keep_by_rate(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each with a chance of its rate, drawn by a hash of its id and text.

    Rates are fitted between 0 and 1, so the drawn rows meet the targets in
    expectation.  Null text is empty; rows that repeat an id and text are kept or
    dropped together; an empty table stays empty.
    """
    model = fit_classifier(docs, labelled)
    table = written(posteriors(docs, model))
    fit = fit_rates(table, model.domains, weights, most=1.0)
    dropped(table)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    steps, most = fit.steps, fit.most

    @F.pandas_udf("double")
    def rate(col):
        import pandas as pd

        p = np.array([shared.value.posterior((x or "").encode())[0] for x in col]).reshape(len(col), -1)
        return pd.Series(replayed(p, steps, most)[0])

    chance = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    return docs.where(chance < rate("text"))


def language_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): language and quality label of the labelled documents."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    lang = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    domain = F.concat_ws("-", "lang", F.when(F.col("quality") > 0, "good").otherwise("poor"))
    return own.where("quality is not null").join(lang, "doc_id").select("doc_id", domain.alias("domain"))
