"""Soft-membership mixing: posteriors from a labelled table, document rates by projected-gradient least squares.

Documents belong to domains softly.  A multinomial logistic classifier, fitted on a bounded sample of
labelled rows, becomes an expression for each domain's posterior.  The rate of a document says how often
it is to be read; rates are found so that the expected tokens of each domain, the sum of rate times tokens
times posterior, meet the targets as least squares, with every rate at least 0 (a highest rate can be given).

Rates stay near 1 where the targets leave them free: the objective is half the squared residual of the domains' token
shares plus RIDGE times half the squared distance of the rates from 1, weighted by tokens.  In that weighting the
gradient of document d is ``p_d . residual + RIDGE * (z - 1)``, so a step of length s from 1 leads to ``1 - p_d . u``
with u = s * residual, and every later one, taken before the projection (z) and projected when rates are read, to
``rate = min(highest, max(0, 1 - p_d . u))`` with ``u <- u + s * (residual - RIDGE * u)``: K numbers that all documents
share.  A step is one aggregation of the member table to K numbers, the expected tokens of the domains at the projected
rates; no rate is ever stored, moved or collected.  The step length is the inverse of the largest eigenvalue of the
domains' normal matrix, so that no step overshoots; the last `MEMORY` steps are combined (Anderson's extrapolation),
and where that moves far away from the optimality condition the plain step is taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import fenced
from eligspark.llm.quality import SYMBOLS, words_of, without
from eligspark.storage import materialize

#: Domains of the labelled table, in the order in which they are tested, and their target shares of all tokens.
DOMAINS = ("toxic", "low", "clean")
TARGETS = {"toxic": 0.05, "low": 0.10, "clean": 0.85}
#: Labelled rows for fitting, at most (those of the lowest hashed ids), and telling words for each domain.
MOST_LABELLED = 6_000
MOST_WORDS = 40
HIGHEST_RATE, RIDGE = math.inf, 5e-4
#: Gradient steps at most, and the size of the gradient at which they end.
MOST_STEPS, TOLERANCE = 60, 1e-6
#: Steps that are combined, and how much further from optimal than before a combined one may be.
MEMORY, FURTHEST = 3, 10.0


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


@dataclass
class Classifier:
    """Telling words by domain, and the weights of the features (the last row is the intercept) for each domain."""

    words: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def features(self) -> list[Column]:
        """Expressions over the columns that `measured` makes."""
        n = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
        hits = [F.log1p(F.col(f"__hits_{d}").cast("double")) for d in DOMAINS if self.words.get(d)]
        return [F.log1p(F.col("n_tokens").cast("double")), F.col("__bytes") / n, F.log1p(100 * F.col("__symbols") / F.greatest(F.col("__bytes"), F.lit(1))), F.col("__distinct") / n, *hits]

    def posteriors(self) -> list[Column]:
        if self.weights is None:
            return [F.lit(TARGETS[d]) for d in DOMAINS]
        scaled = [(f - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(self.features(), self.mean, self.deviation)]
        scores = []
        for k in range(len(DOMAINS)):
            total = F.lit(float(self.weights[-1, k]))
            for x, w in zip(scaled, self.weights[:-1, k]):
                total = total + x * F.lit(float(w))
            scores.append(total)
        return scores


def measured(documents: DataFrame, classifier: Classifier, keep: list[Column]) -> DataFrame:
    """`keep`, n_tokens (words without ASCII white space) and what the features need, from built-in functions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(*keep, text.alias("__t")).select("*", words_of(F.lower(F.col("__t"))).alias("__w"))
    hits = [F.size(F.array_intersect(F.array(*map(F.lit, classifier.words[d])), F.col("__w"))).alias(f"__hits_{d}") for d in DOMAINS if classifier.words.get(d)]
    kept = [c for c in rows.columns if c not in ("__t", "__w")]
    size = F.octet_length("__t")
    return rows.select(*kept, F.size("__w").cast("long").alias("n_tokens"), size.cast("double").alias("__bytes"), (size - F.octet_length(without(F.col("__t"), SYMBOLS))).cast("double").alias("__symbols"), F.size(F.array_distinct("__w")).cast("double").alias("__distinct"), *hits)


def with_posteriors(rows: DataFrame, classifier: Classifier) -> DataFrame:
    """Posterior columns p_<domain> that sum to 1."""
    scores = classifier.posteriors()
    if classifier.weights is None:
        return rows.withColumns({f"p_{d}": s for d, s in zip(DOMAINS, scores)})
    rows = rows.withColumns({f"__s_{d}": s for d, s in zip(DOMAINS, scores)})
    rows = rows.withColumn("__top", F.greatest(*[F.col(f"__s_{d}") for d in DOMAINS]))
    rows = rows.withColumns({f"__e_{d}": F.exp(F.col(f"__s_{d}") - F.col("__top")) for d in DOMAINS})
    total = sum((F.col(f"__e_{d}") for d in DOMAINS[1:]), F.col(f"__e_{DOMAINS[0]}"))
    return rows.withColumns({f"p_{d}": F.col(f"__e_{d}") / total for d in DOMAINS})


def fit_classifier(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Classifier:
    """Fit on at most `most` labelled rows: telling words from one half, weights from the other.  Without rows of two
    domains (in the half of the weights, too) every document has the target shares as posteriors."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of_labels().alias("domain")).dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "mix-sample")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = Classifier()
    if len(sizes) < 2:
        return out
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))  # words are picked on one half, weights fitted on the other
    chosen_on = sample.filter(half == 0)
    sizes = {r["domain"]: r["n"] for r in chosen_on.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    words = chosen_on.select("domain", F.explode(F.array_distinct(words_of(F.lower(F.coalesce(F.col("text"), F.lit("")))))).alias("word"))
    counts = words.groupBy("word").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    seen = sum((F.col(d) for d in DOMAINS[1:]), F.col(DOMAINS[0]))
    for d in DOMAINS[:-1]:
        if sizes.get(d):
            share = (F.col(d) + 0.1) / (sizes[d] + 0.2)
            rest = (seen - F.col(d) + 0.1) / (total - sizes[d] + 0.2)
            telling = counts.filter((F.col(d) >= 3) & (F.log(share / rest) > 2)).withColumn("gain", F.col(d) * F.log(share / rest))
            out.words[d] = [r["word"] for r in telling.orderBy(F.desc("gain"), "word").limit(MOST_WORDS).collect()]
    rows = measured(sample.filter(half == 1), out, [F.col("doc_id"), F.col("domain")]).select("doc_id", "domain", *[f.alias(f"x{k}") for k, f in enumerate(out.features())]).orderBy("doc_id").collect()
    if len({r["domain"] for r in rows}) < 2:
        return Classifier()
    x = np.array([r[2:] for r in rows], float)
    y = np.array([DOMAINS.index(r["domain"]) for r in rows])
    out.mean, out.deviation = x.mean(0), np.maximum(x.std(0), 1e-9)
    out.weights = logistic(np.c_[(x - out.mean) / out.deviation, np.ones(len(x))], y, len(DOMAINS))
    return out


def logistic(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient descent."""
    goal = np.eye(classes)[y]
    rate = 4 / max(1e-9, np.linalg.eigvalsh(x.T @ x / len(x))[-1])
    w = before = np.zeros((x.shape[1], classes))
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - before)
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        before, w = w, ahead - rate * (x.T @ (p - goal) / len(x) + ridge * ahead)
    return w


def rate_expression(u: np.ndarray, highest: float = HIGHEST_RATE) -> Column:
    """The rate for the shared numbers u: the step from 1, projected into [0, highest] (no bound above by default)."""
    rate = F.lit(1.0)
    for d, x in zip(DOMAINS, u):
        rate = rate - F.col(f"p_{d}") * F.lit(float(x))
    return F.least(F.lit(highest), F.greatest(F.lit(0.0), rate))


@dataclass
class Fit:
    """The numbers u that make rates, the residual they leave (share of all tokens less target) by domain, and the steps taken."""

    u: np.ndarray
    residual: np.ndarray
    steps: int = 0


def fit_rates(members: DataFrame, targets: dict[str, float], highest: float = HIGHEST_RATE, ridge: float = RIDGE, most_steps: int = MOST_STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Projected gradient for the rates that bring the domains' expected tokens nearest to `targets` (shares of all tokens).

    `members` has n_tokens and p_<domain>.  Without tokens every rate is 1.
    """
    k = len(DOMAINS)
    share = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    products = [F.sum(F.col("n_tokens") * F.col(f"p_{a}") * F.col(f"p_{b}")) for a in DOMAINS for b in DOMAINS]
    total, *normal = members.agg(F.sum("n_tokens"), *products).first()
    u = np.zeros(k)
    if not total:
        return Fit(u, np.zeros(k))
    values, vectors = np.linalg.eigh(np.array(normal, float).reshape(k, k) / total)
    metric = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T  # turns a change of u into the size of the rates' change
    length = 1 / (values[-1] + ridge)

    def residual(u: np.ndarray) -> np.ndarray:
        """Expected tokens of the domains at the projected rates, as shares of all, less the targets."""
        read = rate_expression(u, highest) * F.col("n_tokens") / F.lit(float(total))
        sums = members.withColumn("__read", read).agg(*[F.sum(F.col("__read") * F.col(f"p_{d}")) for d in DOMAINS]).first()
        return np.array([x or 0.0 for x in sums], float) - share

    left, taken = residual(u), 0
    gradient, past = left.copy(), []
    while (size := float(np.linalg.norm(metric @ gradient))) >= tolerance and taken < most_steps:
        past = [*past[-MEMORY:], (u, gradient)]
        step = length * gradient
        if len(past) > 1:
            moves, changes = (np.diff(np.array([p[j] for p in past]), axis=0).T for j in (0, 1))
            weights = np.linalg.lstsq(metric @ changes, metric @ gradient, rcond=1e-10)[0]
            step = step - (moves + length * changes) @ weights
        tried, taken = u + step, taken + 1
        left = residual(tried)
        if len(past) > 1 and np.linalg.norm(metric @ (left - ridge * tried)) > FURTHEST * size:
            past, tried, taken = [], u + length * gradient, taken + 1
            left = residual(tried)
        u, gradient = tried, left - ridge * tried
    return Fit(u, left, taken)


@dataclass
class Mixture:
    """A fitted classifier and the numbers that make rates."""

    classifier: Classifier
    fit: Fit
    highest: float = HIGHEST_RATE

    def rated(self, documents: DataFrame, keep: list[Column]) -> DataFrame:
        """`keep`, n_tokens, the posteriors, rate and n_copies of every document."""
        rows = with_posteriors(measured(documents, self.classifier, [*keep, F.col("doc_id").cast("long").alias("__id")]), self.classifier)
        return self.with_rates(rows, F.col("__id")).drop(*[c for c in rows.columns if c.startswith("__") and c != "__row"])

    def with_rates(self, rows: DataFrame, key: Column) -> DataFrame:
        """`rows` (with posteriors) with rate and n_copies: the whole part of the rate, plus one by hashed id for the rest."""
        draw = F.pmod(F.xxhash64(F.lit("mix"), key), F.lit(1_000_003)) / F.lit(1_000_003.0)
        rows = rows.withColumn("rate", rate_expression(self.fit.u, self.highest))
        return rows.withColumn("n_copies", F.floor(F.col("rate") + draw).cast("int"))


def member_table(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posteriors) as a table in the shared folder: the only pass over the texts that fitting needs."""
    rows = with_posteriors(measured(documents, classifier, [F.col("doc_id").cast("long").alias("doc_id")]), classifier)
    return materialize(rows.select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS]), "mix-members")


def fit_mixture(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[Mixture, DataFrame]:
    """Fit both parts on `documents` (doc_id, text) and `labels` (doc_id, quality, toxic); with the member table."""
    targets = targets or TARGETS
    if set(targets) != set(DOMAINS) or min(targets.values()) < 0 or not math.fsum(targets.values()):
        raise ValueError(f"targets are needed for {DOMAINS}, none negative, not all 0")
    classifier = fit_classifier(documents, labels)
    members = member_table(documents, classifier)
    return Mixture(classifier, fit_rates(members, targets)), members


def mixing_rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per row of `documents`: doc_id, n_tokens, p_toxic, p_low, p_clean, rate, n_copies, largest_miss, n_steps.

    largest_miss is the largest difference between a domain's share of the expected tokens and its target (0 without
    tokens), n_steps the gradient steps taken; both are the same in every row.
    Null and empty texts have no tokens but posteriors and a rate as any text of that length; null
    ids stay null; repeated rows count each time and get equal rates; empty tables give no rows
    or rates of 1; other columns are not read.
    """
    mixture, members = fit_mixture(documents, labels, targets)
    rows = mixture.with_rates(members, F.col("doc_id"))
    return rows.withColumns({"largest_miss": F.lit(float(np.abs(mixture.fit.residual).max())), "n_steps": F.lit(mixture.fit.steps)})


def mixed_documents(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of `documents`, each as often as its n_copies says, all columns as they are."""
    rows = fit_mixture(documents, labels, targets)[0].rated(documents, [F.struct("*").alias("__row")])
    rows = rows.withColumn("n_copies", fenced(F.col("n_copies"))).filter("n_copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("__row.*")
