"""Evaluation: retrieval metrics, profile scores, verdict attribution, agreement and interval estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.functions.text import fuzzy_words_match

Z = 1.95996


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A quotient, null where the denominator is 0."""
    return F.round(F.try_divide(part.cast("double"), whole), digits)


def scored_positive(hits: DataFrame, expected: DataFrame, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, first): the rank of the first expected hit, null if none came."""
    found = hits.join(expected.select(query, key).distinct(), [query, key]).groupBy(query).agg(F.min("rnk").alias("first"))
    return expected.select(query).distinct().join(found, query, "left")


def retrieval_metrics(scored: DataFrame, by: tuple[str, ...] = ("mode",)) -> DataFrame:
    """Recall at 5 and 10 and mean reciprocal rank at 10, per group."""
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    mrr = F.avg(F.when(F.col("first") <= 10, F.lit(1.0) / F.col("first")).otherwise(0.0))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(at(5), 4).alias("recall_5"), F.round(at(10), 4).alias("recall_10"), F.round(mrr, 4).alias("mrr_10"))


def false_inclusion(hits: DataFrame, excluded: DataFrame, k: int = 10, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """One row (n_queries, n_with_excluded, rate): queries whose top k has an excluded row."""
    top = hits.filter(F.col("rnk") <= k)
    bad = top.join(excluded.select(key).distinct(), key, "left_semi").select(query).distinct().withColumn("bad", F.lit(1))
    rows = top.select(query).distinct().join(bad, query, "left")
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), F.count("bad").alias("n_with_excluded")).withColumn("rate", rate(F.col("n_with_excluded"), F.col("n_queries")))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The element at position n div 2 (from 0) of the sorted values: the upper of two middles.

    Ranks come from a window, so that a hot group is never one array.
    """
    order = W.partitionBy(by).orderBy(value)
    rows = df.filter(F.col(value).isNotNull()).select(by, value, F.row_number().over(order).alias("__k"), F.count(F.lit(1)).over(W.partitionBy(by)).alias("n"))
    return rows.filter(F.col("__k") == F.floor(F.col("n") / 2) + 1).select(by, "n", F.col(value).alias("upper_median"))


def nearest_rank(df: DataFrame, value: str, points: tuple[float, ...] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """Values at index round(p * (n - 1)), halves to even: columns p10, p50, ... with n, min, max and mean."""
    rows = df.filter(F.col(value).isNotNull())
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy(value)))  # distinct values only
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 4).alias("mean"))
    joined = upto.crossJoin(F.broadcast(total.select("n")))  # one row
    picks = [F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("n") - 1), 0), F.col(value))).alias(f"p{round(p * 100)}") for p in points]
    return joined.agg(*picks).crossJoin(total)


def exclusive_quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median and quartiles by position (n + 1) p with interpolation, mean (1 decimal), min and max, per group of two or more."""
    order = W.partitionBy(by).orderBy(value)
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"), F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(W.partitionBy(by)).alias("n"))

    def at(p: float) -> Column:
        place = F.least(F.greatest((F.col("n") + 1) * p, F.lit(1.0)), F.col("n").cast("double"))
        low = F.floor(place)
        weight = F.when(F.col("k") == low, 1 - (place - low)).when(F.col("k") == low + 1, place - low)
        return F.round(F.sum(F.when(weight.isNotNull(), weight * F.col("v"))), 6)

    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("v").alias("max"), F.round(F.avg("v"), 1).alias("mean"))
    return out.filter("n >= 2")


def field_matches(field: str, expected: Column, got: Column) -> Column:
    """Whether a profile field agrees within its tolerance."""
    if field == "annual_income_inr":
        return F.abs(got - expected) <= F.abs(expected) * 0.01
    if field == "land_acres":
        return F.abs(got - expected) <= F.greatest(F.lit(0.05), F.abs(expected) * 0.02)
    if field == "occupation":
        return fuzzy_words_match(expected, got)
    return got.eqNullSafe(expected)


def profile_accuracy(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per field: stated, right, accuracy, blank, filled though blank, false-fill rate.  Columns e_<field> and g_<field>."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").isNotNull().alias("stated"), F.col(f"g_{f}").isNotNull().alias("filled"), F.coalesce(field_matches(f, F.col(f"e_{f}"), F.col(f"g_{f}")), F.lit(False)).alias("ok")) for f in fields]
    long = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    out = long.groupBy("field").agg(F.count_if("stated").alias("stated"), F.count_if(F.col("stated") & F.col("ok")).alias("right"), F.count_if(~F.col("stated")).alias("blank"), F.count_if(~F.col("stated") & F.col("filled")).alias("false_fill"))
    return out.withColumns({"accuracy": rate(F.col("right"), F.col("stated")), "false_fill_rate": rate(F.col("false_fill"), F.col("blank"))})


def end_to_end(results: DataFrame, expected: DataFrame, query: str = "query_id", slug: str = "slug") -> DataFrame:
    """A10: one row: statuses of expected pairs, false exclusions, end-to-end rate (retrieved and not ruled out)."""
    rows = expected.join(results.select(query, slug, "status"), [query, slug], "left")
    out = rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("status").isNull()).alias("not_retrieved"), *[F.count_if(F.col("status") == s).alias(s) for s in ("eligible", "needs_checking", "not_eligible")])
    return out.withColumns({"false_exclusion": rate(F.col("not_eligible"), F.col("pairs")), "end_to_end": rate(F.col("eligible") + F.col("needs_checking"), F.col("pairs"))})


def first_change(steps: DataFrame, keys: tuple[str, ...], step: str = "step", status: str = "status") -> DataFrame:
    """Per key the first step whose status differs from the step before, and the path without repeats."""
    order = W.partitionBy(*keys).orderBy(step)
    rows = steps.withColumn("__before", F.lag(status).over(order)).withColumn("__changed", F.col("__before").isNotNull() & (F.col("__before") != F.col(status)))
    kept = F.collect_list(F.when(F.col("__before").isNull() | F.col("__changed"), F.struct(F.col(step).alias("s"), F.col(status).alias("v"))))
    path = F.array_join(F.transform(F.array_sort(kept), lambda x: x["v"]), ">")
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("__changed"), F.col(step))).alias("first_change"), path.alias("path"))


def run_changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys with the status of either run and whether it changed, appeared or went."""
    joined = old.select(*keys, F.col("status").alias("old_status")).join(new.select(*keys, F.col("status").alias("new_status")), list(keys), "full_outer")
    kind = F.when(F.col("old_status").isNull(), "added").when(F.col("new_status").isNull(), "removed").when(F.col("old_status") != F.col("new_status"), "changed").otherwise("same")
    return joined.withColumn("kind", kind)


def wilson(p: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval of a proportion; null for n = 0."""
    z2 = z * z
    middle = F.try_divide(p + F.lit(z2) / (2 * n), 1 + F.lit(z2) / n)
    half = F.try_divide(F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n)), 1 + F.lit(z2) / n)
    return middle - half, middle + half


def agreement(rows: DataFrame, by: tuple[str, ...], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Per group the pairs, agreements, and agreement rate, weighted if a weight is named."""
    hit = (F.col(a) == F.col(b)).cast("double")
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("agree"), F.round(F.sum(w * hit) / F.sum(w), 6).alias("agreement"))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of differing labels with counts."""
    return rows.filter(F.col(a) != F.col(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def post_stratified(strata: DataFrame) -> DataFrame:
    """One row from (stratum, population, sampled, hits): post-stratified rate, its normal interval with the finite-population
    correction, Kish's effective size and the Wilson interval at that size.  Strata without a sample are left out of both sides."""
    rows = strata.filter("sampled > 0 and population > 0")
    total = W.partitionBy()
    big, small = F.sum("population").over(total).cast("double"), F.sum("sampled").over(total).cast("double")
    rows = rows.select("population", "sampled", (F.col("hits") / F.col("sampled")).alias("p"), (F.col("population") / big).alias("share"), ((F.col("population") / big) / (F.col("sampled") / small)).alias("w"))
    correction = 1 - F.col("sampled") / F.col("population")
    variance = F.when(F.col("sampled") > 1, F.col("share") * F.col("share") * correction * F.col("p") * (1 - F.col("p")) / (F.col("sampled") - 1)).otherwise(0.0)
    out = rows.agg(F.sum(F.col("share") * F.col("p")).alias("estimate"), F.sqrt(F.sum(variance)).alias("se"), (F.pow(F.sum(F.col("w") * F.col("sampled")), F.lit(2)) / F.sum(F.col("w") * F.col("w") * F.col("sampled"))).alias("n_eff"))
    low, high = wilson(F.col("estimate"), F.col("n_eff"))
    return out.select(*[F.round(c, 6).alias(n) for c, n in ((F.col("estimate"), "estimate"), (F.col("se"), "se"), (F.col("estimate") - Z * F.col("se"), "normal_low"), (F.col("estimate") + Z * F.col("se"), "normal_high"), (F.col("n_eff"), "n_eff"), (low, "wilson_low"), (high, "wilson_high"))])


#: Draws that one row of the Monte Carlo makes.
DRAW_BLOCK = 2_000


def jeffreys_interval(strata: DataFrame, draws: int = 40_000, seed: int = 20260920) -> DataFrame:
    """A25 (Monte Carlo): 2.5 and 97.5 percent points of the post-stratified rate under Jeffreys priors with the
    finite-population correction.

    A row is a block of draws of a stratum, whose random numbers come from a counter-based generator keyed by seed,
    stratum and block: results don't depend on how rows are dealt, and a retried task repeats them.  Draws are summed over
    the strata by Spark, and the points are exact percentiles.  Strata without a sample or population don't count; without
    any the points are null; strata of equal names are told apart by their counts.
    """
    total = W.partitionBy()
    rows = strata.filter("sampled > 0 and population > 0").select(F.col("stratum").cast("string").alias("stratum"), F.col("population").cast("double").alias("population"), F.col("sampled").cast("double").alias("sampled"), F.col("hits").cast("double").alias("hits"))
    rows = rows.withColumn("share", F.col("population") / F.sum("population").over(total)).withColumn("key", F.xxhash64("stratum", "population", "sampled", "hits"))
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAW_BLOCK) - 1))))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rng = np.random.Generator(np.random.Philox(key=[r.key % (1 << 64), seed], counter=[0, 0, 0, r.block]))
                first = r.block * DRAW_BLOCK
                x = rng.beta(r.hits + 0.5, r.sampled - r.hits + 0.5, min(DRAW_BLOCK, draws - first))
                seen = r.hits / r.sampled
                x = seen + (x - seen) * np.sqrt(max(0.0, 1 - r.sampled / r.population))
                yield pd.DataFrame({"draw": np.arange(first, first + len(x)), "part": r.share * x})

    sums = blocks.repartition("block").mapInPandas(drawn, "draw long, part double").groupBy("draw").agg(F.sum("part").alias("total"))
    points = sums.agg(F.percentile("total", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.count(F.lit(1)).alias("draws"))
    return points.select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "draws")


def without_each_stratum(strata: DataFrame) -> DataFrame:
    """The post-stratified rate with each stratum left out in turn, from totals: no pairs of strata are made."""
    total = W.partitionBy()
    part = F.col("population") * F.col("hits") / F.col("sampled")
    rows = strata.filter("sampled > 0")
    return rows.select("stratum", F.round(F.try_divide(F.sum(part).over(total) - part, F.sum("population").over(total) - F.col("population")), 6).alias("estimate_without"))


def gold_rows(gold: DataFrame, split: str, final: bool = False) -> DataFrame:
    """scored gold rows of a split.  The test split is refused unless it is the `final` run, as are rows without a split."""
    if split == "test" and not final:
        raise ValueError("the test split is for the final run")
    if gold.filter(F.col("split").isNull()).limit(1).count():
        raise ValueError("some gold rows have no split")
    return gold.filter(~F.coalesce(F.col("skip_scoring"), F.lit(False)) & (F.col("split") == split))


def matched_labels(human: DataFrame, predicted: DataFrame, key: str, label: str = "label", prediction: str = "predicted") -> DataFrame:
    """(key, label, predicted, kind): agree, differ, or which side lacks the key."""
    joined = human.select(key, label, F.lit(True).alias("__h")).join(predicted.select(key, prediction, F.lit(True).alias("__p")), key, "full_outer")
    kind = F.when(F.col("__p").isNull(), "no prediction").when(F.col("__h").isNull(), "no label").when(F.col(label) == F.col(prediction), "agree").otherwise("differ")
    return joined.select(key, label, prediction, kind.alias("kind"))


def error_kinds(messages: DataFrame, column: str) -> DataFrame:
    """(kind, n): error messages by kind, particulars taken out."""
    from eligspark.functions.text import error_kind

    return messages.groupBy(error_kind(F.col(column)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n, row share)."""
    counts = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(truth)), 6))


def class_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class precision, recall, F1 (0 where undefined) and support."""
    a = rows.groupBy(F.col(truth).alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(predicted)).alias("hits"))
    b = rows.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("named"))
    j = a.join(b, "label", "full_outer").na.fill(0)
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("named")), zero), F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), zero)
    return j.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), zero), 6).alias("f1"))


def summary_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: macro and weighted F1 and accuracy."""
    scores = class_scores(rows, truth, predicted)
    accuracy = rows.agg(F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 6).alias("accuracy"))
    return scores.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1")).crossJoin(accuracy)  # one row each


def over_folds(scores: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and population deviation of a score over folds."""
    return scores.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))


def citation_report(attempts: DataFrame) -> DataFrame:
    """One row from (attempt, valid, source): valid share of first and of final attempts, fallback share."""
    first = F.col("attempt") == 1
    return attempts.agg(
        F.count(F.lit(1)).alias("citations"), F.count_if("valid").alias("valid"), rate(F.count_if(first & F.col("valid")), F.count_if(first)).alias("first_attempt_rate"), rate(F.count_if("valid"), F.count(F.lit(1))).alias("overall_rate"), rate(F.count_if(F.col("source") == "fallback"), F.count(F.lit(1))).alias("fallback_rate")
    )
