"""Text-model calls behind a pluggable provider, their validation, and the state machine of provider keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.functions.text import without_fences
from eligspark.operators.sampling import global_rank

COOLDOWN_S, STRIKES, MOST_RETRIES = 60, 3, 2


class Offline:
    """The default provider: gives no reply, so that callers take their degraded path."""

    def __call__(self, prompt: str) -> tuple[str | None, str]:
        return None, "no provider"


@dataclass
class KeyPool:
    """Keys in order; three rate-limit errors in a row cool a key down (or retire it), a daily limit retires it, success resets."""

    keys: list[str]
    retire_on_strikes: bool = False
    strikes: dict[str, int] = field(default_factory=dict)
    resting: dict[str, float] = field(default_factory=dict)
    retired: set[str] = field(default_factory=set)

    def pick(self, now: float) -> str | None:
        return next((k for k in self.keys if k not in self.retired and self.resting.get(k, 0) <= now), None)

    def report(self, key: str, kind: str, now: float) -> None:
        if kind == "ok":
            self.strikes[key] = 0
        elif kind == "daily":
            self.retired.add(key)
        elif kind == "fatal":
            self.retired.update(self.keys)
        elif kind == "minute":
            self.strikes[key] = self.strikes.get(key, 0) + 1
            if self.strikes[key] >= STRIKES:
                self.strikes[key] = 0
                if self.retire_on_strikes:
                    self.retired.add(key)
                else:
                    self.resting[key] = now + COOLDOWN_S


def wait_before(kind: Column, attempt: Column) -> Column:
    """Seconds before a retry: 20 per attempt for rate limits, powers of two for server errors; null beyond the last retry."""
    return F.when(attempt <= MOST_RETRIES, F.when(kind == "minute", 20 * attempt).when(kind == "retryable", F.pow(F.lit(2), attempt).cast("int")))


def generate(prompts: DataFrame, provider: Callable[[str], tuple[str | None, str]] | None = None, key: str = "key") -> DataFrame:
    """(key, reply, status) of (key, prompt) rows; one provider object per task, no retries hidden in task retries."""
    provider = provider or Offline()
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [provider(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"k": pdf["k"], "reply": [o[0] for o in out], "status": [o[1] for o in out]})

    return prompts.select(F.col(key).alias("k"), "prompt").mapInPandas(run, f"k {kind}, reply string, status string").withColumnRenamed("k", key)


def with_retries(items: DataFrame, call: Callable[[DataFrame], DataFrame], most: int = 3, key: str = "key") -> DataFrame:
    """Calls over what is pending, up to `most` rounds; (key, reply, status, attempt), the last failure stays as it is."""
    from eligspark.storage import materialize

    left, done = items, None
    for attempt in range(1, most + 1):
        got = materialize(call(left).withColumn("attempt", F.lit(attempt)), "calls")
        good = got if attempt == most else got.filter("status = 'ok'")
        done = good if done is None else done.unionByName(good)
        left = left.join(got.filter("status <> 'ok'").select(key), key, "left_semi")
        if not left.limit(1).count():
            break
    return done


def batched_prompts(rows: DataFrame, key: str, text: str, head: str, per_batch: int = 10) -> DataFrame:
    """(batch, keys, prompt): numbered items, `per_batch` in each prompt."""
    dealt = global_rank(rows.select(key, text), [key], "__k").withColumn("batch", F.floor((F.col("__k") - 1) / per_batch).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(text).alias("t"))))
    grouped = dealt.groupBy("batch").agg(parts.alias("p"))
    return grouped.select("batch", F.transform("p", lambda x: x["k"]).alias("keys"), F.concat(F.lit(head + "\n"), F.array_join(F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n")).alias("prompt"))


def reconcile(requested: DataFrame, returned: DataFrame, allowed: tuple[str, ...], key: str = "slug", label: str = "category") -> DataFrame:
    """(key, category, error): missing and invalid answers by key; answers for keys not asked for are dropped."""
    first = returned.groupBy(key).agg(F.min(label).alias("__l"))
    joined = requested.select(key).distinct().join(first, key, "left")
    error = F.when(F.col("__l").isNull(), "missing").when(~F.col("__l").isin(*allowed), "invalid")
    return joined.select(key, F.when(error.isNull(), F.col("__l")).alias(label), error.alias("error"))


def parsed_reply(reply: Column, schema: str) -> Column:
    """A reply's JSON object by a closed schema; null if it can't be read."""
    return F.from_json(without_fences(reply), schema, {"mode": "PERMISSIVE"})


def profile_errors(profile: dict[str, Column], evidence: dict[str, Column], text: Column) -> Column:
    """Field errors: out of bounds, evidence that isn't in the text, first-person fields without first-person evidence."""
    bounds = {"age": (1, 119), "education_class": (1, 12), "disability_percent": (0, 100)}
    norm = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    checks = []
    for name, value in profile.items():
        if name in bounds:
            low, high = bounds[name]
            checks.append(F.when(value.isNotNull() & ~value.between(low, high), f"{name}: out of bounds"))
        span = evidence.get(name)
        if span is not None:
            inside = F.contains(norm, F.lower(F.regexp_replace(F.coalesce(span, F.lit("")), r"\s+", " ")))
            checks.append(F.when(value.isNotNull() & ((F.coalesce(span, F.lit("")) == "") | ~inside), f"{name}: evidence is not in the text"))
            if name in ("age", "gender", "marital_status"):
                checks.append(F.when(value.isNotNull() & inside & ~span.rlike(r"(?i)\b(?:i|i'm|i am|my|me|myself)\b|मैं|मेरी|నేను|నా"), f"{name}: not said of oneself"))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def translation_errors(original: Column, translated: Column, places: tuple[str, ...] = (), state: Column | None = None) -> Column:
    """Numbers added or lost, negation lost, sentences merged, a place named that neither the text nor the profile has."""
    from eligspark.functions.text import derivable, digit_numbers, sentence_count

    a, b = F.array_distinct(digit_numbers(original)), F.array_distinct(digit_numbers(translated))
    no = r"(?i)\b(?:no|not|never|without|none)\b|n't|नहीं|లేదు|లేను"
    own = F.coalesce(F.lit(None).cast("string") if state is None else state, F.lit(""))
    added = [F.contains(F.lower(translated), F.lit(p.lower())) & ~F.contains(F.lower(original), F.lit(p.lower())) & (own != p) for p in places]
    checks = [
        F.when(F.exists(b, lambda n: ~derivable(n, a)), "number added"),
        F.when(F.exists(a, lambda n: ~derivable(n, b)), "number lost"),
        F.when(original.rlike(no) & ~translated.rlike(no), "negation lost"),
        F.when((sentence_count(original) >= 2) & (sentence_count(translated) < sentence_count(original) - 1), "sentences merged"),
        *[F.when(x, f"place added: {p}") for x, p in zip(added, places)],
    ]
    return F.array_compact(F.array(*checks))


def constraint_errors(c: dict[str, Column], spans: dict[str, Column], source: Column) -> Column:
    """Min above max, values outside closed sets, spans missing or not in the source."""
    checks = [
        F.when(c["age_min"] > c["age_max"], "age: min above max") if {"age_min", "age_max"} <= set(c) else None,
        F.when(c["land_min"] > c["land_max"], "land: min above max") if {"land_min", "land_max"} <= set(c) else None,
        F.when(c["income_cap"] < 0, "income: negative cap") if "income_cap" in c else None,
        F.when(c["income_basis"].isNotNull() & ~c["income_basis"].isin("family", "individual"), "income: unknown basis") if "income_basis" in c else None,
        F.when(c["level"].isNotNull() & ~c["level"].isin("state", "central"), "level: unknown") if "level" in c else None,
    ]
    for name, span in spans.items():
        checks.append(F.when(span.isNotNull() & ~F.contains(source, span), f"{name}: span is not in the text"))
    return F.array_compact(F.array(*[x for x in checks if x is not None]))


def without_covered(residuals: Column, restated: Column, least: float = 0.85) -> Column:
    """Residuals that a migrated boolean doesn't restate: kept unless their words are covered."""
    from eligspark.functions.text import word_coverage

    return F.filter(residuals, lambda r: ~F.exists(restated, lambda s: F.coalesce(word_coverage(r, s) >= least, F.lit(False))))


def is_nearly_empty(fields: list[Column], least: int = 2) -> Column:
    """Fewer than two substantive fields are stated."""
    return F.size(F.array_compact(F.array(*[F.when(f.isNotNull(), 1) for f in fields]))) < least


def ratio(a: str, b: str) -> float:
    """The ratio of matching blocks of two strings."""
    return SequenceMatcher(None, a, b).ratio()
