"""Quality rules as learned decision lists, in DataFrame expressions throughout.

`text_statistics` computes the statistics of every text with built-in functions (higher-order
functions over the word array; no shuffle, no Python).  `learn_rules` grows and prunes
conjunctions of thresholds by sequential covering from the statistics of labelled rows, and
`verdict` turns the ordered list into one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import fenced

#: Labelled rows that the rules are learned from, at most (those of the lowest hashed ids).
MOST_LABELLED = 8_000
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, even where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, letters: str) -> Column:
    for letter in letters:
        text = F.replace(text, F.lit(letter), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Runs without ASCII white space (splitting on one plain character needs no regular expression)."""
    for letter in SPACES[1:]:
        text = F.replace(text, F.lit(letter), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words inside a `width`-word window that the text has at least twice.

    Windows are compared by 64-bit hashes.  Texts whose windows all differ, nearly all, stop
    there; else hashes are sorted with their places, equal neighbours are kept, and the
    places, again in order, cover up to `width` words each.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"].cast("long"),
        )

    def places(ordered: Column) -> Column:
        beside = lambda e, k: F.get(ordered, k)["h"].eqNullSafe(e["h"])
        repeated = F.filter(ordered, lambda e, k: beside(e, k - 1) | beside(e, k + 1))
        return F.array_sort(F.transform(repeated, lambda e: e["i"]))

    def judged(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(let(pairs, places)))

    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(let(hashes(words), judged))


def text_statistics(documents: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the statistics of each text: STATISTICS and base_failed.

    Null and empty texts have no words, lines or symbols (base_failed, as they have under ten
    words).  Very long texts are read whole: a row needs memory for about 40 bytes a word.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    columns = documents.select(*[F.col(k) for k in keep], text.alias("__t"))
    columns = columns.select("*", words_of(F.col("__t")).alias("__w"))
    t, w = F.col("__t"), F.col("__w")
    no_space = F.char_length(without(t, SPACES))
    symbols = F.char_length(t) - F.char_length(without(t, SYMBOLS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    out = columns.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        no_space.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(w, lambda x: repeated_words(x)).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def feature(name: str) -> Column:
    """A learned rule's feature as an expression over the statistics."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
    }[name]


@dataclass(frozen=True)
class Rule:
    """If all (feature, sign, threshold) hold, the row's label is `label`; sign +1: at least, -1: at most."""

    conditions: tuple[tuple[str, int, float], ...]
    label: int

    def holds(self, row: dict) -> bool:
        return all(s * row[f] >= s * t for f, s, t in self.conditions)

    def expression(self) -> Column:
        parts = [feature(f) >= F.lit(t) if s > 0 else feature(f) <= F.lit(t) for f, s, t in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if s > 0 else '<='} {t:.6g}" for f, s, t in self.conditions) + f" -> {self.label}"


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that leaves p of p0 positive and n of n0 negative rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def grow(rows: list[dict], target: int, most: int = 4) -> tuple:
    """Add the condition of highest gain until no row of another label is left."""
    conditions: list[tuple[str, int, float]] = []
    while len(conditions) < most and any(r["label"] != target for r in rows):
        p0 = sum(r["label"] == target for r in rows)
        best, choice = 1e-9, None
        for f in FEATURES:
            ordered = sorted(rows, key=lambda r: r[f])
            p = n = 0
            for a, b in zip(ordered, ordered[1:]):
                p, n = p + (a["label"] == target), n + (a["label"] != target)
                if a[f] == b[f]:
                    continue
                for sign, pp, nn, edge in ((-1, p, n, a[f]), (1, p0 - p, len(rows) - p0 - n, b[f])):
                    if (g := gain(pp, nn, p0, len(rows) - p0)) > best:
                        # halfway between the two values, so that rows not seen fall to the nearer side
                        best, choice = g, (f, sign, (a[f] + b[f]) / 2 if math.isfinite(edge) else edge)
        if choice is None:
            break
        conditions.append(choice)
        rows = [r for r in rows if choice[1] * r[choice[0]] >= choice[1] * choice[2]]
    return tuple(conditions)


def prune(conditions: tuple, rows: list[dict], target: int) -> tuple:
    """Drop final conditions while the value (p - n) / (p + n) on rows not used for growing does not fall."""

    def value(kept: tuple) -> float:
        hit = [r for r in rows if Rule(kept, target).holds(r)]
        p = sum(r["label"] == target for r in hit)
        return (2 * p - len(hit)) / len(hit) if hit else -1.0

    best = conditions
    for k in range(len(conditions) - 1, 0, -1):
        if value(conditions[:k]) >= value(best):
            best = conditions[:k]
    return best


def learn_rules(rows: list[dict], target: int = 0, precision: float = 0.99, least: int = 5, most_rules: int = 12) -> list[Rule]:
    """An ordered list of rules for label `target` by sequential covering; other rows get the other label.

    Two of three rows grow a rule, the third prunes it.  A rule stays if on all rows still
    uncovered it covers at least `least` of the target with the stated precision; the first
    that doesn't ends the list.  Fewer than `least` target rows give an empty list.
    """
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules and sum(r["label"] == target for r in left) >= least:
        growing, pruning = [r for k, r in enumerate(left) if k % 3], left[::3]
        conditions = grow(growing, target)
        if not conditions:
            break
        rule = Rule(prune(conditions, pruning, target), target)
        hit = [r for r in left if rule.holds(r)]
        good = sum(r["label"] == target for r in hit)
        if good < least or good < precision * len(hit):
            rule = Rule(conditions, target)
            hit = [r for r in left if rule.holds(r)]
            good = sum(r["label"] == target for r in hit)
            if good < least or good < precision * len(hit):
                break
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return rules


def held_out_scores(rows: list[dict], target: int = 0, every: int = 3) -> dict[str, float]:
    """Rules learned without every third row, held against those rows: how many, recall and precision for label `target`, and
    the share of others left alone.  Undefined rates are 1."""
    rules = learn_rules([r for k, r in enumerate(rows) if k % every], target)
    rest = rows[::every]
    caught = [next((rule.label for rule in rules if rule.holds(r)), 1 - target) == target for r in rest]
    bad = sum(r["label"] == target for r in rest)
    hit = sum(c and r["label"] == target for c, r in zip(caught, rest))
    share = lambda a, b: a / b if b else 1.0
    return {"n": len(rest), "recall": share(hit, bad), "precision": share(hit, sum(caught)), "others_left_alone": share(sum(not c and r["label"] != target for c, r in zip(caught, rest)), len(rest) - bad)}


def labelled_statistics(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[dict]:
    """Statistics and label of at most `most` labelled rows, those of the lowest hashed ids.

    Rows with null labels or ids don't count, nor do texts that the base rule rejects anyway.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = text_statistics(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), keep=("doc_id", "label"))
    rows = rows.filter(fenced(~F.col("base_failed"))).select("doc_id", "label", *[feature(f).alias(f"__{f}") for f in FEATURES])
    return [{f: r[f"__{f}"] for f in FEATURES} | {"label": r["label"]} for r in sorted(rows.collect(), key=lambda r: (hash(r["doc_id"]) * 2654435761 % 2**32, r["doc_id"]))]


def verdict(rules: list[Rule]) -> Column:
    """True where the list's first rule that holds, if any, keeps the row: one ordered conditional expression."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].expression(), F.lit(bool(rules[0].label)))
    for rule in rules[1:]:
        out = out.when(rule.expression(), F.lit(bool(rule.label)))
    return out.otherwise(F.lit(True))


def judge(documents: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of `documents`: `keep`, the statistics, base_failed and kept.

    Null and empty texts fail the base rule; null ids stay null; repeated rows stay repeated; an
    empty table gives no rows; other columns are not read.
    """
    rows = text_statistics(documents, keep=keep)
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `documents` that are kept, all columns as they are."""
    rows = documents.select(F.struct("*").alias("__row"), F.col("text"))
    return judge(rows, rules, keep=("__row",)).withColumn("kept", fenced(F.col("kept"))).filter("kept").select("__row.*")
