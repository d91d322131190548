"""Rule functions as Column expressions: confidence, ranges, bases, stages, marital words, numeric bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligspark.functions.text import digit_numbers, let
from eligspark.schemas import CONFIDENT

# Words of income and land evidence.
FAMILY = r"(?i)family|household|parents?|father|mother|husband|wife|\bwe\b|\bour\b|together|परिवार|घर की|కుటుంబ|పరివార|পরিবার|குடும்ப"
INDIVIDUAL = r"(?i)\bI (?:earn|make|get)\b|\bmy (?:salary|income|earnings?|wages?|pension)\b|मेरी (?:आय|आमदनी|कमाई|तनख्वाह)|कमाता|कमाती|నా (?:ఆదాయం|జీతం)"
OWNED = r"(?i)\bown(?:s|ed)?\b|\bmy (?:land|farm)|landholding|patta|मेरे पास|मेरी ज़मीन|నాకు|నా భూమి"
LEASED = r"(?i)leas|\brent|tenant|share ?crop|batai|ठेके|बटाई|కౌలు"
PRIOR_BENEFIT = r"(?i)\b(?:already|currently)\s+(?:getting|receiving|availing|get|receive|avail)|\b(?:received|availed|beneficiary|benefited)\b|\b(?:took|taken|got)\s+an?\s+[\w-]+\s+loan\b"
NEGATED = r"(?i)\b(?:never|not|no|without)\b|n't"
DEPENDENT_WORDS = r"(?i)\b(?:child|children|kids?|sons?|daughters?|baby|infant|newborn|girl|boy|mother|father|parents?|husband|wife|spouse|dependents?|grandchild(?:ren)?)\b"
# Wording of a stage and the profile stages that it admits, tried in order.
STAGES = (
    (r"ph\.?\s*d|doctora", ("doctoral",)),
    (r"post[\s-]?grad\w*|\bp\.?g\.?\b|master\w*|\bm\.?(?:a|sc|com|tech|phil)\b\.?|\bmba\b", ("postgraduate",)),
    (r"post[\s-]?matric\w*", ("higher_secondary", "diploma", "undergraduate", "postgraduate", "doctoral")),
    (r"pre[\s-]?matric\w*", ("school",)),
    (r"higher education", ("diploma", "undergraduate", "postgraduate", "doctoral")),
    (r"under[\s-]?grad\w*|graduat\w*|bachelor\w*|degree|college|\bb\.?(?:a|sc|com|tech|e)\b\.?", ("undergraduate",)),
    (r"higher secondary|senior secondary|intermediate|plus two|\+2|\b1[12](?:th)?\b", ("higher_secondary",)),
    (r"diploma|\biti\b|polytechnic|vocational", ("diploma",)),
    (r"school|primary|secondary", ("school", "higher_secondary")),
)
# Marital words, words that say nothing, texts that don't restrict.
MARITAL = {"widow": "widowed", "widows": "widowed", "widowed": "widowed", "widower": "widowed", "unmarried": "unmarried", "married": "married", "divorced": "divorced", "divorcee": "divorced", "divorcees": "divorced", "separated": "separated", "abandoned": "abandoned", "deserted": "abandoned"}
MARITAL_FILLER = ("women", "woman", "including", "persons", "person", "girls", "girl", "men")
MARITAL_ANY = ("any", "for all", "all")
# Plausible values of the numeric profile fields.
PLAUSIBLE = {"age": (1, 120), "disability_percent": (1, 100), "land_acres": (0, 100_000), "annual_income_inr": (1_000, 1_000_000_000)}
# Wording of lower and upper bounds; the starred ones of the survey leave the bound out.
LOWER_INCLUSIVE, LOWER_EXCLUSIVE = ("at least", "not less than", "minimum of", "minimum"), ("more than", "above", "over", "greater than", "exceeding")
UPPER_INCLUSIVE, UPPER_EXCLUSIVE = ("not more than", "no more than", "not exceeding", "maximum of", "maximum", "up to", "within"), ("less than", "below", "under")
# What a residual has to mention to be about the same quantity as a checked field.
SUBJECTS = {
    "age": r"(?i)\b(?:age|aged|ages|age group|years? of age|years old)\b",
    "category": r"(?i)\b(?:sc|st|obc|ews|scheduled caste|scheduled tribe|backward class(?:es)?|minority|minorities|caste|disabilit(?:y|ies)|disabled|divyang|handicapped)\b",
    "land": r"(?i)\b(?:land|lands|landholding|acres?|hectares?|cultivable)\b",
    "income": r"(?i)\b(?:income|salary|salaries|earnings?|wages?)\b",
}
NUMERIC_KINDS = {"age": "age", "income": "annual_income_inr", "land": "land_acres", "category": "disability_percent"}


def usable(value: Column, confidence: Column | None) -> Column:
    """stated with high or medium confidence; without any confidence map (None) a stated value counts as medium."""
    return value.isNotNull() & (F.lit(True) if confidence is None else F.coalesce(confidence.isin(*CONFIDENT), F.lit(False)))


def confident(value: Column, confidence: Column | None) -> Column:
    """as F03, but without a confidence map nothing is confident."""
    return F.lit(False) if confidence is None else usable(value, confidence)


def in_range(value: Column, low: Column, high: Column) -> Column:
    """within open-ended bounds."""
    return (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


def constrains(value: Column) -> Column:
    """F05 for texts: set, and not the sentinel that doesn't restrict."""
    return value.isNotNull() & (value != "any")


def plausible(number: Column, key: str) -> Column:
    """F11."""
    low, high = PLAUSIBLE[key]
    return number.between(low, high)


def income_basis(evidence: Column) -> Column:
    """Family before individual."""
    return F.when(evidence.rlike(FAMILY), "family").when(evidence.rlike(INDIVIDUAL), "individual")


def land_basis(evidence: Column) -> Column:
    """Leased before owned."""
    return F.when(evidence.rlike(LEASED), "leased").when(evidence.rlike(OWNED), "owned")


def stages_admitted(text: Column) -> Column:
    """The stages of all patterns found, each found wording taken out before the next is tried; null if none."""
    rest, found = F.lower(F.coalesce(text, F.lit(""))), F.array().cast("array<string>")
    for pattern, stages in STAGES:
        found = F.concat(found, F.when(rest.rlike(pattern), F.array(*map(F.lit, stages))).otherwise(F.array().cast("array<string>")))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.when(F.size(found) > 0, F.array_distinct(found))


def marital_admitted(text: Column) -> Column:
    """Admitted statuses; ['any'] if the text doesn't restrict; null if any piece of it has no meaning here."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    pieces = F.transform(F.split(t, r"[,/;&]|\bor\b|\band\b"), lambda p: F.filter(F.regexp_extract_all(p, F.lit("[a-z-]+"), F.lit(0)), lambda w: ~w.isin(*MARITAL_FILLER)))
    pieces = F.filter(pieces, lambda p: F.size(p) > 0)
    words = F.create_map(*[F.lit(x) for pair in MARITAL.items() for x in pair])
    good = (F.size(pieces) > 0) & F.forall(pieces, lambda p: (F.size(p) == 1) & p[0].isin(*MARITAL))
    return F.when(t.isin(*MARITAL_ANY), F.array(F.lit("any"))).when(good, F.array_distinct(F.transform(pieces, lambda p: words[p[0]])))


def stated_bound(text: Column, key: str, fixed: bool = True) -> Column:
    """struct(low, low_inclusive, high, high_inclusive) that a text states for a numeric field; null if none can be read.

    A plausible range comes first, then a lower and an upper phrase.  With `fixed`, grouped thousands are
    joined before reading and "not more than" isn't also read as "more than" (nor "not less than" as "less
    than", nor "not exceeding" as "exceeding"); without it both quirks are kept.  Either way a bound can only lower a verdict.
    """
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    if fixed:
        whole = F.regexp_replace(whole, r"(?<=\d),(?=\d{2,3}(?:\D|$|,))", "")
    number = r"(\d+(?:[.,]\d+)?)"
    no_not = r"(?<!\bnot )(?<!\bno )" if fixed else ""
    # what wasn't found is no number; casting it would raise an exception inside the cast
    value = lambda c: let(c, lambda g: F.when(g != "", F.replace(g, F.lit(","), F.lit("")).try_cast("double")))
    found = lambda c: let(c, lambda n: F.when(plausible(n, key), n))
    span = r"(?i)(\d+(?:\.\d+)?)\s*(?:-|–|—|to|and)\s*(\d+(?:\.\d+)?)"
    lower_words, upper_words = "|".join(LOWER_INCLUSIVE + LOWER_EXCLUSIVE), "|".join(UPPER_INCLUSIVE + UPPER_EXCLUSIVE)
    lower = rf"(?i){no_not}\b({lower_words})\s*(?:rs\.?|₹)?\s*{number}"
    trailing = rf"(?i){number}\s*%?\s*(?:and|or)\s+(?:more|above)\b"
    upper = rf"(?i){no_not}\b({upper_words})\s*(?:rs\.?|₹)?\s*{number}"
    if fixed:
        # the negated phrases themselves start with "not" or "no" and are matched whole
        lower = rf"(?i)(?<!\bnot )(?<!\bno )\b({lower_words})\s*(?:rs\.?|₹)?\s*{number}"

    def bound(lo, lo_in, hi, hi_in):
        return F.struct(lo.alias("low"), lo_in.alias("low_inclusive"), hi.alias("high"), hi_in.alias("high_inclusive"))

    def ends(t: Column) -> Column:
        stated = F.struct(*[F.lower(F.regexp_extract(t, p, 1)).alias(f"{n}_phrase") for n, p in (("low", lower), ("high", upper))], *[found(value(F.regexp_extract(t, p, 2))).alias(n) for n, p in (("low", lower), ("high", upper))])

        def read(x: Column) -> Column:
            low = F.coalesce(x["low"], F.when(x["low_phrase"] == "", found(value(F.regexp_extract(t, trailing, 1)))))
            return let(low, lambda lo: F.when(lo.isNotNull() | x["high"].isNotNull(), bound(lo, lo.isNotNull() & ~x["low_phrase"].isin(*LOWER_EXCLUSIVE), x["high"], x["high"].isNotNull() & ~x["high_phrase"].isin(*UPPER_EXCLUSIVE))))

        return let(stated, read)

    def stated_in(t: Column) -> Column:
        both = F.struct(value(F.regexp_extract(t, span, 1)).alias("a"), value(F.regexp_extract(t, span, 2)).alias("b"))
        ranged = lambda x: (x["a"] < x["b"]) & plausible(x["a"], key) & plausible(x["b"], key)
        some = F.exists(digit_numbers(t), lambda n: plausible(n, key))
        return F.when(some, let(both, lambda x: F.when(ranged(x), bound(x["a"], F.lit(True), x["b"], F.lit(True))).otherwise(ends(t))))

    return let(whole, stated_in)


def satisfies(value: Column, bound: Column) -> Column:
    """The value lies within the bound, each end by its own inclusivity."""
    low = bound["low"].isNull() | F.when(bound["low_inclusive"], value >= bound["low"]).otherwise(value > bound["low"])
    high = bound["high"].isNull() | F.when(bound["high_inclusive"], value <= bound["high"]).otherwise(value < bound["high"])
    return low & high


def constraint_numbers(json: Column) -> Column:
    """Every number that a constraint's JSON states, in keys' values and texts (true and false are none)."""
    return F.transform(F.regexp_extract_all(json, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), F.lit(0)), lambda x: x.try_cast("double"))
