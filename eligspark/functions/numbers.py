"""Numbers that a text states, in digits of any script and in English words, and what its unit words allow to derive from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligspark.functions.text import digit_numbers, let

# Number words of the profile reader.
ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth")
NUMBER_WORDS = {"half": 0.5, "quarter": 0.25, "hundred": 100.0} | {w: k + 1.0 for k, w in enumerate(ONES)} | {w: 10.0 * (k + 2) for k, w in enumerate(TENS)} | {w: k + 1.0 for k, w in enumerate(ORDINALS)}
# Unit words in the scripts of the profile reader.
UNITS = ((r"(?i)lakh|\blacs?\b|लाख|లక్ష|লাখ|லட்ச", 1e5), (r"(?i)crore|करोड़|కోటి|কোটি|கோடி", 1e7), (r"(?i)thousand|हज़ार|हजार|వేల|వెయ్య|হাজার|ஆயிர", 1e3))
MONTH = r"(?i)month|महीन|माह|मासिक|నెల|মাস|மாத"
HECTARE, ACRES_OF_HECTARE = r"(?i)hectare|हेक्टेयर|హెక్టార|হেক্টর|ஹெக்டே", 2.471


def no_number() -> Column:
    return F.lit(None).cast("double")


def word_values(text: Column) -> Column:
    """The value of each run of letters a-z, null where it is no number word."""
    values = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return let(values, lambda m: F.transform(words, lambda w: m[w]))


def number_words(text: Column) -> Column:
    """X16 (words): the numbers that words state, in order; "seventy five" is one, each other word is its own.

    A word from one to nine (or first to ninth) right behind a full ten belongs to it, so a look at either neighbour decides.
    """

    def joined(values: Column) -> Column:
        at = lambda i: F.get(values, i)
        ten = lambda v: F.coalesce((v >= 20) & (v <= 90) & (v % 10 == 0), F.lit(False))
        one = lambda v: F.coalesce(v.between(1, 9), F.lit(False))
        each = F.transform(values, lambda v, i: F.when(one(v) & ten(at(i - 1)), no_number()).when(ten(v) & one(at(i + 1)), v + at(i + 1)).otherwise(v))
        return F.array_compact(each)

    return let(word_values(text), joined)


def stated_numbers(text: Column) -> Column:
    """Numbers in digits, then those in words."""
    return F.concat(digit_numbers(text), number_words(text))


def spoken_numbers(text: Column) -> Column:
    """Number words read as whole phrases: as `number_words`, and "two hundred and five" is 205, "two and a half" 2.5.

    A fold over the words with the state (numbers so far, open number, whether "and" was heard since).
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    start = F.struct(F.array().cast("array<double>").alias("out"), no_number().alias("open"), F.lit(False).alias("joining"))
    closed = lambda s: F.when(s["open"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["open"]))
    state = lambda out, open_, joining: F.struct(out.alias("out"), open_.cast("double").alias("open"), joining.alias("joining"))

    def step(s: Column, x: Column) -> Column:
        word, value, total = x["word"], x["value"], s["open"]
        under_ten, under_hundred = (total % 100 >= 20) & (total % 10 == 0) & value.between(1, 9), (total % 100 == 0) & (total >= 100) & (value > 0) & (value < 100)
        adds = total.isNotNull() & (under_ten | under_hundred | (s["joining"] & (value < 1)))
        return (
            F.when((word == "hundred") & total.isNotNull(), state(s["out"], total * 100, F.lit(False)))
            .when(value.isNotNull() & adds, state(s["out"], total + value, F.lit(False)))
            .when(value.isNotNull(), state(closed(s), value, F.lit(False)))
            .when(total.isNotNull() & word.isin("and", "a"), state(s["out"], total, s["joining"] | (word == "and")))
            .otherwise(state(closed(s), no_number(), F.lit(False)))
        )

    pairs = F.zip_with(words, word_values(text), lambda w, v: F.struct(w.alias("word"), v.alias("value")))
    return F.aggregate(pairs, start, step, closed)


def unit_ratios(evidence: Column, key: str) -> Column:
    """By what a number in the evidence may be multiplied to give the field: 1, and what its own unit words say."""
    one = F.array(F.lit(1.0))
    if key == "land_acres":
        return F.when(evidence.rlike(HECTARE), F.array(F.lit(1.0), F.lit(ACRES_OF_HECTARE))).otherwise(one)
    if key != "annual_income_inr":
        return one
    units = F.array_compact(F.array(F.lit(1.0), *[F.when(evidence.rlike(pattern), F.lit(ratio)) for pattern, ratio in UNITS]))
    return F.when(evidence.rlike(MONTH), F.concat(units, F.transform(units, lambda u: u * 12))).otherwise(units)


def follows(value: Column, numbers: Column, ratios: Column) -> Column:
    """Some number times some ratio is the value, up to 2 % or 0.011."""
    return F.exists(numbers, lambda n: F.exists(ratios, lambda r: F.abs(value - n * r) <= F.greatest(F.abs(n * r) * 0.02, F.lit(0.011))))
