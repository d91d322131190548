"""Answers of text models against closed schemas: JSON read as VARIANT, three kinds of errors, and what of an answer may stay.

Everything is a Column expression over one row: no shuffle, and one bad field costs that field only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.functions.numbers import follows, stated_numbers, unit_ratios
from eligspark.functions.text import RATIOS, derivable, let, sentence_count, without_fences
from eligspark.schemas import CONSTRAINTS

# Places, closed sets and fields of a profile.
STATES = (
    "Andaman and Nicobar Islands", "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chandigarh", "Chhattisgarh", "Dadra and Nagar Haveli and Daman and Diu", "Delhi", "Goa", "Gujarat", "Haryana",
    "Himachal Pradesh", "Jammu and Kashmir", "Jharkhand", "Karnataka", "Kerala", "Ladakh", "Lakshadweep", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha",
    "Puducherry", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
)
CONFIDENCE = ("high", "medium", "low")
MOST_FACTS, LONGEST_QUESTION, NEARLY_EMPTY = 8, 200, 2
# Who speaks of whom, and how a summary differs from a translation.
FIRST_PERSON = r"(?i)\b(?:i|i'm|im|i've|me|my|myself)\b"
OTHER_PERSON = r"(?i)\b(?:sons?|daughters?|child|children|kids?|bab(?:y|ies)|mother|father|parents?|brother|sister|grand\w*|husband|wife|spouse)\b"
SPOUSE = r"(?i)\b(?:husband|wife|spouse)\b"
SELF_GENDER = r"(?i)\bI(?:'m| am| was)\s+(?:an?\s+)?(?:[\w-]+\s+){0,3}(?:woman|lady|female|girl|widow|mother|pregnant|wife|man|male|boy|widower|father|husband|transgender)\b"
SUMMARY = r"(?i)^\s*(?:a|an|the)\s+(?:\d+[- ]year[- ]old\s+)?(?:person|individual|user|applicant|people)\b|\b(?:is|are)\s+(?:looking|searching|seeking)\s+for\b"
INDIC = r"[ऀ-෿]"
NEGATION = r"(?i)\b(?:no|not|never|none|nothing|without|neither|nor|cannot)\b|n't"
SOURCE_NEGATION = {"hi": "नहीं|नही|कभी न|बिना", "te": "లేదు|లేక|కాదు|లేని|లేకుండా|ఎప్పుడూ", "ta": "இல்லை|இல்லாம|அல்ல", "bn": "না|নেই|ছাড়া"}
SPAN_ENDS = " \"'“”‘’.,;:!?।"


@dataclass(frozen=True)
class Field:
    """One entry of a closed schema.  kind: text, label (one of `values`), flag, true, number, whole, texts or object."""

    name: str
    kind: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    about_self: str = ""  # for profiles: how the evidence must speak of oneself
    required: bool = False
    fields: tuple[Field, ...] = ()  # of an object


PROFILE_FIELDS = (
    Field("occupation", "text"),
    Field("state", "label", STATES),
    Field("age", "whole", low=1, high=119, about_self="person"),
    Field("gender", "label", ("female", "male", "transgender"), about_self="gender"),
    Field("annual_income_inr", "whole", low=0),
    Field("land_acres", "number", low=0),
    Field("caste_category", "label", ("SC", "ST", "OBC", "EWS", "General")),
    Field("family", "text"),
    Field("education_class", "whole", low=1, high=12),
    Field("education_stage", "label", ("school", "higher_secondary", "diploma", "undergraduate", "postgraduate", "doctoral")),
    Field("residence", "label", ("rural", "urban")),
    Field("marital_status", "label", ("married", "unmarried", "widowed", "divorced", "separated", "abandoned"), about_self="spouse"),
    Field("disability_percent", "whole", low=0, high=100),
    Field("is_minority", "flag"),
    Field("bpl_household", "flag"),
    Field("registered_construction_worker", "flag"),
    Field("prior_benefit_schemes", "texts"),
    Field("applying_for", "label", ("self", "child", "spouse", "parent", "other")),
)
NUMBER_FIELDS = tuple(f for f in PROFILE_FIELDS if f.kind in ("number", "whole"))
CONTEXT_FIELDS = ("family", "prior_benefit_schemes", "applying_for")
CONSTRAINT_FIELDS = (
    Field("age", "object", fields=(Field("min", "whole"), Field("max", "whole"))),
    Field("income", "object", fields=(Field("max_annual_inr", "whole"), Field("basis", "label", ("family", "individual")))),
    Field("gender", "label", ("any", "female", "male", "transgender")),
    Field("category", "texts", ("EWS", "General", "Minority", "OBC", "PwD", "SC", "ST")),
    Field("occupation", "texts"),
    Field("land", "object", fields=(Field("max_acres", "number"), Field("min_acres", "number"))),
    Field("education", "object", fields=(Field("stage", "text"), Field("min_class", "whole"), Field("max_class", "whole"))),
    Field("state", "text"),
    Field("residence", "label", ("any", "rural", "urban")),
    Field("marital_status", "text"),
    Field("family", "object", fields=(Field("requires_dependent", "flag"), Field("notes", "text"))),
    Field("citizen_of_india", "true"),
    Field("bpl_household", "true"),
    Field("requires_bocw_registration", "true"),
    Field("not_availing_other_scheme", "true"),
    Field("residual_conditions", "texts", required=True),
)
#: Values that constrain nobody, so that they need no source.
UNBOUND = {"gender": "any", "residence": "any"}


def no_texts() -> Column:
    return F.array().cast("array<string>")


def listed(*errors: Column | None) -> Column:
    """The errors that aren't null, in order."""
    return F.array_compact(F.array(*[e for e in errors if e is not None])) if any(e is not None for e in errors) else no_texts()


def found(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def json_kind(value: Column) -> Column:
    """The JSON kind of a variant: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN; null for null, absent and JSON's null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def parsed(text: Column) -> Column:
    """A reply's JSON as VARIANT, code fences taken off; null unless the text is one JSON value and nothing more."""
    whole = F.try_parse_json(F.concat(F.lit("["), without_fences(text), F.lit("]")))
    return F.transform(F.array(whole), lambda v: F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) == 1, found(v, "$[0]")))[0]


def as_object(value: Column) -> Column:
    """A variant object as a map; null for everything else."""
    return F.when(json_kind(value) == "OBJECT", value.cast("map<string,variant>"))


def strings_of(value: Column) -> Column:
    """A list of non-blank strings; null where a variant is anything else."""
    items = F.when(json_kind(value) == "ARRAY", value.cast("array<variant>"))
    good = F.forall(items, lambda x: (F.coalesce(json_kind(x), F.lit("")) == "STRING") & (F.trim(x.cast("string")) != ""))
    return F.when(good, F.transform(items, lambda x: x.cast("string")))


def is_whole(value: Column) -> Column:
    """A number without a fraction (2.0 counts)."""
    number = value.cast("double")
    return json_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE") & (number == F.floor(number))


def kind_error(field: Field, value: Column, path: str, strict: bool = True) -> Column:
    """What is wrong with a value that is there; null if nothing.  `strict`: labels and whole numbers count as they stand."""
    kind, text = F.coalesce(json_kind(value), F.lit("VOID")), value.cast("string")
    say = lambda what: F.lit(f"{path}: {what}")
    if field.kind == "text":
        return F.when(kind != "STRING", say("must be text"))
    if field.kind == "label":
        known = text.isin(*field.values) if strict else F.lower(F.trim(text)).isin(*[v.lower() for v in field.values])
        return F.when((kind != "STRING") | ~known, say("not in the closed set"))
    if field.kind in ("flag", "true"):
        return F.when((kind != "BOOLEAN") | (F.lit(field.kind == "true") & (text != "true")), say("must be true or false" if field.kind == "flag" else "must be true or null"))
    if field.kind in ("number", "whole"):
        number = value.cast("double")
        out = F.when(~kind.isin("BIGINT", "DECIMAL", "DOUBLE"), say("must be a number"))
        if field.kind == "whole":
            out = out.when((kind != "BIGINT") if strict else ~is_whole(value), say("must be a whole number"))
        low, high = field.low, field.high
        if low is not None or high is not None:
            out = out.when((number < (low if low is not None else float("-inf"))) | (number > (high if high is not None else float("inf"))), say("out of bounds"))
        return out
    if field.kind == "texts":
        texts = strings_of(value)
        out = F.when(texts.isNull(), say("must be a list of texts"))
        return out.when(F.exists(texts, lambda t: ~t.isin(*field.values)), say("not in the closed set")) if field.values else out
    return F.when(kind != "OBJECT", say("must be an object"))


def schema_errors(value: Column, fields: tuple[Field, ...], path: str = "$", parent: str = "") -> Column:
    """Everything by which an object differs from a closed schema: unknown keys, missing required ones, kinds, sets, and
    minima above maxima; nested objects too."""
    have = F.map_keys(as_object(value if path == "$" else found(value, path)))
    unknown = F.array_sort(F.array_except(have, F.array(*[F.lit(f.name) for f in fields])))
    errors = [F.transform(F.coalesce(unknown, no_texts()), lambda k: F.concat(F.lit(parent), k, F.lit(": unknown key")))]
    for field in fields:
        name, at = f"{parent}{field.name}", f"{path}.{field.name}"
        inner = found(value, at)
        missing = F.when(~F.coalesce(F.array_contains(have, field.name), F.lit(False)), F.lit(f"{name}: missing")) if field.required else None
        errors.append(listed(missing, F.when(json_kind(inner).isNotNull(), kind_error(field, inner, name))))
        if field.fields:
            errors.append(F.when(json_kind(inner) == "OBJECT", schema_errors(value, field.fields, at, f"{name}.")).otherwise(no_texts()))
    if {"min", "max"} <= {f.name for f in fields}:
        low, high = found(value, f"{path}.min", "double"), found(value, f"{path}.max", "double")
        errors.append(listed(F.when(low > high, F.lit(f"{parent.rstrip('.')}: min above max"))))
    return F.concat(*errors)


def provenance_spans(value: Column) -> Column:
    """Provenance as field -> spans: a text is one span, of lists and objects the texts in them count."""
    entries = F.map_entries(as_object(value))

    def spans(x: Column) -> Column:
        many = F.when(json_kind(x) == "ARRAY", x.cast("array<variant>")).when(json_kind(x) == "OBJECT", F.map_values(x.cast("map<string,variant>")))
        texts = F.filter(many, lambda y: (F.coalesce(json_kind(y), F.lit("")) == "STRING") & (F.trim(y.cast("string")) != ""))
        return F.when(json_kind(x) == "STRING", F.array(x.cast("string"))).otherwise(F.coalesce(F.transform(texts, lambda y: y.cast("string")), no_texts()))

    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), spans(e["value"]).alias("value"))))


def is_set(value: Column, field: Field) -> Column:
    """A field states something: an object with a value, a list with an item, or any other value."""
    inner = found(value, f"$.{field.name}")
    kind = json_kind(inner)
    some = F.exists(F.map_values(as_object(inner)), lambda x: json_kind(x).isNotNull())
    return F.coalesce(F.when(kind == "OBJECT", some).when(kind == "ARRAY", F.size(inner.cast("array<variant>")) > 0).otherwise(kind.isNotNull()), F.lit(False))


def provenance_errors(value: Column, spans: Column, source: Column, fields: tuple[Field, ...] = CONSTRAINT_FIELDS) -> Column:
    """Spans of unknown fields, empty ones, ones that the source doesn't have, and fields without spans or spans without fields."""
    fields = tuple(f for f in fields if f.name != "residual_conditions")
    unknown = F.array_sort(F.array_except(F.map_keys(spans), F.array(*[F.lit(f.name) for f in fields])))
    errors = [F.transform(F.coalesce(unknown, no_texts()), lambda k: F.concat(k, F.lit(": unknown key of provenance")))]
    for f in fields:
        own, stated = spans[f.name], is_set(value, f)
        bound = stated if f.name not in UNBOUND else stated & (F.coalesce(found(value, f"$.{f.name}", "string"), F.lit("")) != UNBOUND[f.name])
        blank = (F.size(own) == 0) | F.exists(own, lambda s: F.trim(s) == "")
        errors.append(
            listed(
                F.when(own.isNull() & bound, F.lit(f"{f.name}: no provenance")),
                F.when(own.isNotNull() & ~stated, F.lit(f"{f.name}: provenance of nothing")),
                F.when(blank, F.lit(f"{f.name}: empty span")).when(F.exists(own, lambda s: ~F.contains(F.coalesce(source, F.lit("")), s)), F.lit(f"{f.name}: span is not in the text")),
            )
        )
    return F.concat(*errors)


def validated_constraints(rows: DataFrame, reply: str = "reply", source: str = "eligibility_text") -> DataFrame:
    """`rows` with errors (array), and constraints and provenance of replies without any (else null).

    A reply is {"constraints": ..., "provenance": ...}, maybe in code fences.  Null and unreadable replies, and other
    JSON than an object, have one structural error.
    """
    read = rows.withColumn("__v", parsed(F.col(reply)))
    read = read.withColumns({"__c": found(F.col("__v"), "$.constraints"), "__p": provenance_spans(found(F.col("__v"), "$.provenance"))})
    no_object = lambda c: F.coalesce(json_kind(c), F.lit("")) != "OBJECT"
    top = F.when(F.col("__v").isNull(), F.lit("not JSON")).when(no_object(F.col("__v")), F.lit("not a JSON object")).when(no_object(F.col("__c")), F.lit("constraints: must be an object")).when(F.col("__p").isNull(), F.lit("provenance: must be an object"))
    read = read.withColumn("__top", top)
    inner = F.concat(schema_errors(F.col("__c"), CONSTRAINT_FIELDS), provenance_errors(F.col("__c"), F.col("__p"), F.col(source)))
    read = read.withColumn("errors", F.when(F.col("__top").isNotNull(), F.array("__top")).otherwise(inner))
    fine = F.size("errors") == 0
    out = {"constraints": F.when(fine, F.from_json(F.to_json("__c"), CONSTRAINTS)), "provenance": F.when(fine, F.col("__p"))}
    return read.withColumns(out).drop("__v", "__c", "__p", "__top")


def guarded_removal(residuals: Column, removals: Column, spans: Column, least: float = 0.85) -> Column:
    """struct(kept, removed, uncovered, states_more) of residuals that a reply wants removed.

    removals: array of struct(text, fields, also_states).  A residual goes only if it states nothing more and enough of
    its words occur in the spans of the fields it repeats; all others stay, in order.
    """
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def judged(x: Column) -> Column:
        cited = F.flatten(F.transform(x["fields"], lambda f: F.coalesce(spans[f], no_texts())))
        known, own = F.flatten(F.transform(cited, words)), words(x["text"])
        share = F.size(F.filter(own, lambda w: F.array_contains(known, w))) / F.size(own)
        verdict = F.when(F.size(x["also_states"]) > 0, "states_more").when((F.size(own) > 0) & (share >= least), "removed").otherwise("uncovered")
        return F.struct(x["text"].alias("text"), verdict.alias("verdict"))

    def sorted_out(judgements: Column) -> Column:
        of = lambda name: F.transform(F.filter(judgements, lambda j: j["verdict"] == name), lambda j: j["text"])
        gone = of("removed")
        return F.struct(F.filter(residuals, lambda r: ~F.array_contains(gone, r)).alias("kept"), gone.alias("removed"), of("uncovered").alias("uncovered"), of("states_more").alias("states_more"))

    return F.transform(F.array(F.transform(F.coalesce(removals, F.array().cast("array<struct<text:string,fields:array<string>,also_states:array<string>>>")), judged)), sorted_out)[0]


def span_norm(text: Column) -> Column:
    """Lower case, single spaces, no quotation or end marks around."""
    return F.btrim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), F.lit(SPAN_ENDS))


def translation_problems(text: Column, query: Column, lang: Column) -> Column:
    """By what an English translation departs from its text: numbers, negation, sentences, voice, script."""
    numbers, translated = stated_numbers(text), stated_numbers(query)
    denies = F.coalesce(*[F.when(lang == name, text.rlike(pattern)) for name, pattern in SOURCE_NEGATION.items()], F.lit(False))
    return listed(
        F.when(query.rlike(INDIC), F.lit("translation: not all in English")),
        F.when(F.exists(numbers, lambda n: ~derivable(n, translated, RATIOS)), F.lit("translation: number lost")),
        F.when(F.exists(translated, lambda n: ~derivable(n, numbers, RATIOS)), F.lit("translation: number added")),
        F.when(denies & ~query.rlike(NEGATION), F.lit("translation: negation lost")),
        F.when((sentence_count(text) >= 2) & (sentence_count(query) < sentence_count(text) - 1), F.lit("translation: sentences merged")),
        F.when(query.rlike(SUMMARY), F.lit("translation: a summary")),
    )


def speaks_of_self(about: str, words: Column) -> Column:
    """The words are the person's own about themself: gender by a self-description, else first person and nobody else (a spouse may occur)."""
    if about == "gender":
        return words.rlike(SELF_GENDER)
    others = F.regexp_replace(words, SPOUSE, " ") if about == "spouse" else words
    return words.rlike(FIRST_PERSON) & ~others.rlike(OTHER_PERSON)


def number_evidence(lang: Column) -> Column:
    """The numbers that the evidence of each number field states, in one expression for all of them."""

    def texts(f: Field) -> Column:
        said = found(F.col("__evidence"), f"$.{f.name}")
        plain = F.when(json_kind(said) == "STRING", F.array(said.cast("string"))).otherwise(F.coalesce(strings_of(said), no_texts()))
        if not f.about_self:
            return F.array_join(plain, " ")
        pair = (lang != "en") & as_object(said).isNotNull()
        return F.when(pair, F.concat_ws(" ", found(said, "$.original", "string"), found(said, "$.en", "string"))).otherwise(F.array_join(plain, " "))

    return F.transform(F.array(*map(texts, NUMBER_FIELDS)), stated_numbers)


def field_evidence(field: Field, lang: Column) -> Column:
    """struct(spans, own, problem) of one field: spans of the text, the words that must be the person's own, what is wrong with them."""
    said, translated = found(F.col("__evidence"), f"$.{field.name}"), lang != "en"
    inside = lambda s, whole: (span_norm(s) != "") & F.contains(F.col(whole), span_norm(s))
    plain = F.when(json_kind(said) == "STRING", F.array(said.cast("string"))).otherwise(strings_of(said))

    def of_plain(plain: Column) -> Column:
        problem = F.when(plain.isNull() | (F.size(plain) == 0) | F.exists(plain, lambda s: ~(inside(s, "__text") | inside(s, "__query"))), F.lit(f"{field.name}: evidence is not in the text"))
        own = F.array_join(plain, " ")
        if field.about_self:
            problem = F.coalesce(problem, F.when(translated & own.rlike(INDIC), F.lit(f"{field.name}: evidence must be a pair")))
        return F.struct(plain.alias("spans"), own.alias("own"), problem.alias("problem"))

    if not field.about_self:
        return let(plain, of_plain)
    both, original, english = as_object(said), found(said, "$.original", "string"), found(said, "$.en", "string")
    whole = (F.size(both) == 2) & (F.trim(F.coalesce(original, F.lit(""))) != "") & (F.trim(F.coalesce(english, F.lit(""))) != "")
    of_pair = F.when(~whole, F.lit(f"{field.name}: evidence must be a pair")).when(~inside(original, "__text"), F.lit(f"{field.name}: evidence is not in the text")).when(english.rlike(INDIC) | ~inside(english, "__query"), F.lit(f"{field.name}: evidence is not in the translation"))
    return F.when(translated & both.isNotNull(), F.struct(F.array(F.trim(original)).alias("spans"), F.trim(english).alias("own"), of_pair.alias("problem"))).otherwise(let(plain, of_plain))


def profile_field(field: Field, lang: Column) -> Column:
    """struct(value, error, confidence, spans, own_words) of one field of the columns __profile, __confidence, __evidence, __e_*, __numbers, __text, __query."""
    value, sure = (found(F.col(c), f"$.{field.name}") for c in ("__profile", "__confidence"))
    translated = lang != "en"
    none = json_kind(value).isNull() | (F.lit(field.kind == "texts") & (F.coalesce(F.size(strings_of(value)), F.lit(-1)) == 0))
    mentioned = F.array_contains(F.map_keys(as_object(F.col("__confidence"))), field.name) | F.array_contains(F.map_keys(as_object(F.col("__evidence"))), field.name)
    grounded = lambda s: (span_norm(s) != "") & (F.contains(F.col("__text"), span_norm(s)) | F.contains(F.col("__query"), span_norm(s)))
    spans, own, shape = (F.col(f"__e_{field.name}.{part}") for part in ("spans", "own", "problem"))
    text = value.cast("string")
    shown, more = text, F.lit(None).cast("string")
    if field.kind == "text":
        more = F.when(F.trim(text) == "", F.lit(f"{field.name}: must be text"))
        shown = F.lower(F.trim(text))
        if field.name == "family":
            shown = F.btrim(F.regexp_replace(shown, "[^a-z0-9]+", "_"), F.lit("_"))
    elif field.kind == "label":
        if field.name == "marital_status":
            value = F.when(F.lower(F.trim(text)).isin("widow", "widower"), F.parse_json(F.lit('"widowed"'))).otherwise(value)
            text = value.cast("string")
        shown = F.create_map(*[F.lit(x) for v in field.values for x in (v.lower(), v)])[F.lower(F.trim(text))]
    elif field.kind == "texts":
        texts = F.transform(strings_of(value), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
        more, shown = F.when(F.exists(texts, lambda x: ~grounded(x)), F.lit(f"{field.name}: not named in the text")), F.to_json(texts)
    elif field.kind in ("number", "whole"):
        span_text, numbers = F.array_join(spans, " "), F.get(F.col("__numbers"), [f.name for f in NUMBER_FIELDS].index(field.name))
        more = F.when(F.size(numbers) == 0, F.lit(f"{field.name}: evidence states no number")).when(~follows(value.cast("double"), numbers, unit_ratios(span_text, field.name)), F.lit(f"{field.name}: doesn't follow from its evidence"))
        shown = value.cast("double").cast("long").cast("string") if field.kind == "whole" else value.cast("double").cast("string")
    foreign = F.when(~speaks_of_self(field.about_self, own), F.lit(f"{field.name}: not said of oneself")) if field.about_self else F.lit(None).cast("string")
    unsure = F.when(~F.coalesce(sure.cast("string").isin(*CONFIDENCE) & (json_kind(sure) == "STRING"), F.lit(False)), F.lit(f"{field.name}: no valid confidence"))
    error = F.when(none, F.when(mentioned, F.lit(f"{field.name}: null, but with confidence or evidence"))).otherwise(F.coalesce(unsure, shape, foreign, kind_error(field, value, field.name, strict=False), more))

    def kept(s: Column) -> Column:
        fine = ~s["none"] & s["error"].isNull()
        return F.struct(F.when(fine, s["shown"]).alias("value"), s["error"].alias("error"), F.when(fine, s["sure"]).alias("confidence"), F.when(fine, spans).alias("spans"), F.when(fine & translated & F.lit(bool(field.about_self)), own).alias("own_words"))

    return let(F.struct(none.alias("none"), error.alias("error"), shown.alias("shown"), sure.cast("string").alias("sure")), kept)


FACTS = "array<struct<original:string,en:string>>"


def other_facts(profile: Column, lang: Column) -> Column:
    """struct(facts, errors): facts copied from the text, their English from the translation; at most eight stay."""
    raw = found(profile, "$.other_facts")
    items = F.when(json_kind(raw) == "ARRAY", raw.cast("array<variant>")).otherwise(F.array().cast("array<variant>"))
    space = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " "))

    def fact(x: Column) -> Column:
        original, english = space(found(x, "$.original", "string")), space(found(x, "$.en", "string"))
        shaped = (F.size(as_object(x)) == 2) & (original != "") & (english != "") & (json_kind(found(x, "$.original")) == "STRING") & (json_kind(found(x, "$.en")) == "STRING")
        inside = (span_norm(original) != "") & F.contains(F.col("__text"), span_norm(original))
        carried = ~english.rlike(INDIC) & (F.col("__query") != "") & F.contains(F.col("__query"), span_norm(english))
        error = F.when(~F.coalesce(shaped, F.lit(False)), F.lit("other_facts: must be pairs")).when(~inside, F.lit("other_facts: not in the text")).when((lang != "en") & ~carried, F.lit("other_facts: not in the translation"))
        return F.struct(original.alias("original"), F.when(lang == "en", original).otherwise(english).alias("en"), error.alias("error"))

    judged = F.transform(items, fact)

    def collected(facts: Column) -> Column:
        good = F.transform(F.filter(facts, lambda f: f["error"].isNull()), lambda f: F.struct(f["original"].alias("original"), f["en"].alias("en")))
        errors = F.concat(
            listed(F.when(json_kind(raw).isNotNull() & (json_kind(raw) != "ARRAY"), F.lit("other_facts: must be a list"))), F.transform(F.filter(facts, lambda f: f["error"].isNotNull()), lambda f: f["error"]), listed(F.when(F.size(good) > MOST_FACTS, F.lit("other_facts: too many")))
        )
        return F.struct(F.slice(good, 1, MOST_FACTS).alias("facts"), errors.alias("errors"))

    return F.transform(F.array(judged), collected)[0]


def validated_profiles(rows: DataFrame, reply: str = "reply", text: str = "text", lang: str = "lang") -> DataFrame:
    """`rows` with profile, confidence, evidence, own_words, facts, question, errors, field_errors and question_errors.

    `errors` are structural and leave no profile; a field error leaves that field null; a question error drops the question.
    Null and unreadable replies have a structural error; a null language is English; a null text grounds nothing.
    """
    here = F.coalesce(F.col(lang), F.lit("en"))
    top = ("profile", "confidence", "evidence", "clarifying_question")
    read = rows.withColumns({"__v": parsed(F.col(reply)), "__lang": here})
    here = F.col("__lang")
    query = F.when(here != "en", F.trim(F.regexp_replace(F.when(json_kind(found(F.col("__v"), "$.search_query_en")) == "STRING", found(F.col("__v"), "$.search_query_en", "string")), r"(?U)\s+", " ")))
    read = read.withColumns({"__profile": found(F.col("__v"), "$.profile"), "__confidence": found(F.col("__v"), "$.confidence"), "__evidence": found(F.col("__v"), "$.evidence"), "__english": F.nullif(query, F.lit("")), "__text": span_norm(F.col(text))})
    read = read.withColumns({"__query": span_norm(F.col("__english")), "__numbers": number_evidence(here)})
    read = read.withColumns({f"__e_{f.name}": field_evidence(f, here) for f in PROFILE_FIELDS})
    read = read.withColumns({f"__f_{f.name}": profile_field(f, here) for f in PROFILE_FIELDS} | {"__facts": other_facts(F.col("__profile"), here)})
    part = lambda f, name: F.col(f"__f_{f.name}")[name]
    # structure
    want = F.when(here == "en", F.array(*map(F.lit, top))).otherwise(F.array(*map(F.lit, (*top, "search_query_en"))))
    have, fields = F.map_keys(as_object(F.col("__v"))), F.array(*[F.lit(f.name) for f in PROFILE_FIELDS], F.lit("other_facts"))
    of_profile = F.map_keys(as_object(F.col("__profile")))
    keys = lambda found_, what: F.transform(F.array_sort(found_), lambda k: F.concat(k, F.lit(f": {what}")))
    not_object = lambda c, name: F.when(as_object(F.col(c)).isNull(), F.lit(f"{name}: must be an object"))
    shape = F.concat(keys(F.array_except(have, want), "unknown key"), keys(F.array_except(want, have), "missing key"), listed(not_object("__profile", "profile"), not_object("__confidence", "confidence"), not_object("__evidence", "evidence")), F.coalesce(keys(F.array_except(of_profile, fields), "unknown field"), no_texts()), F.coalesce(keys(F.array_except(fields, of_profile), "missing field"), no_texts()))
    known_state = part(next(f for f in PROFILE_FIELDS if f.name == "state"), "value")
    named = lambda name: F.regexp_like("__query", F.concat(F.lit(r"\b"), F.lower(name), F.lit(r"\b"))) & ~known_state.eqNullSafe(name) & ~F.contains("__text", F.lower(name))
    placed = F.transform(F.filter(F.array(*map(F.lit, STATES)), named), lambda name: F.concat(F.lit("translation: names "), name))
    translation = F.when(here == "en", no_texts()).when(F.col("__english").isNull(), F.array(F.lit("translation: missing"))).otherwise(F.concat(translation_problems(F.coalesce(F.col(text), F.lit("")), F.col("__english"), here), placed))
    errors = F.when(F.col("__v").isNull(), F.array(F.lit("not JSON"))).when(as_object(F.col("__v")).isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.concat(shape, translation))
    # fields
    strange = lambda c, name: F.transform(F.coalesce(F.array_sort(F.array_except(F.map_keys(as_object(F.col(c))), F.array(*[F.lit(f.name) for f in PROFILE_FIELDS]))), no_texts()), lambda k: F.concat(F.lit(f"{name}: unknown key "), k))
    field_errors = F.concat(listed(*[part(f, "error") for f in PROFILE_FIELDS]), strange("__confidence", "confidence"), strange("__evidence", "evidence"), F.col("__facts.errors"))
    read = read.withColumns({"errors": errors, "field_errors": field_errors})
    # question
    asked = found(F.col("__v"), "$.clarifying_question")
    filled = sum((part(f, "value").isNotNull().cast("int") for f in PROFILE_FIELDS if f.name not in CONTEXT_FIELDS), F.lit(0))
    question_text = asked.cast("string")
    marks = F.length(question_text) - F.length(F.replace(question_text, F.lit("?"), F.lit("")))
    wrong = F.when(json_kind(asked).isNull(), F.lit(None).cast("string")).when((json_kind(asked) != "STRING") | (marks != 1) | (F.length(question_text) > LONGEST_QUESTION), F.lit("question: must be one short question")).when(filled >= NEARLY_EMPTY, F.lit("question: the profile isn't nearly empty"))
    read = read.withColumn("question_errors", listed(wrong))
    fine = F.size("errors") == 0
    kinds = {"age": "int", "annual_income_inr": "long", "land_acres": "double", "education_class": "int", "disability_percent": "double", "prior_benefit_schemes": "array<string>"}
    cast = lambda f: F.from_json(part(f, "value"), "array<string>") if f.kind == "texts" else part(f, "value").cast("boolean" if f.kind == "flag" else kinds.get(f.name, "string"))
    entries = lambda name: F.map_from_entries(F.array_compact(F.array(*[F.when(part(f, name).isNotNull(), F.struct(F.lit(f.name).alias("key"), part(f, name).alias("value"))) for f in PROFILE_FIELDS])))
    out = {
        "profile": F.when(fine, F.struct(*[cast(f).alias(f.name) for f in PROFILE_FIELDS])), "facts": F.when(fine, F.col("__facts.facts")), "confidence": F.when(fine, entries("confidence")), "evidence": F.when(fine, entries("spans")), "own_words": F.when(fine, entries("own_words")),
        "query_en": F.when(fine, F.when(here == "en", F.col(text)).otherwise(F.col("__english"))), "question": F.when(fine & (F.size("question_errors") == 0) & (json_kind(asked) == "STRING"), F.trim(question_text)),
    }
    return read.withColumns(out).drop("__v", "__lang", "__profile", "__confidence", "__evidence", "__english", "__text", "__query", "__numbers", "__facts", *[f"__{kind}_{f.name}" for f in PROFILE_FIELDS for kind in "ef"])
