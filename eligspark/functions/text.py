"""Text functions as Column expressions.

Character classes are spelt out (``\\p{L}\\p{N}``) because the engine's ``\\w`` and ``\\s`` know ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the lexical index leaves out.
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the this to was were will with".split()
# Markers of a requirement, and the phrase that grants rather than restricts.
REQUIREMENT = r"(?i)\b(?:must|should|shall|required|only|cannot|excluded|at least|minimum|maximum|not more than|not less than|up to|ineligible|not eligible|will not|shall not)\b"
INCLUSION = r"(?i)\b(?:is|are|shall be|will be)\s+also\s+eligible\b"
PRIORITY = r"(?i)\bprior(?:ity|ities|itis\w*|itiz\w*)\b|\bprefer(?:ence|ences|ential|red)\b|\breservation\b|first be assigned"
EMPTY_CLAUSES = ("na", "n a", "nil", "none", "not applicable")
# The ten digits of each script in numeric order.
DIGITS = {"devanagari": "०१२३४५६७८९", "telugu": "౦౧౨౩౪౫౬౭౮౯", "tamil": "௦௧௨௩௪௫௬௭௮௯", "bengali": "০১২৩৪৫৬৭৮৯"}
# Ratios by which a stated amount may be converted.
RATIOS = (1.0, 1e3, 1e-3, 1e5, 1e-5, 1e7, 1e-7, 12.0, 1 / 12.0, 2.471, 1 / 2.471, 12e5, 12e3)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, even where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fenced(column: Column) -> Column:
    """The same values, but not deterministic in the optimizer's eyes, so that a long expression isn't copied into each of its uses."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def compiled_apart(column: Column) -> Column:
    """As `fenced`, and compiled in small methods.

    Whole-stage code is one method for each operator; a long projection makes it too long for the JVM to compile, and it is
    interpreted from then on.  A projection that holds a function with a lambda stays out of whole-stage code.
    """
    return F.when(F.exists(F.array(F.monotonically_increasing_id()), lambda i: i >= 0), column)


def collapse(text: Column) -> Column:
    """Every run of white space (with no-break spaces) is one space; trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, numbers and underscores without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def evidence_norm(text: Column) -> Column:
    """Lower-cased, collapsed, without punctuation at either end."""
    return F.btrim(F.lower(collapse(text)), F.lit(PUNCTUATION + " "))


def plain_norm(text: Column) -> Column:
    """Lower-cased letters a-z, digits and spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), "[^a-z0-9 ]+", " "))


def phrase_norm(text: Column) -> Column:
    """Lower-cased, punctuation to spaces, collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def flexible(phrase: Column) -> Column:
    """A pattern for the phrase that allows its spaces to be missing, and spaces beside its hyphens."""
    spaced = F.replace(F.replace(phrase, F.lit(r"\E"), F.lit("")), F.lit(" "), F.lit(r"\E\s?\Q"))
    hyphens = F.replace(spaced, F.lit("-"), F.lit(r"\E\s?-\s?\Q"))
    return F.concat(F.lit(r"\Q"), hyphens, F.lit(r"\E"))


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, navigation, advertisements, footers, comments and tags go; entities for & < > resolve."""
    out = html
    for name in ("script", "style", "nav", "footer"):
        out = F.regexp_replace(out, f"(?is)<{name}[^>]*>.*?</{name}>", " ")
    out = F.regexp_replace(out, r'(?is)<div class="ad">.*?</div>', " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, letter in (("&middot;", " "), ("&copy;", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def mend(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; other text stays."""
    raw = F.encode(text, "ISO-8859-1")
    fits = (F.decode(raw, "ISO-8859-1") == text) & text.rlike("[Â-ô][\u0080-¿]")
    return F.when(fits & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def split_run_on(text: Column) -> Column:
    """A sentence glued to the one before (letter, stop, capital) gets a space."""
    return F.regexp_replace(text, r"(?<=[\p{Ll}\p{N})][.!?;:])(?=\p{Lu})", " ")


def tag_chips(blob: Column) -> Column:
    """A CamelCase blob of tags as a list."""
    parts = F.split(F.coalesce(blob, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def looks_like_tag(tag: Column) -> Column:
    """every word of the chip starts with a capital or with no letter."""
    words = F.filter(F.split(tag, r"[\s-]+"), lambda w: w != "")
    return let(words, lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: w.rlike(r"^(?:[^\p{L}]|\p{Lu})")))


def tag_blob(preamble: Column, name: Column, states: tuple[str, ...]) -> Column:
    """struct(state, level, tags, flags) of the text between two copies of a scheme's name and the tags behind the second.

    A state before the second copy means its level, other text there the central one; a leading acronym is no tag, nor is a
    chip that isn't written as one.
    """
    blob, pattern = F.trim(F.coalesce(preamble, F.lit(""))), flexible(F.coalesce(name, F.lit("")))
    named = F.coalesce(name, F.lit("")) != ""
    rest = F.when(named, F.regexp_replace(blob, F.concat(F.lit("^"), pattern), F.lit(""))).otherwise(blob)

    def read(parts: Column) -> Column:
        found = F.size(parts) == 2
        before, after = F.when(found, F.trim(parts[0])).otherwise(""), F.when(found, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
        state = F.when(before.isin(*states), before)
        level = F.when(state.isNotNull(), "state").when(before != "", "central")
        chips = let(tag_chips(after), lambda c: F.when(F.get(c, F.lit(0)).rlike("^[A-Z0-9]{2,12}$"), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c))

        def done(c: Column) -> Column:
            tags = F.filter(c, looks_like_tag)
            flags = F.array(F.when(~found, "tag_blob_name_not_found"), F.when(level.isNull(), "level_uncertain"), F.when(F.size(tags) < F.size(c), "tag_blob_noise_filtered"))
            return F.struct(state.alias("state"), level.alias("level"), tags.alias("tags"), F.array_compact(flags).alias("flags"))

        return let(chips, done)

    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("state"), none.alias("level"), F.array().cast("array<string>").alias("tags"), F.array(F.lit("tag_blob_empty")).alias("flags"))
    return F.when(blob == "", empty).otherwise(let(F.when(named, F.split(rest, pattern, F.lit(2))).otherwise(F.array(rest)), read))


def day_first_date(text: Column) -> Column:
    """X11: the first dd/mm/yyyy in the text as a date; null if there is none or it isn't one."""
    return F.try_to_date(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4})", 1), "dd/MM/yyyy")


def ascii_digits(text: Column) -> Column:
    for digits in DIGITS.values():
        text = F.translate(text, digits, "0123456789")
    return text


def digit_numbers(text: Column) -> Column:
    """X16 (digits): numbers in any of the scripts; grouped thousands are one number, a decimal point or comma counts."""
    found = F.regexp_extract_all(ascii_digits(F.coalesce(text, F.lit(""))), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))
    grouped = F.transform(found, lambda x: F.when(x.rlike(r"^[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit("."))))
    return F.filter(F.transform(grouped, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def close(a: Column, b: Column) -> Column:
    """Equal up to 2 % of b or 0.011."""
    return F.abs(a - b) <= F.greatest(F.abs(b) * 0.02, F.lit(0.011))


def derivable(value: Column, numbers: Column, ratios: tuple[float, ...] = RATIOS) -> Column:
    """Some number times some ratio is close to the value."""
    return F.exists(numbers, lambda n: F.exists(F.array(*map(F.lit, ratios)), lambda r: close(n * r, value)))


def conversion_ratios(evidence: Column) -> Column:
    """Ratios that the unit words of the evidence allow."""
    parts = [F.array(F.lit(1.0))]
    monthly = evidence.rlike(r"(?i)\b(?:per month|a month|monthly|p\.?m\.?)\b")
    for pattern, ratio in ((r"(?i)\blakhs?\b|\blacs?\b", 1e5), (r"(?i)\bcrores?\b", 1e7), (r"(?i)\bthousand\b|\bk\b", 1e3), (r"(?i)\bhectares?\b", 2.471)):
        parts.append(F.when(evidence.rlike(pattern), F.array(F.lit(ratio))).otherwise(F.array().cast("array<double>")))
        parts.append(F.when(evidence.rlike(pattern) & monthly, F.array(F.lit(ratio * 12))).otherwise(F.array().cast("array<double>")))
    parts.append(F.when(monthly, F.array(F.lit(12.0))).otherwise(F.array().cast("array<double>")))
    return F.array_distinct(F.concat(*parts))


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between sentence ends."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?।]+(?:\s+|$)"), lambda x: F.trim(x) != ""))


def is_requirement(text: Column) -> Column:
    """the text restricts who qualifies, once inclusion phrases are gone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), INCLUSION, " ").rlike(REQUIREMENT)


def is_priority(text: Column) -> Column:
    """language of preference, not of exclusion."""
    return F.coalesce(text.rlike(PRIORITY), F.lit(False))


def is_empty_clause(text: Column) -> Column:
    """nothing but "na", "nil", "none" and the like."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " ")).isin(*EMPTY_CLAUSES)


def is_grounded(quote: Column, source: Column) -> Column:
    """the quote, its white space collapsed and final ellipsis dropped, is a part of the source."""
    needle = F.trim(F.rtrim(F.regexp_replace(F.coalesce(quote, F.lit("")), r"\s+", " "), F.lit("…")))
    return (needle != "") & F.contains(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s+", " "), needle)


def quotable(text: Column) -> Column:
    """Without leading numbering, punctuation and quotation marks."""
    out = F.regexp_replace(collapse(text), r"(?i)^(?:note\s*\d*\s*[:.\-]\s*|\d{1,2}[.)]\s*|[a-z][.)]\s*)", "")
    return F.regexp_replace(out, "^[\\s:;,.\\-–—\"'“”‘’]+", "")


def indian_grouping(amount: Column) -> Column:
    """120000 as 1,20,000 (whole numbers; the last three digits, then pairs)."""
    digits = F.abs(amount).cast("decimal(38,0)").cast("string")
    head = F.left(digits, F.greatest(F.length(digits) - 3, F.lit(0)))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    body = F.when(F.length(digits) > 3, F.concat(grouped, F.lit(","), F.right(digits, F.lit(3)))).otherwise(digits)
    return F.concat(F.when(amount < 0, "-").otherwise(""), body)


def compact_number(value: Column) -> Column:
    """A number without a needless fraction."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def number_text(value: Column) -> Column:
    """A number without a needless fraction, six significant digits else."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", value.cast("double")), r"(\.\d*?)0+$", "$1"))


def listed(parts: Column, last: str = " and ") -> Column:
    """X28: "a, b and c"."""
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(parts, -1)))


def document_list(text: Column) -> Column:
    """A list of documents: bullets, then numbers, then sentences; headers and scraps go; first of equal items stays."""

    def pieces(parts: Column, pattern: str) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.split(x, pattern)))

    out = F.split(F.coalesce(text, F.lit("")), r"\s*[•\n]\s*")
    for pattern in (r"(?:^|(?<=\s))\d{1,2}[.)]\s+", r"(?<=[.;])\s+(?=\p{Lu})", r"(?<=[a-z)])(?=\p{Lu}[a-z]{2})"):
        out = pieces(out, pattern)
    out = F.transform(out, lambda x: F.btrim(x, F.lit(" .;,:-")))
    return F.array_distinct(F.filter(out, lambda x: (F.length(x) >= 3) & ~F.lower(x).rlike("^(?:documents?|documents required|list of documents)$")))


def named_things(text: Column, keywords: tuple[str, ...] = ("Scheme", "Yojana", "Mission", "Programme", "Fund")) -> Column:
    """One to six capitalised words and a keyword; of names that differ in case only the first stays."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:\p{{Lu}}[\p{{L}}'-]*\s+){{1,6}}(?:{'|'.join(keywords)})\b"), F.lit(0))
    return let(names, lambda n: let(F.transform(n, lambda x: F.lower(x)), lambda lower: F.filter(n, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)))


def name_tokens(name: Column, generic: tuple[str, ...] = ("scheme", "yojana", "mission", "programme", "fund", "for", "the", "and")) -> Column:
    """Words of a name that tell it apart: over two letters and not generic."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*generic)))


def acronyms(name: Column, slug: Column) -> Column:
    """Parenthesised tokens with two capitals or more, and the slug itself in capitals if it is short."""
    inside = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\(([A-Za-z0-9&-]{2,15})\)"), F.lit(1))
    good = F.filter(inside, lambda x: F.regexp_count(x, F.lit("[A-Z]")) >= 2)
    return F.array_distinct(F.concat(good, F.when(slug.rlike("^[a-z0-9]{2,8}$"), F.array(F.upper(slug))).otherwise(F.array().cast("array<string>"))))


def without_fences(text: Column) -> Column:
    """A reply without its code fences; the outermost braces if text stands around them."""
    plain = F.trim(F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(plain)


def cache_key(*parts: Column) -> Column:
    """Sha-256 of the JSON list of the parts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def fuzzy_words_match(a: Column, b: Column) -> Column:
    """One word set contains the other, or their Jaccard similarity is at least 0.5."""
    x, y = word_set(a), word_set(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((both == F.least(F.size(x), F.size(y))) | (both * 2 >= either))


def word_coverage(text: Column, by: Column) -> Column:
    """Share of the text's words, each time they occur, that `by` has; null without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    hits = let(word_set(by), lambda known: F.size(F.filter(words, lambda w: F.array_contains(known, w))))
    return let(words, lambda ws: F.try_divide(hits.cast("double"), F.size(ws)))


def stems(name: Column) -> Column:
    """The first five letters of words of four letters or more."""
    words = F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)
    return F.transform(words, lambda w: F.left(w, F.lit(5)))


# Wording that claims, hedges or denies eligibility, by language.
CLAIM = {
    "en": r"(?i)\byou(?:'re|\s+are)\s+(?:(\w+)\s+)?(?:eligible|qualified|entitled)\b|\byou\s+(?:(\w+)\s+)?qualify\b|\byou\s+(?:will|shall)\s+(?:(\w+)\s+)?(?:get|receive)\b",
    "hi": r"(?:पात्र|योग्य|हकदार|हक़दार)\s*(?:हैं|है|हो|होंगे|होंगी|होगा|होगी)(?![\u0900-\u0963\u0971-\u097F])|लाभ\s+(?:मिलेगा|मिल\s+जाएगा|ले\s+सकते)",
    "te": r"అర్హులు(?![\u0C00-\u0C7F])(?!\s*కా)|అర్హత\s+(?:ఉంది|కలదు)|ప్రయోజనం\s+(?:పొందుతారు|లభిస్తుంది)",
}
HEDGE = {
    "en": r"(?i)\b(?:may|might|could|would|if|whether|once|until|unless|before|after|confirm\w*|check\w*|verif\w*|not|possibly|potentially|provided|only)\b|n't",
    "hi": r"सकते|सकती|सकता|नहीं|यदि|अगर|पुष्टि|जाँच|जांच|बाद|शायद|संभव|तभी",
    "te": r"కావచ్చు|అవుతారో|అర్హులా|కాదు|కారు|ఉంటే|నిర్ధారించ|తనిఖీ|తర్వాత|ఉండవచ్చు|లేదో|ఏమో",
}
DENIAL = {
    "en": r"(?i)\bnot\s+(?:be\s+)?eligible\b|\bineligible\b|\b(?:do|does)\s+not\s+qualify\b|\b(?:don|doesn)'t\s+qualify\b",
    "hi": r"(?:पात्र|योग्य)\s+नहीं",
    "te": r"అర్హులు\s+కా(?:రు|దు)",
}
# The Indic scripts, and the script of each language that has one of its own.
INDIC = r"[\u0900-\u0D7F]"
SCRIPTS = {"hi": r"[\u0900-\u097F]", "te": r"[\u0C00-\u0C7F]", "ta": r"[\u0B80-\u0BFF]", "bn": r"[\u0980-\u09FF]"}


def by_language(lang: Column, make) -> Column:
    """`make(code)` of the template language in `lang`, English for others."""
    out = make("en")
    for code in ("hi", "te"):
        out = F.when(lang == code, make(code)).otherwise(out)
    return out


def denials(text: Column, lang: Column) -> Column:
    """The text says that someone isn't eligible."""
    return F.coalesce(by_language(lang, lambda code: text.rlike(DENIAL[code])), F.lit(False))


def unhedged_claims(text: Column, lang: Column) -> Column:
    """Phrases that claim eligibility with no hedge in the 60 characters before or the 30 after within the sentence,
    nor inside the phrase ("you may be eligible", "to confirm you qualify" are none)."""

    def found(code: str) -> Column:
        sentences = F.split(F.coalesce(text, F.lit("")), "[.!?।]")

        def claims_of(s: Column) -> Column:
            phrases, around = F.regexp_extract_all(s, F.lit(CLAIM[code]), F.lit(0)), F.split(s, CLAIM[code])
            # the sentence as what stands before a claim, the claim, what stands before the next, ..., what is left
            parts = F.concat(F.flatten(F.transform(phrases, lambda p, i: F.array(F.get(around, i), p))), F.array(F.get(around, F.size(phrases))))

            def marked(parts: Column) -> Column:
                window = lambda i: F.struct(F.get(parts, 2 * i + 1).alias("p"), F.array_join(F.slice(parts, F.lit(1), 2 * i + 1), "").alias("before"), F.array_join(F.slice(parts, 2 * i + 3, F.size(parts)), "").alias("after"))
                claims = F.transform(phrases, lambda _, i: window(i))
                clear = F.filter(claims, lambda m: ~(F.right(m["before"], F.lit(60)).rlike(HEDGE[code]) | F.left(m["after"], F.lit(30)).rlike(HEDGE[code]) | m["p"].rlike(HEDGE[code])))
                return F.transform(clear, lambda m: m["p"])

            return let(parts, marked)

        return F.flatten(F.transform(sentences, claims_of))

    return by_language(lang, found)


def denies(text: Column) -> Column:
    """X39 in English."""
    return denials(text, F.lit("en"))


def claims(text: Column) -> Column:
    """X39 in English: whether any phrase claims eligibility."""
    return F.size(unhedged_claims(text, F.lit("en"))) > 0


# How a reason names a relative in English, Hindi and Telugu, and words of the facts that support it.
RELATIVES = {
    "daughter": ({"en": r"\byour\s+(?:\w+\s+)?daughters?\b", "hi": r"आपकी\s+(?:बेटी|बेटियों|पुत्री)", "te": r"మీ\s+(?:కూతురు|కుమార్తె)"}, ("daughter", "girl")),
    "son": ({"en": r"\byour\s+(?:\w+\s+)?sons?\b", "hi": r"आपके\s+(?:बेटे|पुत्र)|आपका\s+बेटा", "te": r"మీ\s+(?:కొడుకు|కుమారుడు)"}, ("son", "boy")),
    "child": ({"en": r"\byour\s+(?:\w+\s+)?(?:child|children|kids?|baby)\b", "hi": r"आपके\s+बच्च|आपका\s+बच्चा|आपकी\s+संतान", "te": r"మీ\s+(?:పిల్ల|బిడ్డ)"}, ("child", "kid", "baby", "son", "daughter", "girl", "boy", "year-old", "pregnan")),
    "spouse": ({"en": r"\byour\s+(?:wife|husband|spouse)\b", "hi": r"आपकी\s+पत्नी|आपके\s+पति", "te": r"మీ\s+(?:భార్య|భర్త)"}, ("wife", "husband", "spouse", "married")),
    "parent": ({"en": r"\byour\s+(?:mother|father|parents?)\b", "hi": r"आपकी\s+(?:माँ|मां|माता)|आपके\s+(?:पिता|माता-पिता)", "te": r"మీ\s+(?:తల్లి|తండ్రి|తల్లిదండ్రులు)"}, ("mother", "father", "parent")),
}


def unsupported_relatives(reason: Column, facts: Column, lang: Column | None = None) -> Column:
    """Relatives that the reason calls "your ..." though no fact mentions them; only in languages with patterns."""
    lang = F.lit("en") if lang is None else lang
    lower = F.lower(F.array_join(facts, " "))
    named = []
    for who, (patterns, words) in RELATIVES.items():
        said = F.lit(False)
        for code, pattern in patterns.items():
            said = F.when(lang == code, reason.rlike("(?i)" + pattern)).otherwise(said)
        supported = F.lit(False)
        for word in words:
            supported = supported | F.contains(lower, F.lit(word))
        named.append(F.when(F.coalesce(said, F.lit(False)) & ~supported, F.lit(who)))
    return F.array_compact(F.array(*named))


def quoted_names(text: Column) -> Column:
    """Capitalised names in quotation marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[\"“]([\\p{Lu}][^\"”]{3,80})[\"”]"), F.lit(1))


def error_kind(message: Column) -> Column:
    """A message without its particulars: quoted text, numbers and what follows a colon go."""
    out = F.regexp_replace(F.regexp_replace(message, "'[^']*'|\"[^\"]*\"", "…"), r"\d+", "N")
    return F.left(F.split_part(out, F.lit(":"), F.lit(1)), F.lit(60))


def long_date(date: Column) -> Column:
    """5 March 2024."""
    return F.date_format(date, "d MMMM yyyy")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def is_unit(vector: Column, tolerance: float = 1e-3) -> Column:
    """The vector has length 1 within the tolerance."""
    return F.abs(F.sqrt(dot(vector, vector)) - 1) <= tolerance


def truncate(text: Column, n: int) -> Column:
    """P05."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(n))


def error_class(message: Column) -> Column:
    """Daily, minute, retryable or fatal."""
    return (
        F.when(message.rlike(r"(?i)per day|daily|quota.*day|rpd|tpd"), "daily").when(message.rlike(r"(?i)\b429\b|rate limit|per minute|rpm|tpm"), "minute").when(message.rlike(r"(?i)\b5\d\d\b|timeout|unavailable|overloaded"), "retryable").otherwise("fatal")
    )
