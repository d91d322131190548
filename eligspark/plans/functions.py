"""Queries of the text and rule functions, over whole tables: texts as they are, or made from keys so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligspark.functions import rules as R
from eligspark.functions import text as X
from eligspark.functions import wording as T
from eligspark.operators import chunking
from eligspark.operators.postprocess import count_sentence
from eligspark.schemas import as_list
from eligspark.tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def chosen(key: Column, texts: tuple) -> Column:
    """The text numbered by the key modulo their number; None is null."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(texts):
        out = F.when(key % len(texts) == k, F.lit(text)).otherwise(out)
    return out


def chosen_sql(key: str, values: tuple) -> str:
    """The same in SQL."""
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then {sql_value(v)}" for k, v in enumerate(values) if v is not None) + " end"


def sql_value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def text_normal_forms(spark, sf_dir):
    """X01, X03, X04, X05, X19."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(X.collapse(t)).alias("collapsed"), F.md5(X.evidence_norm(t)).alias("evidence"), F.md5(X.plain_norm(t)).alias("plain"), F.md5(X.phrase_norm(t)).alias("phrase"), X.sentence_count(t).cast("long").alias("n_sentences"))


def run_on_sentences(spark, sf_dir):
    """X09 over texts whose sentences are glued together."""
    glued = F.replace("text", F.lit(". "), F.lit("."))
    return docs(spark, sf_dir).select("doc_id", F.md5(X.split_run_on(glued)).alias("split_md5"))


def quotable_heads(spark, sf_dir):
    """X26 over whole texts after a lead that is chosen by the key."""
    lead = chosen(F.col("doc_id"), LEADS)
    return docs(spark, sf_dir).select("doc_id", F.md5(X.quotable(F.concat(lead, "text"))).alias("quote_md5"))


LEADS = ("Note 3: ", "2) ", "a. ", ' "', "", "—; ")


def word_measures(spark, sf_dir):
    """How much of a text it covers itself once runs of seven letters and more are gone, and its stems."""
    shorter = F.regexp_replace("text", "[A-Za-z]{7,}", " ")
    return docs(spark, sf_dir).select("doc_id", F.round(X.word_coverage(F.col("text"), shorter), 6).alias("coverage"), F.md5(F.array_join(X.stems(F.col("text")), ",")).alias("stems_md5"))


def chip_text() -> Column:
    return F.concat(F.lit("HOME"), F.col("p_brand"), F.lit("Scheme"), F.col("p_size").cast("string"), F.lit("OfABCdef"))


def tag_chips(spark, sf_dir):
    """Blobs of tags, and whether each chip looks like a tag."""
    chips = X.tag_chips(chip_text())
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(chips, "|").alias("chips"), F.size(F.filter(chips, X.looks_like_tag)).cast("long").alias("n_tags"))


def tag_blobs(spark, sf_dir):
    """State, level, tags and flags out of a page's head, whose copies of the name differ in their spaces."""
    k = F.col("p_partkey")
    name, other = F.concat(F.lit("Loan-B for "), F.col("p_brand")), F.concat(F.lit("Loan - Bfor"), F.col("p_brand"))
    second = F.when(k % 4 == 0, "something else ").otherwise(name)
    blob = F.when(k % 7 == 0, " ").otherwise(F.concat(other, chosen(k, ("Kerala", " Ministry of Aid ", "")), second, F.lit("AABCSSubsidyScheduled Caste"), F.when(k % 5 == 0, "sign in").otherwise("")))
    got = X.tag_blob(blob, name, ("Kerala", "Goa"))
    rows = table(spark, sf_dir, "part").select("p_partkey", got.alias("t"))
    return rows.select("p_partkey", "t.state", "t.level", F.array_join("t.tags", "|").alias("tags"), F.array_join("t.flags", "|").alias("flags"))


def stated_dates(spark, sf_dir):
    """Day-first dates out of texts, and their long form."""
    text = F.when(F.col("o_orderkey") % 10 == 0, "valid from 31/02/2020").otherwise(F.concat(F.lit("updated "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" again")))
    found = X.day_first_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.cast("string").alias("day"), X.long_date(found).alias("long_form"))


INCOME = ("our family income", "I earn well", "my salary, and my father's", "some money", "my pension")
LAND = ("two acres on lease", "my own farm", "rented from a tenant", "landholding", "somewhere")
STAGE_TEXTS = ("PhD scholars", "post-graduate or graduate", "Class 11 or 12", "diploma / ITI", "pre-matric", "whoever", "primary school")
STAGES = ("doctoral", "postgraduate,undergraduate", "higher_secondary", "diploma", "school", None, "school,higher_secondary")
MARITAL_TEXTS = ("widow", "widows or divorced women", "for all", "single mothers", "unmarried girls", "married, separated")
MARITAL = ("widowed", "widowed,divorced", "any", None, "unmarried", "married,separated")


def rule_words(spark, sf_dir):
    """X20, X21, X22, F05, F09, F13."""
    k = F.col("p_partkey")
    value, conf = F.when(k % 3 > 0, k), chosen(k, ("high", "low", "medium", None))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        R.income_basis(chosen(k, INCOME)).alias("income"),
        R.land_basis(chosen(k, LAND)).alias("land"),
        F.array_join(R.stages_admitted(chosen(k, STAGE_TEXTS)), ",").alias("stages"),
        F.array_join(R.marital_admitted(chosen(k, MARITAL_TEXTS)), ",").alias("marital"),
        F.coalesce(R.constrains(chosen(k, ("any", "female", None))), F.lit(False)).alias("constrains"),
        X.is_empty_clause(chosen(k, ("N.A.", "none", "Not applicable", "no one", "nil."))).alias("says_nothing"),
        R.confident(value, conf).alias("confident"),
        R.confident(value, None).alias("without_map"),
    )


def json_numbers(spark, sf_dir):
    """The numbers of a constraint's JSON, and provenance of any shape as a list."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit('{"min":'), size, F.lit(',"max":null,"note":"up to 2.5 lakh","flag":true}'))
    shape = F.when(F.col("p_partkey") % 3 == 0, F.lit('"one"')).when(F.col("p_partkey") % 3 == 1, F.lit('["a", " ", "b"]')).otherwise(F.lit('{"x": "p", "y": ["q", "r"]}'))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(R.constraint_numbers(text), X.number_text), ",").alias("numbers"), F.array_join(as_list(shape), ",").alias("provenance"))


def worded_counts(spark, sf_dir):
    """Lists and counts in the template languages."""
    k = F.col("p_partkey")
    lang = T.language(chosen(k, ("en", "hi", "te", "ta")))
    parts = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.joined(parts, lang).alias("listed"), count_sentence((k % 4 + 1).cast("int"), lang).alias("sentence"), count_sentence((k % 4 + 1).cast("int"), lang, other=True).alias("others"))


NAMED = "{0} Old Age Pension Scheme, the Kisan Yojana and the {0} old age pension Scheme"


def names_in_texts(spark, sf_dir):
    """X31, X32, X33, X41."""
    brand = F.regexp_replace("p_brand", "[^A-Za-z]", "")
    text = F.concat(F.lit("the "), brand, F.lit(" Pension Scheme and Kisan Yojana; the "), F.upper(brand), F.lit(' PENSION Scheme. See "'), F.initcap("p_type"), F.lit('" too.'))
    name = F.concat(F.initcap("p_type"), F.lit(" Scheme (PMEGP) (new) (AbC)"))
    slug = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p"), F.col("p_size").cast("string"))).otherwise("a-long-slug")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(X.named_things(text), "|").alias("names"), F.array_join(X.name_tokens(name), "|").alias("tokens"), F.array_join(X.acronyms(name, slug), "|").alias("acronyms"), F.array_join(X.quoted_names(text), "|").alias("quoted")
    )


def replies_and_errors(spark, sf_dir):
    """X34, X42, Z04."""
    k = F.col("event_id")
    reply = F.when(k % 3 == 0, F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```"))).when(k % 3 == 1, F.concat(F.lit('Sure: {"a": '), k, F.lit("} done"))).otherwise(F.concat(F.lit('{"a": '), k, F.lit("}")))
    message = F.concat(F.lit("slug 'x"), k, F.lit("' has 12 chars: more of "), k)
    from eligspark.operators.providers import wait_before

    wait = wait_before(chosen(k, ("minute", "retryable", "fatal")), (k % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", X.without_fences(reply).alias("reply"), X.error_kind(message).alias("kind"), wait.cast("long").alias("wait"))


CLAIMS = (
    ("You are eligible for this scheme.", "en", 1, False), ("You may be eligible.", "en", 0, False), ("Once checked, you qualify.", "en", 0, False), ("You will get it. If not, you qualify.", "en", 1, False),
    ("You are not eligible.", "en", 0, True), ("आप पात्र हैं।", "hi", 1, False), ("आप पात्र नहीं हैं।", "hi", 0, True), ("మీరు అర్హులు.", "te", 1, False), ("మీరు అర్హులు కారు.", "te", 0, True), ("You do not qualify here.", "en", 0, True),
)
RELATED = (("This helps your daughter.", "my girl is ten", ""), ("This helps your daughter.", "I farm", "daughter"), ("Your young son and your wife benefit.", "married", "son"), ("Your scheme.", "", ""))


def claims_and_relatives(spark, sf_dir):
    """X39, X40."""
    k = F.col("p_partkey")
    text, lang = chosen(k, tuple(c[0] for c in CLAIMS)), chosen(k, tuple(c[1] for c in CLAIMS))
    reason, fact = chosen(k, tuple(c[0] for c in RELATED)), chosen(k, tuple(c[1] for c in RELATED))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(X.unhedged_claims(text, lang)).cast("long").alias("n_claims"), X.denials(text, lang).alias("denies"), F.array_join(X.unsupported_relatives(reason, F.array(fact)), ",").alias("relatives"))


BROKEN = ("Ã©tude", "plain", "à la carte", "naÃ¯ve")
MENDED = ("étude", "plain", "à la carte", "naïve")


def mended_texts(spark, sf_dir):
    """X08."""
    return table(spark, sf_dir, "part").select("p_partkey", X.mend(F.concat(chosen(F.col("p_partkey"), BROKEN), F.lit(" "), F.col("p_brand"))).alias("text"))


def vector_checks(spark, sf_dir):
    """Each vector's product with itself, and whether it has length 1 once scaled."""
    scaled = F.transform("embedding", lambda x: x * F.when(F.col("vec_id") % 3 == 0, 1.01).otherwise(1.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.dot(F.col("embedding"), F.col("embedding")), 5).alias("product"), X.is_unit(scaled).alias("unit"))


def conversions(spark, sf_dir):
    """What a value in the unit of its evidence may stand for."""
    k = F.col("p_partkey")
    evidence = chosen(k, ("1.5 lakh a year", "15 thousand per month", "2 crore", "3 hectares", "7 acres", "5,000 monthly"))
    stated = chosen(k, ("1.5", "15", "2", "3", "7", "5000")).cast("double")
    value = chosen(k, ("150000", "180000", "20000000", "7.4", "8", "60000")).cast("double")
    ratios = X.conversion_ratios(evidence)
    return table(spark, sf_dir, "part").select("p_partkey", F.exists(ratios, lambda r: X.close(stated * r, value)).alias("fits"), F.size(ratios).cast("long").alias("n_ratios"))


def clause_split_simple(spark, sf_dir):
    """Pieces of each text by the chunker's own breaks, where only a sentence end is one: counted, with their longest.

    Lists, abbreviations and words that clauses open with don't occur once digits, stops after one letter and such words are masked.
    """
    masked = masked_text(F.col("text"))
    rows = docs(spark, sf_dir).select("doc_id", X.fenced(chunking.sentences(masked)).alias("pieces"))
    return rows.select("doc_id", F.size("pieces").cast("long").alias("n_clauses"), F.coalesce(F.array_max(F.transform("pieces", F.length)), F.lit(0)).cast("long").alias("longest"))


def masked_text(text: Column) -> Column:
    words = F.regexp_replace(F.lower(X.collapse(text)), "[^a-z.!? ]", "q")
    return F.regexp_replace(F.concat(F.regexp_replace(words, "[a-z]+", "wqqqw"), F.lit(" ")), r"([.!?]) w", "$1 Wq")


def clauses_within_length(spark, sf_dir):
    """Texts without breaks, cut to pieces; pieces that are too short joined."""
    plain = F.regexp_replace(F.lower(X.collapse(F.col("text"))), "[^a-z ]+", "")
    pieces = chunking.within_length(F.trim(F.regexp_replace(plain, " +", " ")))
    joined = chunking.without_scraps(F.slice(F.split(plain, " "), F.lit(1), F.lit(50)))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(F.array_max(F.transform(pieces, F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.replace(F.array_join(pieces, ""), F.lit(" "), F.lit(""))).alias("letters_md5"), F.array_join(joined, "|").alias("joined"))


QUERIES = {
    "text_normal_forms": text_normal_forms, "run_on_sentences": run_on_sentences, "quotable_heads": quotable_heads, "word_measures": word_measures, "tag_chips": tag_chips, "tag_blobs": tag_blobs, "stated_dates": stated_dates,
    "rule_words": rule_words, "json_numbers": json_numbers, "worded_counts": worded_counts, "names_in_texts": names_in_texts, "replies_and_errors": replies_and_errors, "claims_and_relatives": claims_and_relatives,
    "mended_texts": mended_texts, "vector_checks": vector_checks, "conversions": conversions, "sentence_breaks": clause_split_simple, "clauses_within_length": clauses_within_length,
}

WHITE = "[\\s\\x{0B}\\x{85}\\p{Z}]+"
COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g'))"
PUNCT = (X.PUNCTUATION + " ").replace("'", "''")
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
BRAND = "regexp_replace(p_brand, '[^A-Za-z]', '', 'g')"
TITLE = "array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
NAMES = "regexp_extract_all(" + f"'the ' || {BRAND} || ' Pension Scheme and Kisan Yojana; the ' || upper({BRAND}) || ' PENSION Scheme. See \"' || {TITLE} || '\" too.'" + ", '(?:\\p{Lu}[\\p{L}''-]*\\s+){1,6}(?:Scheme|Yojana|Mission|Programme|Fund)\\b')"
CHIPS = "string_split(regexp_replace(regexp_replace('HOME' || p_brand || 'Scheme' || p_size || 'OfABCdef', '([a-z0-9])([A-Z])', '\\1|\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1|\\2', 'g'), '|')"
LANG = "case p_partkey % 4 when 1 then 'hi' when 2 then 'te' else 'en' end"


def by_lang(texts: dict[str, str]) -> str:
    return f"case {LANG} when 'hi' then {sql_value(texts['hi'])} when 'te' then {sql_value(texts['te'])} else {sql_value(texts['en'])} end"


def counted_sql(texts: dict[str, str]) -> str:
    noun = f"case when p_partkey % 4 = 0 then {by_lang({k: v[0] for k, v in T.NOUN.items()})} else {by_lang({k: v[1] for k, v in T.NOUN.items()})} end"
    return f"replace(replace({by_lang(texts)}, '{{n}}', cast(p_partkey % 4 + 1 as varchar)), '{{noun}}', {noun})"


MASKED = f"regexp_replace(regexp_replace(regexp_replace(lower({COLLAPSED}), '[^a-z.!? ]', 'q', 'g'), '[a-z]+', 'wqqqw', 'g') || ' ', '([.!?]) w', '\\1 Wq', 'g')"
ORACLES = {
    "text_normal_forms": f"""select doc_id, md5({COLLAPSED}) as collapsed, md5(trim(lower({COLLAPSED}), '{PUNCT}')) as evidence, md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{WHITE}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'))) as plain,
  md5(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) as phrase,
  cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?।]+(?:\\s+|$)'), lambda x: trim(x) <> '')) as bigint) as n_sentences from documents""",
    "run_on_sentences": "select doc_id, md5(regexp_replace(replace(text, '. ', '.'), '([\\p{Ll}\\p{N})][.!?;:])(\\p{Lu})', '\\1 \\2', 'g')) as split_md5 from documents",
    "quotable_heads": f"""with t as (select doc_id, trim(regexp_replace({chosen_sql('doc_id', LEADS)} || text, '{WHITE}', ' ', 'g')) as t from documents)
select doc_id, md5(regexp_replace(regexp_replace(t, '^(?:note\\s*\\d*\\s*[:.\\-]\\s*|\\d{{1,2}}[.)]\\s*|[a-z][.)]\\s*)', '', 'i'), '^[\\s:;,.\\-–—"''“”‘’]+', '')) as quote_md5 from t""",
    "word_measures": f"""with w as (select doc_id, {WORDS.format('text')} as w, {WORDS.format("regexp_replace(text, '[A-Za-z]{7,}', ' ', 'g')")} as h, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4) as s from documents)
select doc_id, round(len(list_filter(w, lambda x: list_contains(h, x)))::double / nullif(len(w), 0), 6) as coverage, md5(array_to_string(list_transform(s, lambda x: left(x, 5)), ',')) as stems_md5 from w""",
    "tag_chips": f"""with c as (select p_partkey, {CHIPS} as c from part) select p_partkey, array_to_string(c, '|') as chips,
  cast(len(list_filter(c, lambda x: len(list_filter(regexp_split_to_array(x, '[\\s-]+'), lambda w: w <> '' and not regexp_matches(w, '^(?:[^\\p{{L}}]|\\p{{Lu}})'))) = 0)) as bigint) as n_tags from c""",
    "tag_blobs": """with t as (select p_partkey, p_partkey % 3 as a, p_partkey % 4 = 0 as lost, p_partkey % 5 = 0 as noisy, p_partkey % 7 = 0 as gone from part)
select p_partkey, case when not gone and not lost and a = 0 then 'Kerala' end as state, case when not gone and not lost then case a when 0 then 'state' when 1 then 'central' end end as level,
  case when gone then '' when noisy then 'Subsidy' else 'Subsidy|Scheduled Caste' end as tags,
  case when gone then 'tag_blob_empty' else concat_ws('|', case when lost then 'tag_blob_name_not_found' end, case when lost or a = 2 then 'level_uncertain' end, case when noisy or lost then 'tag_blob_noise_filtered' end) end as flags from t""",
    "stated_dates": "select o_orderkey, case when o_orderkey % 10 > 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 10 > 0 then strftime(o_orderdate, '%-d %B %Y') end as long_form from orders",
    "rule_words": f"""select p_partkey, {chosen_sql('p_partkey', ('family', 'individual', 'family', None, 'individual'))} as income, {chosen_sql('p_partkey', ('leased', 'owned', 'leased', 'owned', None))} as land,
  {chosen_sql('p_partkey', STAGES)} as stages, {chosen_sql('p_partkey', MARITAL)} as marital, p_partkey % 3 = 1 as constrains, {chosen_sql('p_partkey', (True, True, True, False, True))} as says_nothing,
  p_partkey % 3 > 0 and p_partkey % 4 in (0, 2) as confident, false as without_map from part""",
    "json_numbers": "select p_partkey, p_size || ',2.5' as numbers, case p_partkey % 3 when 0 then 'one' when 1 then 'a,b' else 'p,q,r' end as provenance from part",
    "worded_counts": f"""select p_partkey, case p_partkey % 3 when 0 then 'a' when 1 then 'a' || {by_lang(T.AND)} || 'b' else 'a, b' || {by_lang(T.AND)} || 'c' end as listed, {counted_sql(T.COUNT)} as sentence, {counted_sql(T.COUNT_OTHER)} as others from part""",
    "names_in_texts": f"""with n as (select p_partkey, p_size, {NAMES} as n, {TITLE} as title from part), u as (select *, list_transform(n, lambda x: lower(x)) as l from n)
select p_partkey, array_to_string(list_filter(n, lambda x, i: list_position(l, lower(x)) = i), '|') as names,
  array_to_string(list_filter(regexp_extract_all(lower(title || ' Scheme (PMEGP) (new) (AbC)'), '[\\p{{L}}\\p{{N}}]+'), lambda w, i: length(w) > 2 and not list_contains(['scheme', 'yojana', 'mission', 'programme', 'fund', 'for', 'the', 'and'], w)
    and list_position(regexp_extract_all(lower(title || ' Scheme (PMEGP) (new) (AbC)'), '[\\p{{L}}\\p{{N}}]+'), w) = i), '|') as tokens,
  'PMEGP|AbC' || case when p_partkey % 2 = 0 then '|P' || p_size else '' end as acronyms, case when length(title) >= 4 then title else '' end as quoted from u""",
    "replies_and_errors": "select event_id, '{\"a\": ' || event_id || '}' as reply, 'slug … has N chars' as kind, cast(case when event_id % 4 <= 2 then case event_id % 3 when 0 then 20 * (event_id % 4) when 1 then pow(2, event_id % 4) end end as bigint) as wait from events",
    "claims_and_relatives": f"select p_partkey, cast({chosen_sql('p_partkey', tuple(c[2] for c in CLAIMS))} as bigint) as n_claims, {chosen_sql('p_partkey', tuple(c[3] for c in CLAIMS))} as denies, {chosen_sql('p_partkey', tuple(c[2] for c in RELATED))} as relatives from part",
    "mended_texts": f"select p_partkey, {chosen_sql('p_partkey', MENDED)} || ' ' || p_brand as text from part",
    "vector_checks": "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 5) as product, vec_id % 3 > 0 as unit from embeddings",
    "conversions": f"select p_partkey, {chosen_sql('p_partkey', (True, True, True, True, False, True))} as fits, cast({chosen_sql('p_partkey', (2, 4, 2, 2, 1, 2))} as bigint) as n_ratios from part",
    "sentence_breaks": f"""with m as (select doc_id, {MASKED} as t from documents), s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])(\\s*(?:[A-Z]|$))', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as p from m)
select doc_id, cast(len(p) as bigint) as n_clauses, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) as longest from s""",
}
