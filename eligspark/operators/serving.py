"""Serving: one plan from texts to ordered verdicts for any number of queries, and the shapes that clients read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.functions.rules import NUMERIC_KINDS
from eligspark.functions.text import document_list, is_grounded
from eligspark.operators import matcher, search
from eligspark.operators.names import notices
from eligspark.operators.postprocess import display_order, fallback_reason, finalize, with_explanations, without_dependent_note
from eligspark.schemas import RULES, STATUSES

#: Results served, candidates explained, chunks shown with one, longest query.
SERVED, EXPLAINED, SHOWN_CHUNKS, LONGEST_QUERY = 10, 5, 20, 2000
# The profile fields in the order in which facts are numbered.
FACT_FIELDS = ("occupation", "state", "age", "gender", "annual_income_inr", "land_acres", "caste_category", "family", "education_class", "education_stage", "residence", "marital_status", "disability_percent", "is_minority", "bpl_household", "registered_construction_worker", "applying_for")
# Questions for the fields that a verdict may wait for (English).
QUESTIONS = {
    "age": "How old is the person?", "annual_income_inr": "What is the yearly income, and is it the family's or one person's?", "land_acres": "How much land is there, and is it owned or leased?", "state": "Which state does the person live in?",
    "gender": "What is the person's gender?", "caste_category": "Which category does the person belong to?", "occupation": "What work does the person do?", "education_stage": "What is the highest stage of education?", "education_class": "Which class is the person in?",
    "residence": "Is the home rural or urban?", "marital_status": "What is the marital status?", "is_minority": "Does the person belong to a minority?", "disability_percent": "Is there a disability, and of what percentage?", "bpl_household": "Is the household below the poverty line?", "registered_construction_worker": "Is the person registered with the construction workers' board?",
}


def person_facts(profiles: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, fact_id, field, text): stated fields in fixed order, numbered F1, F2, ...; applying for oneself is no fact; other facts follow."""
    have = set(profiles.columns)
    parts = []
    for field in FACT_FIELDS:
        if f"p_{field}" in have:
            text = F.col(f"p_{field}").cast("string")
            stated = text.isNotNull() & (text != "self") if field == "applying_for" else text.isNotNull()
            parts.append(F.when(stated, F.struct(F.lit(field).alias("field"), text.alias("text"))))
    facts = F.array_compact(F.array(*parts))
    if "p_facts" in have:
        facts = F.concat(facts, F.coalesce(F.transform("p_facts", lambda x: F.struct(F.lit("other").alias("field"), x.alias("text"))), F.array().cast("array<struct<field:string,text:string>>")))
    rows = profiles.select(key, F.posexplode(facts).alias("n", "x"))
    return rows.select(key, F.concat(F.lit("F"), (F.col("n") + 1).cast("string")).alias("fact_id"), "x.field", "x.text")


def first_clause(chunks: DataFrame) -> DataFrame:
    """Per scheme its first eligibility clause, else its overview."""
    place = F.struct((F.col("section") == "overview").cast("int"), (F.col("section") == "exclusions").cast("int"), F.col("chunk_id"))
    best = chunks.groupBy("slug").agg(F.min_by(F.struct("chunk_id", "section", "raw_text"), place).alias("c"))
    return best.select("slug", "c.chunk_id", "c.section", "c.raw_text")


def condition_chunks(chunks: DataFrame, most: int = SHOWN_CHUNKS) -> DataFrame:
    """Per scheme up to `most` condition chunks in order; the overview where there is none."""
    rows = chunks.withColumn("__o", (F.col("section") == "overview").cast("int"))
    order, whole = W.partitionBy("slug").orderBy("__o", "chunk_id"), W.partitionBy("slug")
    rows = rows.withColumn("__n", F.row_number().over(order)).withColumn("__conditions", F.sum(1 - F.col("__o")).over(whole))
    return rows.filter(((F.col("__o") == 0) & (F.col("__n") <= most)) | ((F.col("__conditions") == 0) & (F.col("__n") == 1))).drop("__o", "__n", "__conditions")


def to_explain(evaluated: DataFrame, query: str = "query_id", rank: str = "rnk", most: int = EXPLAINED) -> DataFrame:
    """The best five candidates of a query that aren't ruled out."""
    order = W.partitionBy(query).orderBy(rank)
    return evaluated.filter("status <> 'not_eligible'").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def result_shape(rows: DataFrame) -> DataFrame:
    """What a client reads: whitelisted status, name or slug, the clause that matched, lists never null."""
    have = set(rows.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    clause = F.coalesce(F.get(col("citations", "array<struct<chunk_id:string,quote:string>>"), F.lit(0))["quote"], col("evidence_text", "string"))
    return rows.withColumns(
        {
            "status": F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("needs_checking"),
            "scheme_name": F.coalesce(F.nullif(F.trim(col("scheme_name", "string")), F.lit("")), F.col("slug").cast("string")),
            "matched_clause": clause,
            **{n: F.coalesce(col(n, "array<string>"), empty) for n in ("unverified", "to_confirm", "caveats", "documents")},
        }
    )


def flagged(items: Column, flags: Column) -> Column:
    """Items with their flags, false where a flag is missing."""
    return F.transform(items, lambda x, i: F.struct(x.alias("text"), F.coalesce(F.get(flags, i), F.lit(False)).alias("verbatim")))


def status_counts(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """Results per status and query."""
    return rows.groupBy(query).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def question(field: Column) -> Column:
    """The question for a field; null if there is none."""
    return F.create_map(*[F.lit(x) for p in QUESTIONS.items() for x in p])[field]


def match(queries: DataFrame, chunks: DataFrame, profiles: DataFrame, constraints: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = SERVED, rules: tuple[str, ...] = RULES, meanings: DataFrame | None = None, explanations: DataFrame | None = None, schemes: DataFrame | None = None, index: search.LexicalIndex | None = None, named: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Retrieve, evaluate, explain, finalize and order for all queries in one plan.

    queries (query_id, text, and maybe lang), chunks (chunk_id long, slug, text, and maybe section), profiles (query_id, p_*),
    constraints (slug, c_*).  With vectors (chunk_id, embedding) and query_vectors (query_id, embedding) the search is hybrid;
    with `meanings` (text, vector) of occupations, facts and residuals occupations are compared (J08) and facts touch
    residuals (J09); `explanations` (query_id, slug, status, reason, citations) take the place of template reasons (J10);
    `schemes` (slug, eligibility_text, documents_text) give the text that quotes must stand in, and the documents.  With
    `index` the search reads a stored index instead of the chunks' texts.  A candidate without a record needs checking.
    With `named` (query_id, name, tokens) and `known` (id2, tokens2) every row of a query lists the schemes that the query
    names and nobody knows, as `unknown_names` in name order (D13).

    One row per query and result: status and reason of the matcher, template, caveats, final_status, final_reason, flags,
    documents, question and place.
    """
    texts = queries.select("query_id", F.left("text", F.lit(LONGEST_QUERY)).alias("text"))
    hits = index.search(texts, search.CANDIDATES, "query_id") if index is not None else search.search_bm25(texts, chunks, search.CANDIDATES, "query_id", "chunk_id")
    if vectors is not None and query_vectors is not None:
        near = search.search_dense(query_vectors, vectors, search.CANDIDATES, "query_id", "chunk_id")
        hits = search.fuse(near, hits, "query_id", "chunk_id")
    rolled = search.roll_up(hits.select("query_id", "chunk_id", "score", "rnk").join(chunks.select("chunk_id", "slug"), "chunk_id"), "slug", "query_id", "chunk_id", k)
    found = rolled.select("query_id", "slug", F.col("chunk_id").alias("evidence_id"), "score", F.col("group_rnk").alias("rnk"))
    records = constraints.withColumn("__there", F.lit(True))
    pairs = found.join(profiles, "query_id", "left").join(records, "slug", "left").withColumn("c_missing", F.col("__there").isNull()).drop("__there")
    if "lang" in queries.columns:
        pairs = pairs.join(queries.select("query_id", "lang"), "query_id", "left")
    out = answers(with_meanings(pairs, meanings), chunks, rules, explanations, schemes)
    if named is None or known is None:
        return out
    unknown = notices(named, known).groupBy("query_id").agg(F.array_sort(F.collect_list("name")).alias("unknown_names"))
    return out.join(unknown, "query_id", "left").withColumn("unknown_names", F.coalesce("unknown_names", F.array().cast("array<string>")))


def with_meanings(pairs: DataFrame, meanings: DataFrame | None) -> DataFrame:
    """`pairs` with the similarity of the nearest listed occupation and the number of facts that touch a residual."""
    if meanings is None:
        return pairs
    have = set(pairs.columns)
    if {"p_occupation", "c_occupation"} <= have:
        near = matcher.occupation_similarity(pairs, meanings, ("query_id", "slug"))
        pairs = pairs.drop("p_occupation_similarity").join(near.select("query_id", "slug", "p_occupation_similarity"), ["query_id", "slug"], "left")
    if {"p_facts", "c_residuals"} <= have:
        facts = pairs.select("query_id", F.explode("p_facts").alias("fact")).distinct()
        residuals = pairs.select("query_id", "slug", F.explode("c_residuals").alias("residual"))
        touched = matcher.residual_touches(facts, residuals, meanings).groupBy("query_id", "slug").agg(F.count(F.lit(1)).cast("int").alias("c_touches"))
        pairs = pairs.drop("c_touches").join(touched, ["query_id", "slug"], "left")
    return pairs


def answers(pairs: DataFrame, chunks: DataFrame, rules: tuple[str, ...] = RULES, explanations: DataFrame | None = None, schemes: DataFrame | None = None) -> DataFrame:
    """Everything after retrieval for (query_id, slug, rnk, p_*, c_*) rows: verdicts, reasons, caveats, downgrades, flags, question, order."""
    rows = matcher.evaluate(pairs, rules)
    lang = F.col("lang") if "lang" in pairs.columns else F.lit("en")
    if {"section", "raw_text"} <= set(chunks.columns):
        clause = first_clause(chunks.withColumn("chunk_id", F.col("chunk_id").cast("string"))).select("slug", F.col("raw_text").alias("__clause"))
        rows = rows.join(clause, "slug", "left")
    else:
        rows = rows.withColumn("__clause", F.lit(None).cast("string"))
    if schemes is not None:
        own = schemes.select("slug", F.col("eligibility_text").alias("__source"), document_list(F.col("documents_text")).alias("documents"))
        rows = rows.join(own, "slug", "left")
    else:
        rows = rows.withColumns({"__source": F.lit(""), "documents": F.array().cast("array<string>")})
    unchecked = (F.size("own_conditions") > 0) | (F.size("unverified") > 0)
    rows = rows.withColumns({"template": fallback_reason(F.col("conditions"), F.col("status"), lang, unchecked, F.col("__clause")), "matcher_reason": F.col("reason")})
    rows = with_explanations(rows, explanations) if explanations is not None else rows.withColumn("reason", F.col("template"))
    values = {key: F.col(f"p_{key}") for key in NUMERIC_KINDS.values()}
    sure = {key: F.col(f"p_{key}_conf") if f"p_{key}_conf" in pairs.columns else F.lit("medium") for key in NUMERIC_KINDS.values()}
    rows = finalize(rows, values, sure, F.col("__source"), lang)
    asked = matcher.clarifying_field(rows).select("query_id", F.col("field").alias("ask_field"))
    rows = rows.join(asked, "query_id", "left").withColumn("question", question(F.col("ask_field")))
    split = without_dependent_note(F.col("unverified"))
    rows = rows.withColumns({"requires_dependent_note": split["requires_dependent"], "unverified": split["unverified"]})
    rows = rows.withColumns({"unverified_verbatim": F.transform("unverified", lambda x: is_grounded(x, F.col("__source"))), "caveats_verbatim": F.transform("caveats", lambda x: is_grounded(x, F.col("__source")))})
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*display_order(rows, "final_status")))
    return rows.withColumn("place", place).drop("__source", "__clause")
