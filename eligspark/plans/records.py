"""Queries of sources, sinks, samples, reports and the calls of text models: whole tables go through a sink and come back through a source."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from eligspark.operators import chunking
from eligspark.operators import corpus as C
from eligspark.operators import evaluation as E
from eligspark.operators import providers as L
from eligspark.operators import sampling as R
from eligspark.plans.functions import chosen, chosen_sql
from eligspark.schemas import SCHEME, over_null_template
from eligspark.sources import records as S
from eligspark.storage import scratch_path
from eligspark.tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def json_round_trip(spark, sf_dir):
    """Records as JSON, partitioned, and read again."""
    path = scratch_path(spark, "records")
    S.write_records(parts(spark, sf_dir), path, partition="p_size")
    back = S.read_json_lines(spark, path, Y.StructType.fromDDL("p_partkey long, p_name string, p_retailprice double, p_size int"))
    return back.select("p_partkey", "p_name", "p_retailprice", "p_size")


def record_folder(spark, sf_dir):
    """Nations as one file each; every fourth lacks its name and every fifth can't be read."""
    path = scratch_path(spark, "folder")
    k = F.col("n_nationkey")
    named = F.to_json(F.struct(k.alias("slug"), F.when(k % 4 > 0, F.col("n_name")).alias("name")))
    text = F.when(k % 5 == 0, F.concat(F.lit("{broken "), named)).otherwise(F.concat(F.lit(" \n"), named, F.lit("\n")))
    table(spark, sf_dir, "nation").select(text.alias("value"), k.alias("k")).repartition(25, "k").write.partitionBy("k").text(path)
    files = S.read_record_folder(spark, f"{path}/*", Y.StructType.fromDDL("slug long, name string"), required=("name",))
    return files.select("slug", "name")


def labelled_sheet(spark, sf_dir):
    """A blind sheet whose labels are filled in for two of three parts, read as CSV."""
    path, filled = scratch_path(spark, "sheet"), scratch_path(spark, "sheet")
    S.write_blind_sheet(parts(spark, sf_dir).select("p_partkey", F.concat("p_name", F.lit(', "quoted"\nline')).alias("text")), path, "text", ("label",), 20)
    sheet = S.read_csv(spark, path)
    S.write_report(sheet.withColumn("label", F.when(F.col("p_partkey").cast("long") % 3 > 0, "good").otherwise(" ")), filled)
    return S.read_labelled_csv(spark, filled, "label").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.md5("text").alias("text_md5"), "label")


def cache_read_through(spark, sf_dir):
    """Entries are appended twice, the last one counts, and what isn't there is pending."""
    path = scratch_path(spark, "cache")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("result"))
    S.append_cache(events.filter("key % 3 = 0"), path)
    S.append_cache(events.filter("key % 3 = 1"), path)
    last = S.last_written(spark.read.parquet(path))
    left = S.pending(events.select("key").distinct(), last, "key").select("key", F.lit(None).cast("long").alias("seq"), F.lit("pending").alias("result"))
    return last.select("key", "seq", "result").unionByName(left)


def resumed_shards(spark, sf_dir):
    """Shards by position; the second run writes only what the first hasn't."""
    path = scratch_path(spark, "shards")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("pos"))
    first = rows.filter("floor(pos / 512) % 2 = 0")
    S.write_missing_shards(first, path, "pos", lambda df: df.withColumn("run", F.lit(1)), "v1")
    S.write_missing_shards(rows, path, "pos", lambda df: df.withColumn("run", F.lit(2)), "v1")
    return spark.read.parquet(f"{path}/shards").groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))


def redownloads(spark, sf_dir):
    """S01: "name (2)" goes where "name" is there."""
    k = F.col("page_id")
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), F.floor(k / 3).cast("string"), F.when(k % 3 == 1, " (1)").when(k % 3 == 2, "(2)").otherwise(F.when(k % 6 == 0, "").otherwise("b"))).alias("name"))
    return S.without_redownloads(names).select("page_id", "name")


def matched_vectors(spark, sf_dir):
    """Vectors of ids that match one to one."""
    vectors = table(spark, sf_dir, "embeddings")
    return S.vectors_for(vectors.select("vec_id"), vectors, "vec_id").select("vec_id", "label")


def null_templates(spark, sf_dir):
    """Parts over the scheme's template: fields that a table lacks are null, others cast."""
    rows = over_null_template(parts(spark, sf_dir).select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("scheme_name"), F.lit("2024-03-28").alias("last_updated"), "p_brand"), SCHEME)
    return rows.select("slug", "scheme_name", F.col("last_updated").cast("string").alias("last_updated"), F.col("state").isNull().alias("no_state"), F.lit(len(rows.columns)).cast("long").alias("n_fields"))


def scheme_chunks(spark, sf_dir):
    """Parts as schemes: overview and clause chunks in their fixed order, and what a classifier reads."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("The applicant must own a "), F.col("p_type"), F.lit(" of the size stated here. Exclusions: Members of "), F.col("p_brand"), F.lit(" are not admitted to the scheme at all."))
    rows = parts(spark, sf_dir).select(k.cast("string").alias("slug"), F.concat(F.lit("Scheme "), k.cast("string")).alias("scheme_name"), F.lit("A  description. ").alias("description"), F.when(k % 2 == 0, "Some benefits").alias("benefits_text"), F.when(k % 3 > 0, text).alias("eligibility_text"))
    schemes = over_null_template(rows, SCHEME)
    made = chunking.chunks(schemes, schemes.select("slug", F.lit("c").alias("category")))
    ordered = made.withColumn("pos", F.row_number().over(W.partitionBy("slug").orderBy(*chunking.in_chunk_order(made))).cast("long"))
    read = chunking.classifier_text(schemes).withColumnRenamed("text", "read")
    return ordered.join(read, "slug").select("chunk_id", "section", "text", "pos", "read")


def class_shares(spark, sf_dir):
    """A18."""
    return C.class_distribution(table(spark, sf_dir, "embeddings"), "label", 55)


def flags_and_shortest(spark, sf_dir):
    """How often each flag is set, and the ten shortest texts."""
    rows = docs(spark, sf_dir).select("doc_id", "text", F.array_compact(F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("lang") != "en", "foreign"))).alias("flags"))
    short = C.shortest(rows, "doc_id", "text")
    return C.flag_counts(rows, "flags").select("flag", "n").unionByName(short.select(F.col("doc_id").cast("string").alias("flag"), F.col("len").cast("long").alias("n")))


def texts_in_records(spark, sf_dir):
    """In how many sources each line occurs, each source counted once for a line."""
    rows = docs(spark, sf_dir).select("source", F.split("text", "\n").alias("lines"))
    return C.records_with(rows, "source", "lines").groupBy("n_records").agg(F.count(F.lit(1)).alias("n"))


def fold_statistics(spark, sf_dir):
    """Mean and population deviation over folds."""
    rows = R.folds(table(spark, sf_dir, "labels"), "quality", "doc_id").groupBy("quality", "fold").agg(F.avg("doc_id").alias("score"))
    return E.over_folds(rows, "quality", "score")


def category_words(spark, sf_dir):
    """How often a part's name starts a word like its own type's words, or like any of three."""
    return C.literal_overlap(parts(spark, sf_dir).select(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))).alias("t"), "p_type"), "t", "p_type", ["steel plated", "copper"])


def spread_sample(spark, sf_dir):
    """Twenty documents spread over the lengths, and ten at random."""
    rows = docs(spark, sf_dir).select("doc_id", "n_chars")
    spread = R.spread_by_length(rows, "n_chars", "doc_id", 20).select("doc_id", F.lit("spread").alias("kind"))
    return spread.unionByName(R.random_sample(rows, "doc_id", 10).select("doc_id", F.lit("random").alias("kind")))


def least_per_level(spark, sf_dir):
    """A sample of ten of each stratum with at least thirty rows of a rare level: how many of each level and stratum."""
    pool = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 4).alias("stratum"), F.when(F.col("doc_id") % 11 == 0, "central").otherwise("state").alias("level"))
    order = W.partitionBy("stratum").orderBy("doc_id")
    sample = pool.withColumn("k", F.row_number().over(order)).filter("k <= 10").drop("k")
    return R.with_least(sample, pool, "level", "doc_id", "stratum", {"central": 12}).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "central").alias("n_central"))


def gold_split(spark, sf_dir):
    """gold rows of one split, without those that are never scored."""
    k = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(k % 3 == 0, "dev").otherwise("test").alias("split"), F.when(k % 5 == 0, k % 2 == 0).alias("skip_scoring"))
    return E.gold_rows(rows, "dev").select("item_id").withColumn("split", F.lit("dev")).unionByName(E.gold_rows(rows, "test", final=True).select("item_id", F.lit("test").alias("split")))


def labels_against_predictions(spark, sf_dir):
    """Hand labels against predictions, with what either side lacks."""
    human = docs(spark, sf_dir).select(F.col("doc_id").alias("slug"), F.when(F.col("lang") == "en", "1").otherwise("0").alias("label"))
    predicted = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 9 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("slug"), F.col("quality").cast("string").alias("predicted"))
    return E.matched_labels(human, predicted, "slug").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def prompts_in_batches(spark, sf_dir):
    """Numbered prompts of ten items, whole batches in the order of the keys."""
    return L.batched_prompts(parts(spark, sf_dir).select("p_partkey", "p_name"), "p_partkey", "p_name", "Items:").select("batch", F.array_join("keys", ",").alias("keys"), F.md5("prompt").alias("prompt_md5"))


def calls_with_retries(spark, sf_dir):
    """Calls over what is pending; a third of the keys answer at once, a third when asked again, the others never."""

    def call(left):
        attempt = F.coalesce(F.col("asked"), F.lit(0))
        return left.select("key", F.lit("reply").alias("reply"), F.when((F.col("key") % 3 == 0) | ((F.col("key") % 3 == 1) & (attempt >= 0) & (F.col("again") == 1)), "ok").otherwise("minute").alias("status"))

    items = parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.lit(0).alias("asked"), (F.col("p_partkey") % 2).alias("again"))
    return L.with_retries(items, call, 2).select("key", "status", F.col("attempt").cast("long").alias("attempt"))


def offline_replies(spark, sf_dir):
    """Without a provider every call takes the degraded path."""
    out = L.generate(parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.col("p_name").alias("prompt")))
    return out.select("key", F.coalesce("reply", F.lit("template")).alias("text"), "status")


PROFILES = (("I am 34 years old", 34), ("my father is 70", 70), ("I am 34 years old", 200), ("I earn well", 20))
WRONG = ("", "age: not said of oneself", "age: out of bounds; age: evidence is not in the text", "age: evidence is not in the text")
SPANS = ("I am 34", "father is 70", "I am 200", "I am twenty")
TRANSLATED = (("मैं 34 साल का नहीं हूँ", "I am not 34 years old", ""), ("5 acres", "6 acres", "number added; number lost"), ("I do not own land", "I own land", "negation lost"), ("2 cows", "2 cows", ""), ("One. Two. Three. Four.", "One and all in Kerala", "sentences merged; place added: Kerala"))


def profile_checks(spark, sf_dir):
    """Field errors, translation errors, and whether a profile says next to nothing."""
    k = F.col("p_partkey")
    text, age, span = chosen(k, tuple(p[0] for p in PROFILES)), chosen(k, tuple(p[1] for p in PROFILES)).cast("int"), chosen(k, SPANS)
    errors = L.profile_errors({"age": age}, {"age": span}, text)
    moved = L.translation_errors(chosen(k, tuple(t[0] for t in TRANSLATED)), chosen(k, tuple(t[1] for t in TRANSLATED)), ("Goa", "Kerala"), F.lit("Goa"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(errors, "; ").alias("errors"), F.array_join(moved, "; ").alias("translation"), L.is_nearly_empty([F.when(k % 2 == 0, k), F.when(k % 3 == 0, k), F.lit(None)]).alias("nearly_empty"))


def covered_residuals(spark, sf_dir):
    """Residuals that a migrated field restates go, others stay."""
    own = F.array(F.lit("must be registered with the board"), F.concat(F.lit("must own a "), F.col("p_name")))
    again = F.array(F.when(F.col("p_partkey") % 2 == 0, "the person must be registered with the welfare board").otherwise("registered"))
    return parts(spark, sf_dir).select("p_partkey", F.size(L.without_covered(own, again)).cast("long").alias("n_left"))


def group_fold_sizes(spark, sf_dir):
    """R07, ML06, ML09: folds that keep sources whole: groups and rows of each."""
    rows = R.group_folds(docs(spark, sf_dir), "source")
    return rows.groupBy("fold").agg(F.count_distinct("source").alias("n_groups"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "json_round_trip": json_round_trip, "record_folder": record_folder, "labelled_sheet": labelled_sheet, "cache_read_through": cache_read_through, "resumed_shards": resumed_shards, "redownloads": redownloads,
    "matched_vectors": matched_vectors, "null_templates": null_templates, "scheme_chunks": scheme_chunks, "class_shares": class_shares, "flags_and_shortest": flags_and_shortest, "texts_in_records": texts_in_records,
    "fold_statistics": fold_statistics, "category_words": category_words, "spread_sample": spread_sample, "least_per_level": least_per_level, "gold_split": gold_split, "labels_against_predictions": labels_against_predictions,
    "prompts_in_batches": prompts_in_batches, "calls_with_retries": calls_with_retries, "offline_replies": offline_replies, "profile_checks": profile_checks, "covered_residuals": covered_residuals, "group_fold_sizes": group_fold_sizes,
}
WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) >= 4)"
STEMS = "list_transform(" + WORDS + ", lambda w: left(w, 5))"
TITLED = "concat_ws(' ', p_name, case when p_partkey % 3 = 0 then p_type end)"
STARTS = "len(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: len(list_filter({1}, lambda s: starts_with(w, s))) > 0)) > 0"
ORACLES = {
    "json_round_trip": "select p_partkey, p_name, p_retailprice, p_size from part",
    "record_folder": "select cast(n_nationkey as bigint) as slug, n_name as name from nation where n_nationkey % 4 > 0 and n_nationkey % 5 > 0",
    "labelled_sheet": "select p_partkey, md5(left(p_name || ', \"quoted\"' || chr(10) || 'line', 20)) as text_md5, 'good' as label from part where p_partkey % 3 > 0",
    "cache_read_through": "select user_id as key, case when user_id % 3 < 2 then max(event_id) end as seq, case when user_id % 3 < 2 then arg_max(event_type, event_id) else 'pending' end as result from events group by user_id",
    "resumed_shards": "select cast(floor(o_orderkey / 512) as int) as shard, case when floor(o_orderkey / 512) % 2 = 0 then 1 else 2 end as run, count(*) as n from orders group by all",
    "redownloads": """with n as (select page_id, 'page' || (page_id // 3) || case page_id % 3 when 1 then ' (1)' when 2 then '(2)' else case when page_id % 6 = 0 then '' else 'b' end end as name from pages)
select page_id, name from n where not regexp_matches(name, '\\(\\d+\\)$') or regexp_replace(name, '\\s?\\(\\d+\\)$', '') not in (select name from n)""",
    "matched_vectors": "select vec_id, label from embeddings",
    "null_templates": "select cast(p_partkey as varchar) as slug, p_name as scheme_name, '2024-03-28' as last_updated, true as no_state, cast(14 as bigint) as n_fields from part",
    "scheme_chunks": """with s as (select cast(p_partkey as varchar) as slug, p_partkey as k, 'Scheme ' || p_partkey as name, p_type, p_brand, case when p_partkey % 2 = 0 then ' Some benefits' else '' end as more from part),
c as (select slug, name, more, slug || '::overview' as chunk_id, 'overview' as section, name || '. A description.' || more as text, 1 as pos from s
  union all select slug, name, more, slug || '::eligibility::000', 'eligibility', name || ' — eligibility: The applicant must own a ' || p_type || ' of the size stated here.', 2 from s where k % 3 > 0
  union all select slug, name, more, slug || '::exclusions::001', 'exclusions', name || ' — exclusions: Members of ' || p_brand || ' are not admitted to the scheme at all.', 3 from s where k % 3 > 0)
select chunk_id, section, text, cast(pos as bigint) as pos, name || '. A description' || case when more = '' then '.' else '.' || more || '.' end as read from c""",
    "class_shares": "select label, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as percent, count(*) < 55 as small from embeddings group by label",
    "flags_and_shortest": """select 'short' as flag, count(*) as n from documents where n_chars < 500 having count(*) > 0 union all select 'foreign', count(*) from documents where lang <> 'en' having count(*) > 0
union all select cast(doc_id as varchar), length(text) from (select * from documents order by length(text) nulls first, doc_id limit 10)""",
    "texts_in_records": "with l as (select distinct source, unnest(string_split(text, chr(10))) as line from documents), g as (select line, count(*) as n_records from l where trim(coalesce(line, '')) <> '' group by line) select n_records, count(*) as n from g group by n_records",
    "fold_statistics": "with fo as (select *, (row_number() over (partition by quality order by md5('42' || doc_id), doc_id) - 1) % 5 as fold from labels), s as (select quality, fold, avg(doc_id) as score from fo group by all) select quality, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from s group by quality",
    "category_words": f"select round(avg(case when {STARTS.format(TITLED, STEMS.format('p_type'))} then 1.0::double else 0 end), 6) as own, round(avg(case when {STARTS.format(TITLED, "['steel', 'plate', 'coppe']")} then 1.0::double else 0 end), 6) as \"any\" from part",
    "spread_sample": """with r as (select doc_id, row_number() over (order by n_chars nulls first, doc_id) as k, count(*) over () as n from documents), w as (select cast(floor(i * (select max(n) from r) / 20.0::double) as bigint) + 1 as k from unnest(range(20)) as u(i))
select doc_id, 'spread' as kind from r where k in (select k from w) union all select doc_id, 'random' from (select doc_id from documents order by md5('42' || doc_id), doc_id limit 10)""",
    "gold_split": """with g as (select item_id, case when item_id % 3 = 0 then 'dev' else 'test' end as split, case when item_id % 5 = 0 then item_id % 2 = 0 end as skip from benchmark) select item_id, split from g where not coalesce(skip, false)""",
    "labels_against_predictions": """with h as (select doc_id as slug, case when lang = 'en' then '1' else '0' end as label from documents), p as (select case when doc_id % 9 = 0 then -doc_id - 1 else doc_id end as slug, cast(quality as varchar) as predicted from labels)
select case when p.slug is null then 'no prediction' when h.slug is null then 'no label' when label = predicted then 'agree' else 'differ' end as kind, count(*) as n from h full join p using (slug) group by kind""",
    "prompts_in_batches": """with r as (select p_partkey, p_name, row_number() over (order by p_partkey) - 1 as k from part)
select cast(k // 10 as int) as batch, string_agg(p_partkey, ',' order by k) as keys, md5('Items:' || chr(10) || string_agg((k % 10 + 1) || '. ' || p_name, chr(10) order by k)) as prompt_md5 from r group by k // 10""",
    "calls_with_retries": "select p_partkey as key, case when p_partkey % 3 = 0 or (p_partkey % 3 = 1 and p_partkey % 2 = 1) then 'ok' else 'minute' end as status, cast(case when p_partkey % 3 = 0 or (p_partkey % 3 = 1 and p_partkey % 2 = 1) then 1 else 2 end as bigint) as attempt from part",
    "offline_replies": "select p_partkey as key, 'template' as text, 'no provider' as status from part",
    "profile_checks": f"select p_partkey, {chosen_sql('p_partkey', WRONG)} as errors, {chosen_sql('p_partkey', tuple(t[2] for t in TRANSLATED))} as translation, not (p_partkey % 6 = 0) as nearly_empty from part",
    "covered_residuals": "select p_partkey, cast(case when p_partkey % 2 = 0 then 1 else 2 end as bigint) as n_left from part",
    "group_fold_sizes": """with g as (select source, count(*) as n from documents group by source), p as (select source, n, row_number() over (order by n desc, source) - 1 as k from g)
select cast(case when k // 5 % 2 = 0 then k % 5 else 4 - k % 5 end as int) as fold, count(*) as n_groups, cast(sum(n) as bigint) as n from p group by fold""",
}
