"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eligspark.llm.alignment import align
from eligspark.llm.bwt_dedup import remove_repeats
from eligspark.llm.decontaminate import decontaminate, decontamination_sql
from eligspark.llm.jaccard import jaccard_components, jaccard_sql
from eligspark.llm.kmeans import cluster_vectors, clustering_sql
from eligspark.llm.lm import score_documents
from eligspark.llm.mixing import mixing_rates
from eligspark.llm.quality import judge, labelled_statistics, learn_rules
from eligspark.llm.secrets import scan_secrets
from eligspark.llm.sharding import shard_documents
from eligspark.llm.tokens import count_tokens
from eligspark.llm.toxicity import score_toxicity
from eligspark.llm.warc import archive_round_trip, archive_sql
from eligspark.tables import table

#: The tokenizer file of the token counts, by its name among the public tokenizers.
TOKENIZER = "word_bpe_49k.json"
#: Tokenizers A and B of the alignment.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_definition(name: str = TOKENIZER) -> str:
    """Content of a public tokenizer file (bounded: about 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def tokenizer_model(name: str) -> bytes:
    """Content of a public tokenizer model (bounded: about 1 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_definition())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = learn_rules(labelled_statistics(documents, table(spark, sf_dir, "labels")))
    return judge(documents, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return clusters.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_definition(ALIGNED[0]), tokenizer_model(ALIGNED[1]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_lm_scores": op7_lm_scores,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_toxicity": op11_toxicity,
    "op12_clusters": op12_clusters,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": decontamination_sql(),
    "op4_jaccard_join": jaccard_sql(size=4, percent=85),
    "op8_warc": archive_sql(least_bytes=0),
    "op12_clusters": clustering_sql(),
}
