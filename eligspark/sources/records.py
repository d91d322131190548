"""Readers and writers of records: tolerant JSON, JSON lines, CSV, pages, shards, manifests, incremental sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_ROWS = 512


def without_redownloads(names: DataFrame, name: str = "name") -> DataFrame:
    """Drops "<stem>(n)" copies whose base stem is there; a copy without its base stays."""
    rows = names.withColumn("__base", F.regexp_extract(name, r"^(.*?)\s?\((\d+)\)$", 1))
    bases = names.select(F.col(name).alias("__base")).distinct()
    copies = rows.filter("__base <> ''").join(bases, "__base", "left_semi").select(name)
    return rows.drop("__base").join(copies, name, "left_anti")


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*") -> DataFrame:
    """(path, page, text) from binary files by an injected extractor."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, k, t) for p, c in zip(pdf["path"], pdf["content"]) for k, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def read_record_folder(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object per file; unreadable files and those without the required fields are left out."""
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    good = rows.filter(F.col("__bad").isNull())
    for f in required:
        good = good.filter(F.col(f).isNotNull())
    return good.drop("__bad")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines count as nothing."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as `write_report` writes it: quotes are doubled, fields may span lines and keep their spaces."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_labelled_csv(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A CSV with a header; rows with a blank label are left out."""
    return read_csv(spark, path).filter(F.trim(F.coalesce(F.col(label), F.lit(""))) != "")


def vectors_for(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The vectors of the ids; raises ValueError unless every id has exactly one."""
    joined = ids.select(key).join(vectors, key)
    if joined.count() != ids.count() or joined.select(key).distinct().count() != ids.count():
        raise ValueError("ids and vectors don't match one to one")
    return joined


def content_digest(spark: SparkSession, path: str) -> str:
    """sha-256 over the sorted digests of the files under `path`: the same content gives the same digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.sha2("content", 256).alias("h"))
    parts = [r["h"] for r in files.orderBy("h").toLocalIterator()]
    import hashlib

    return hashlib.sha256("".join(parts).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    """A one-row manifest beside an index."""
    spark.createDataFrame([{k: str(v) for k, v in values.items()}]).coalesce(1).write.mode("overwrite").json(path)


def guarded(spark: SparkSession, index_path: str, manifest_path: str, source_path: str) -> DataFrame:
    """An index table, refused with ValueError if its source has changed since its manifest was written."""
    stated = spark.read.json(manifest_path).first()["source_sha256"]
    if stated != content_digest(spark, source_path):
        raise ValueError("the index was built from other source content")
    return spark.read.parquet(index_path)


def keys_from_environment(prefix: str, environment: dict[str, str], most: int = 9) -> list[str]:
    """The values of PREFIX, PREFIX_2 .. PREFIX_9; gaps don't end the list."""
    names = [prefix, *(f"{prefix}_{k}" for k in range(2, most + 1))]
    return [environment[n] for n in names if environment.get(n, "").strip()]


def inventory(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """(key, status): missing on the right, extra there, of another size, or the same."""
    a, b = left.select(key, F.col(size).alias("__a")), right.select(key, F.col(size).alias("__b"))
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("__a") != F.col("__b"), "wrong_size").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def pending(candidates: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Candidates that aren't done; all of them if forced."""
    return candidates if force else candidates.join(done.select(key).distinct(), key, "left_anti")


def write_records(df: DataFrame, path: str, partition: str | None = None) -> None:
    """JSON records; the commit protocol makes files visible only when their task has committed."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A bounded report as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_blind_sheet(df: DataFrame, path: str, text: str, labels: tuple[str, ...], width: int = 400) -> None:
    """Rows for blind labelling: text cut to `width`, empty label columns."""
    write_report(df.withColumn(text, F.left(F.coalesce(text, F.lit("")), F.lit(width))).withColumns({c: F.lit("") for c in labels}), path)


def append_cache(df: DataFrame, path: str) -> None:
    """Appends cache entries (key, seq, result)."""
    df.write.mode("append").parquet(path)


def last_written(cache: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last entry of each key, by one aggregation."""
    rest = [c for c in cache.columns if c != key]
    best = cache.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__v"))
    return best.select(key, *[F.col(f"__v.{c}").alias(c) for c in rest])


def write_missing_shards(rows: DataFrame, path: str, position: str, compute: Callable[[DataFrame], DataFrame], fingerprint: str, fresh: bool = False) -> None:
    """Rows in shards of SHARD_ROWS by position; only shards that aren't there are computed.

    A different fingerprint raises ValueError unless `fresh`, which starts over.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    data, manifest = f"{path}/shards", f"{path}/manifest"
    if fresh and fs.exists(folder):
        fs.delete(folder, True)
    sharded = rows.withColumn("shard", F.floor(F.col(position) / SHARD_ROWS).cast("int"))
    if fs.exists(jvm.org.apache.hadoop.fs.Path(manifest)):
        if spark.read.json(manifest).first()["fingerprint"] != fingerprint:
            raise ValueError("shards of another fingerprint are there; start over with fresh")
        if fs.exists(jvm.org.apache.hadoop.fs.Path(data)):
            sharded = sharded.join(spark.read.parquet(data).select("shard").distinct(), "shard", "left_anti")
    else:
        write_manifest(spark, manifest, {"fingerprint": fingerprint})
    compute(sharded).write.mode("append").partitionBy("shard").parquet(data)


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, path and base (without query and fragment) of an address."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    return {"scheme": F.regexp_extract(base, r"^([a-z]+)://", 1), "host": F.regexp_extract(base, r"^[a-z]+://([^/:]+)", 1), "path": F.regexp_extract(base, r"^[a-z]+://[^/]*(/.*)?$", 1), "base": base}
