"""Strata, allocations, samples and folds, deterministic by hashed order instead of a seeded shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eligspark.storage import materialize


def rlike(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def bucket(tags: Column, rules: list[tuple[str, tuple[str, ...]]], other: str = "Other") -> Column:
    """The first rule one of whose keywords a tag contains (lower-cased)."""
    lower = F.transform(tags, lambda t: F.lower(t))
    out = None
    for name, words in rules:
        pattern = "|".join(map(re.escape, words))
        test = F.exists(lower, rlike(pattern))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(other) if out is None else out.otherwise(other)


def allocate(n: int, sizes: dict[str, int], order: list[str] | None = None) -> dict[str, int]:
    """N places spread evenly over strata, capped by their sizes, what is short going to those with room, in order."""
    order = order or sorted(sizes)
    given = dict.fromkeys(order, 0)
    left = min(n, sum(sizes.values()))
    while left:
        open_ = [s for s in order if given[s] < sizes[s]]
        share, extra = divmod(left, len(open_))
        for k, s in enumerate(open_):
            more = min(share + (k < extra), sizes[s] - given[s])
            given[s] += more
            left -= more
    return given


def hash_order(seed: str, key: Column) -> Column:
    """The order in which a stratum is drawn: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def hashed_rank(df: DataFrame, by: str, key: str, seed: str, name: str) -> DataFrame:
    """`df` with the place (from 1) of each row in its group's hashed order (ties by key).

    A group is ranked in 4,096 slices of its hashes, each of which starts after the rows of those before it, so that a
    group that holds most of the table is no single task.
    """
    rows = df.withColumns({"__h": hash_order(seed, F.col(key)), "__s": F.left(hash_order(seed, F.col(key)), F.lit(3))})
    counts = rows.groupBy(by, "__s").agg(F.count(F.lit(1)).alias("__c"))
    before = W.partitionBy(by).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(by, "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    placed = rows.join(offsets.withColumnsRenamed({by: "__by", "__s": "__t"}), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__s") == F.col("__t")))
    within = W.partitionBy(by, "__s").orderBy("__h", key)
    return placed.withColumn(name, (F.col("__o") + F.row_number().over(within)).cast("long")).drop("__h", "__s", "__c", "__o", "__by", "__t")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """`df` with each row's place (from 1) in the order, by ranges that are ranked on their own and start after those before them."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))  # one row for each partition
    offsets = counts.select("__p", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    within = W.partitionBy("__p").orderBy(*order)
    return dealt.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__o") + F.row_number().over(within)).cast("long")).drop("__p", "__o")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """Rows of an even allocation over the strata (a bounded table of counts), drawn in hashed order."""
    sizes = {str(r[stratum]): r["n"] for r in df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    given = allocate(n, sizes)
    places = F.coalesce(F.create_map(*[F.lit(x) for p in given.items() for x in p])[F.col(stratum).cast("string")], F.lit(0)) if given else F.lit(0)
    return hashed_rank(df, stratum, key, seed, "pick").filter(F.col("pick") <= places)


def with_least(sample: DataFrame, pool: DataFrame, level: str, key: str, stratum: str, least: dict[str, int], seed: str = "42") -> DataFrame:
    """Swaps rows of other levels for pool rows of the same stratum until each level has its least number."""
    out = sample.select(*pool.columns)
    for name, need in sorted(least.items()):
        short = need - out.filter(F.col(level) == name).count()
        if short <= 0:
            continue
        order = W.partitionBy(stratum).orderBy(hash_order(seed, F.col(key)), key)
        gone = out.filter(F.col(level) != name).withColumn("__n", F.row_number().over(order))
        new = pool.filter(F.col(level) == name).join(out.select(key), key, "left_anti").select(*pool.columns).withColumn("__n", F.row_number().over(order))
        swaps = gone.select(F.col(key).alias("__old"), stratum, "__n").join(new, [stratum, "__n"]).orderBy("__n", stratum).limit(short)
        out = out.join(swaps.select(F.col("__old").alias(key)), key, "left_anti").select(*pool.columns).union(swaps.select(*pool.columns))
    return out


def largest_remainder(df: DataFrame, by: str, total: int) -> DataFrame:
    """(by, n, places): places in proportion to n, whole parts first, then the largest remainders (ties by name)."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    exact = F.lit(total) * F.col("n") / F.sum("n").over(W.partitionBy())
    rows = counts.withColumn("whole", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    rows = rows.withColumn("k", F.row_number().over(W.orderBy(F.desc("rest"), by))).withColumn("left", F.lit(total) - F.sum("whole").over(W.partitionBy()))
    return rows.select(by, "n", (F.col("whole") + (F.col("k") <= F.col("left")).cast("long")).alias("places"))


def dev_test_split(df: DataFrame, by: str, key: str, dev: int, seed: str = "20260922") -> DataFrame:
    """`df` with split dev or test: each type's places by largest remainder, in hashed order."""
    places = largest_remainder(df, by, dev).select(by, "places")
    rows = hashed_rank(df, by, key, seed, "__k").join(F.broadcast(places), by)
    return rows.withColumn("split", F.when(F.col("__k") <= F.col("places"), "dev").otherwise("test")).drop("__k", "places")


def language_swaps(split: DataFrame, key: str, language: str, positive: Column, common: str = "en", seed: str = "20260922") -> DataFrame:
    """`split` with a positive dev row in every language that has a positive row at all.

    A language without one takes its first positive test row in hashed order; in its place a positive dev row of the
    `common` language goes to test.  Both sides are numbered (languages by name, rows in hashed order) and meet on the
    number: one pass for all languages.  Languages beyond the rows of the common language stay without; null languages
    and keys don't take part; the number of languages is bounded, that of rows isn't: rows are ranked by a limit.
    """
    rows = split.filter(positive & F.col(key).isNotNull() & F.col(language).isNotNull()).select(F.col(key).alias("__key"), F.col(language).alias("__lang"), (F.col("split") == "dev").alias("__dev"))
    hashed = hash_order(seed, F.col("__key"))
    lacking = rows.groupBy("__lang").agg(F.max("__dev").alias("has"), F.min(F.when(~F.col("__dev"), F.struct(hashed.alias("h"), F.col("__key").alias("k")))).alias("first"))
    lacking = materialize(lacking.filter("not has").select("__lang", F.col("first.k").alias("incoming")).withColumn("__n", F.row_number().over(W.orderBy("__lang"))), "swaps")  # one row a language
    outgoing = rows.filter(F.col("__dev") & (F.col("__lang") == common)).orderBy(hashed, "__key").limit(max(lacking.count(), 1))
    outgoing = outgoing.withColumn("__n", F.row_number().over(W.orderBy(hashed, "__key"))).select("__n", F.col("__key").alias("outgoing"))
    swaps = lacking.join(outgoing, "__n").select("incoming", "outgoing")
    moved = swaps.select(F.explode(F.array(F.struct(F.col("incoming").alias("k"), F.lit("dev").alias("s")), F.struct(F.col("outgoing").alias("k"), F.lit("test").alias("s")))).alias("x")).select(F.col("x.k").alias("__moved"), F.col("x.s").alias("__to"))
    out = split.join(F.broadcast(moved), F.col(key) == F.col("__moved"), "left")
    return out.withColumn("split", F.coalesce("__to", "split")).drop("__moved", "__to")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: str = "42") -> DataFrame:
    """Stratified folds: within a class in hashed order, dealt round."""
    return hashed_rank(df, label, key, seed, "__k").withColumn("fold", ((F.col("__k") - 1) % k).cast("int")).drop("__k")


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Folds that keep groups whole: groups by size (then name) are dealt in a snake over the folds."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    place = F.row_number().over(W.orderBy(F.desc("__size"), group)) - 1
    turn, at = F.floor(place / k), place % k
    dealt = sizes.select(group, F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))
    return df.join(dealt, group)


def fold_support(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Per class the smallest and largest fold and whether it is balanced (no empty fold, each within one of n / k)."""
    counts = df.groupBy(label).pivot("fold", list(range(k))).agg(F.count(F.lit(1))).na.fill(0)
    parts = [F.col(str(f)) for f in range(k)]
    total = sum(parts[1:], parts[0])
    near = F.lit(True)
    for p in parts:
        near = near & (F.abs(p - total / k) <= 1)
    return counts.select(label, total.alias("n"), F.least(*parts).alias("least"), F.greatest(*parts).alias("most"), (near & (F.least(*parts) > 0)).alias("balanced"))


def sampling_weights(population: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """Per stratum w = (N_h / N) / (n_h / n); null for strata without a sample."""
    a = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("population"))
    b = sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("sampled"))
    rows = a.join(b, stratum, "left").na.fill(0, ["sampled"])
    total = W.partitionBy()
    return rows.withColumn("weight", F.round(F.try_divide(F.col("population") / F.sum("population").over(total), F.col("sampled") / F.sum("sampled").over(total)), 6))


def random_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """N rows in hashed order; the limit runs in every task before one task takes the best of all."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def spread_by_length(df: DataFrame, length: str, key: str, limit: int) -> DataFrame:
    """`limit` rows spread over the lengths: positions int(i * n / limit) of the sorted rows."""
    n = df.count()
    step = n / limit if limit else 0
    wanted = df.sparkSession.createDataFrame([(int(i * step) + 1,) for i in range(min(limit, n))], "__k long")
    return global_rank(df, [length, key], "__k").join(F.broadcast(wanted), "__k").drop("__k")
