"""Near duplicates of vectors: exact blocked search for pairs over a cosine, connected components, one row per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligspark.storage import materialize

#: Vectors of one block of the triangular search.
BLOCK = 8192
#: Scores that a task holds at a time (8 bytes each, a few copies).
TILE = 1 << 20


def near_duplicate_pairs(vectors: DataFrame, least: float, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, cosine) with a < b and cosine at least `least`.

    Keys are dealt into blocks; each block pair is one task's matrix product, TILE scores at a time, so both memory and the
    unit of retry stay bounded and only pairs over the threshold are ever rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(column).alias("v"))
    n = rows.count()
    blocks = max(1, -(-n // block))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    members = dealt.select("k", "v", "own", other).select("k", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = keys[0].as_py(), keys[1].as_py()
        table = pa.Table.from_batches(batches)
        names, own = table.column("k").to_numpy(), table.column("own").to_numpy()
        matrix = table.column("v").combine_chunks().flatten().to_numpy().astype(float).reshape(len(names), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        turned, step = matrix[right].T, max(1, TILE // max(1, len(right)))
        for at in range(0, len(left), step):  # a tile's pairs go out before the next tile is made
            some = left[at : at + step]
            scores = matrix[some] @ turned
            x, y = np.nonzero(scores >= least)
            a, b = names[some[x]], names[right[y]]
            keep = a < b if i == j else a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(scores[x, y][keep])], names=["a", "b", "cosine"])

    pairs = members.groupBy("i", "j").applyInArrow(run, "a long, b long, cosine double")
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """ML10: (node, component): the smallest node reachable, by repeated minimum labels with pointer jumping.

    Every round's labels are a table in the shared folder; the driver sees one count per round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = step.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        new = materialize(step.join(jump, "l", "left").select("node", "old", F.least(F.col("l"), F.coalesce("ll", "l")).alias("l")), "labels")
        changed = new.filter("l <> old").limit(1).count()
        labels = new.select("node", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component")


def keep_first(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """ML11: rows that aren't a later member of a component."""
    later = labels.filter("node <> component").select(F.col("node").alias(key))
    return df.join(later, key, "left_anti")
