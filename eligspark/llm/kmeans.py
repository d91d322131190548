"""Centroid clustering by delta Lloyd: integer vectors, persisted owners, signed transfers.

The state of a round is a table in the shared folder: every vector's packed integers, its owner and
its distance to that owner.  The next round compares a vector only with the centroids that changed,
unless its own centroid moved away from it; only vectors whose owner changed send anything: what they
take from one centroid's sum and give to another's, added up per task before the shuffle.  So a round
moves at most (clusters x components) numbers a task, and a centroid is floor(sum / count) of sums that are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligspark.storage import drop_scratch, materialize

#: Components up to this size are compared in 64-bit integers; larger ones in Python's integers.
SAFE = 1 << 27
LONG = (1 << 63) - 1

STATE = "vec_id long, packed binary, before int, cluster int, distance long"
TRANSFER = "cluster int, component int, amount decimal(38,0)"


def usable(vector: Column, components: int) -> Column:
    """True for vectors with exactly so many components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == components) & ~bad


def integers(vectors: pa.Array, components: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * component); an array of Python integers if a component is beyond SAFE."""
    values = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, components)
    whole = np.floor(values * scale)
    if np.abs(whole).max(initial=0) < SAFE:
        return whole.astype(np.int64)
    return np.array([[int(x) for x in row] for row in whole], object)


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 1, 2, 4 and 8 bytes a component (as decimal text where 8 are too few)."""
    if rows.dtype == object:
        return [pack(r[None].astype(np.int64))[0] if max(map(abs, r)) < SAFE else b"t" + ",".join(map(str, r)).encode() for r in rows]
    if not len(rows):
        return []
    wide = np.abs(rows).max(axis=1)
    kinds = np.digitize(wide, [1 << 7, 1 << 15, 1 << 31])
    return [b"1248"[k : k + 1] + r.astype(f"<i{1 << k}").tobytes() for r, k in zip(rows, kinds)]


def unpack(packed: list[bytes], components: int) -> np.ndarray:
    rows = [np.array([int(x) for x in p[1:].split(b",")], object) if p[:1] == b"t" else np.frombuffer(p, f"<i{int(p[:1])}", components, 1) for p in packed]
    if not rows:
        return np.empty((0, components), np.int64)
    return np.array(rows, object if any(r.dtype == object for r in rows) else np.int64)


def distances(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    if rows.dtype == object or centroid.dtype == object:
        return ((rows.astype(object) - centroid.astype(object)) ** 2).sum(axis=1)
    return np.square(rows - centroid).sum(axis=1)


@dataclass
class Centroids:
    """Positions now and in the round before; `changed`: the numbers of those that moved."""

    now: list[list[int]]
    changed: list[int]

    def row(self, k: int) -> np.ndarray:
        return np.array(self.now[k], np.int64 if max(map(abs, self.now[k])) < SAFE else object)


def reassigned(rows: np.ndarray, owner: np.ndarray | None, distance: np.ndarray | None, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, distance, comparisons) of every vector; ties go to the smaller number.

    A vector whose centroid stayed, or came no further away, can only be won by a changed centroid: every other one is
    as far as before, and was not nearer then.  A vector whose centroid went further away meets all of them.
    """
    n, k = len(rows), len(centroids.now)
    every = np.arange(n)
    if owner is None:
        best = np.full(n, k, np.int64)
        gap = np.full(n, -1, object if rows.dtype == object or any(max(map(abs, c)) >= SAFE for c in centroids.now) else np.int64)
        todo = {c: every for c in range(k)}
    else:
        best, gap = owner.copy(), distance.copy()
        worse = np.zeros(n, bool)
        for c in centroids.changed:
            mine = np.flatnonzero(owner == c)
            d = distances(rows[mine], centroids.row(c))
            if d.dtype == object:
                gap = gap.astype(object)
            worse[mine] = d > gap[mine]
            gap[mine] = d
        far = np.flatnonzero(worse)
        moved = set(centroids.changed)
        todo = {c: every if c in moved else far for c in range(k)}
    compared = 0
    for c, some in todo.items():
        if owner is not None:
            some = some[owner[some] != c]
        if not len(some):
            continue
        d = distances(rows[some], centroids.row(c))
        if d.dtype == object:
            gap = gap.astype(object)
        compared += len(some)
        wins = (gap[some] < 0) | (d < gap[some]) | ((d == gap[some]) & (c < best[some]))
        at = some[wins.astype(bool)]
        best[at], gap[at] = c, d[wins.astype(bool)]
    return best, gap, compared


def assign(state: DataFrame, centroids: Centroids, components: int, scale: int) -> DataFrame:
    """The state table after one round of comparisons."""
    shared = state.sparkSession.sparkContext.broadcast(centroids)
    first = "packed" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if first:
                rows = integers(batch.column("vector"), components, scale)
                owner = before = None
                packed = pack(rows)
            else:
                packed = batch.column("packed").to_pylist()
                rows = unpack(packed, components)
                owner = before = batch.column("cluster").to_numpy().astype(np.int64)
                gap = batch.column("distance").to_numpy(zero_copy_only=False)
                if batch.column("distance").null_count:  # beyond a long: worked out again
                    gap = np.array([d if d is not None else int(distances(rows[i : i + 1].astype(object), np.array(c.now[owner[i]], object))[0]) for i, d in enumerate(batch.column("distance").to_pylist())], object)
            best, gap, _ = reassigned(rows, owner, None if first else gap, c)
            shown = gap if gap.dtype != object else [int(d) if d <= LONG else None for d in gap]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(np.full(len(best), -1) if before is None else before, pa.int32()), pa.array(best, pa.int32()), pa.array(shown, pa.int64())], names=["vec_id", "packed", "before", "cluster", "distance"]
            )

    return state.mapInArrow(run, STATE)


def transfers(state: DataFrame, clusters: int, components: int) -> dict[tuple[int, int], int]:
    """What every centroid's sum (component 0 to n - 1) and count (component n) gains and loses by the moves of a round.

    At most clusters x (components + 1) numbers leave a task, and as many reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, components + 1), object)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = unpack(batch.column("packed").to_pylist(), components)
            rows = np.column_stack([rows, np.ones(len(rows), rows.dtype)])
            for sign, column in ((-1, "before"), (1, "cluster")):
                owner = batch.column(column).to_numpy()
                for c in np.unique(owner[owner >= 0]).tolist():
                    total[c] += sign * rows[owner == c].sum(axis=0).astype(object)
        hit = [(c, k, total[c, k]) for c in range(clusters) for k in range(components + 1) if total[c, k]]
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int32()), pa.array([h[1] for h in hit], pa.int32()), pa.array([Decimal(int(h[2])) for h in hit], pa.decimal128(38, 0))], names=["cluster", "component", "amount"])

    moved = state.filter("before <> cluster").select("packed", "before", "cluster").mapInArrow(run, TRANSFER)
    return {(r[0], r[1]): int(r[2]) for r in moved.groupBy("cluster", "component").agg(F.sum("amount").cast("decimal(38,0)").alias("amount")).collect()}


def starts(vectors: DataFrame, clusters: int, components: int, scale: int, seed: str) -> list[list[int]]:
    """The vectors whose ids have the smallest sha256 of `<seed>:<id>`; rows that share an id by their components, rows without one last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "vector").limit(clusters).collect()
    return [[int(x) for x in row] for row in integers(pa.array([list(r["vector"]) for r in rows], pa.list_(pa.float64())), components, scale)] if rows else []


def cluster_vectors(
    embeddings: DataFrame, clusters: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1", id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, rounds_moved.

    Vectors that are null, of another length or with null or non-finite components are left out; repeated rows are
    vectors of their own and null ids stay null; fewer vectors than `clusters` give as many centroids as there are;
    ties go to the smaller centroid; an empty table gives no rows; other columns are not read.  A distance or sum of
    distances beyond a long is null.  `rounds_moved`: how many of the later rounds changed the vectors' centroid at all.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(usable(F.col("vector"), components))
    now = starts(vectors, clusters, components, scale, seed)
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, rounds_moved int")
    sums = [[0] * (components + 1) for _ in now]
    state, centroids, moved = vectors, Centroids(now, list(range(len(now)))), [0] * len(now)
    for step in range(rounds + 1):
        old, state = state, materialize(assign(state, centroids, components, scale), "lloyd-state")
        if step:
            drop_scratch(old)
        if step == rounds:
            break
        for (c, k), amount in transfers(state, len(now), components).items():
            sums[c][k] += amount
        then = [[s // row[-1] for s in row[:-1]] if row[-1] else centroids.now[c] for c, row in enumerate(sums)]
        changed = [c for c, (a, b) in enumerate(zip(centroids.now, then)) if a != b]
        moved = [m + (c in changed) for c, m in enumerate(moved)]
        centroids = Centroids(then, changed)
    per = {r["cluster"]: r["total"] for r in state.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")).collect()}
    fits = lambda x: int(x) if x is not None and x <= LONG else None
    whole = None if None in per.values() else fits(sum(per.values()))
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.now]
    return state.select(
        "vec_id", "cluster", "distance", of([fits(per.get(c)) for c in range(len(now))], "long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"), of(moved, "int").alias("rounds_moved")
    )


def clustering_sql(clusters: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1") -> str:
    """DuckDB SQL over `embeddings` with the same result; every round compares every vector with every centroid."""
    parts = [
        f"v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as q from embeddings "
        f"where len(embedding) = {components} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c, q from v order by sha256('{seed}:' || vec_id) limit {clusters})",
    ]
    for k in range(rounds + 1):
        parts.append(
            f"a{k} as (select r, vec_id, q, c, d from (select v.r, v.vec_id, v.q, c, list_sum(list_transform(range(1, {components + 1}), lambda i: (v.q[i] - c{k}.q[i]) * (v.q[i] - c{k}.q[i]))) as d from v cross join c{k}) "
            "qualify row_number() over (partition by r order by d, c) = 1)"
        )
        if k < rounds:
            parts.append(
                f"m{k} as (select c, i, cast(sum(x) as bigint) as s, count(*) as n from (select c, unnest(q) as x, unnest(range(1, {components + 1})) as i from a{k}) group by c, i), "
                f"c{k + 1} as (select c, list(x order by i) as q from (select c, i, (s - ((s % n) + n) % n) // n as x from m{k} union all select c, unnest(range(1, {components + 1})), unnest(q) from c{k} where c not in (select c from m{k})) group by c)"
            )
    return (
        f"with {', '.join(parts)} select a.vec_id, cast(a.c as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia, "
        f"sha256(array_to_string(k.q, ',')) as centroid_sha256 from a{rounds} a join c{rounds} k on k.c = a.c"
    )
