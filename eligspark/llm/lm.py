"""Language-model scores: a class-based log-bilinear model, trained in numpy by noise-contrastive estimation.

Corpus counts come first and cover every training text: exact token counts, and counts of
class triples.  The number of classes grows with the cube root of the vocabulary, so that
possible triples grow in proportion to it.  The most frequent tokens are classes of their own,
the end of a text is one, and other tokens share classes by the hash of their last two bytes.
The log-bilinear model predicts the next class: the representations of the two classes before,
each through its position's matrix, add up to a predicted representation, whose product with a
class's target vector plus the class's bias is its score.  Training contrasts the triples'
classes with noise drawn from the class frequencies (in expectation over the noise).  Distinct
triples are dealt by context; every round passes over all of them, weighted by count, in every
part, and averages the parts' models by their tokens.  The contexts' sums then give normalised
log-probabilities, and a token's share of its class (add-one within the class, with one place
for unseen tokens) completes the probability of the text.

Token counts are looked up by 64-bit hashes: broadcast where the vocabulary is proven
small, else by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligspark.llm.common import mix64, text_bytes
from eligspark.storage import materialize

HEAD, TAILS = 79, 48
CLASSES = 1 + HEAD + TAILS  # the end, frequent tokens, classes of other tokens; the least number, see class_sizes
#: Classes for each cube root of the number of distinct tokens.
GROWTH = 6
#: Endings are kept as hashes modulo this, and share tail classes only once the vocabulary is counted.
ENDINGS = 1 << 16
#: Training tokens of one part of the triples.
PART_TOKENS = 2_500_000
#: Triples counted at once by a task, and tokens scored at once.
CHUNK = 1 << 21
SCORED = 1 << 16
#: The end of a text as a token; no word contains white space.
END = b"\n"
#: A vocabulary of up to this many tokens (12 bytes each) is broadcast.
BROADCAST_TOKENS = 6_000_000
MOST_COUNTED = 1_000_000


def is_held_out(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def ending(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % ENDINGS


def class_sizes(types: int) -> tuple[int, int]:
    """Numbers of head and tail classes for a vocabulary; (HEAD, TAILS) for small ones."""
    classes = max(CLASSES, round(GROWTH * types ** (1 / 3)))
    tails = classes * TAILS // CLASSES
    return classes - 1 - tails, tails


VOCABULARY = "part int, hashes binary, counts binary, tails binary, n_types long, n_tokens long"


def token_counts(texts: DataFrame, parts: int) -> DataFrame:
    """Exact counts of all tokens of (text) rows, packed by part of the hash: sorted hashes, counts and endings."""

    def packed(counter: Counter) -> pa.RecordBatch:
        words = list(counter)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        c = np.fromiter(counter.values(), np.int64, len(words))
        t = np.fromiter(map(ending, words), np.uint16, len(words))
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((h, part))
        h, c, t, part = h[order], c[order], t[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1)).tolist()
        rows = [(int(part[a]), h[a:b].tobytes(), c[a:b].tobytes(), t[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(4)], names=["part", "hashes", "counts", "tails"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counter.update(text.lower().split())
            counter[END] += batch.num_rows
            if len(counter) > MOST_COUNTED:
                yield packed(counter)
                counter = Counter()
        if counter:
            yield packed(counter)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        c = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
        t = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["tails"]])
        order = np.argsort(h, kind="stable")
        h, c, t = h[order], c[order], t[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        c = np.add.reduceat(c, starts)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "hashes": [h[starts].tobytes()], "counts": [c.tobytes()], "tails": [t[starts].tobytes()], "n_types": [len(starts)], "n_tokens": [int(c.sum())]})

    partial = texts.mapInArrow(run, "part int, hashes binary, counts binary, tails binary")
    return partial.groupBy("part").applyInPandas(add, VOCABULARY)


def most_frequent(vocabulary: DataFrame, n: int) -> dict[int, int]:
    """Hashes of the n most frequent words (not the end), ties by hash, with their counts."""
    end = xxhash.xxh3_64_intdigest(END)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                h, c = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)
                h, c = h[h != end], c[h != end]
                order = np.lexsort((h, -c))[:n]
                yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), pa.array(c[order])], names=["hash", "count"])

    rows = vocabulary.select("hashes", "counts").mapInArrow(top, "hash long, count long").orderBy(F.desc("count"), "hash").limit(n).collect()
    return {r["hash"] % (1 << 64): r["count"] for r in rows}


def tail_statistics(vocabulary: DataFrame, head: list[int], n_tails: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and types of each tail class, frequent words and the end left out."""
    out = np.array([*head, xxhash.xxh3_64_intdigest(END)], np.uint64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, types = np.zeros(n_tails, np.int64), np.zeros(n_tails, np.int64)
            for hashes, counts, tails in zip(*(batch.column(c).to_pylist() for c in ("hashes", "counts", "tails"))):
                rest = ~np.isin(np.frombuffer(hashes, np.uint64), out)
                t, c = np.frombuffer(tails, np.uint16)[rest] % n_tails, np.frombuffer(counts, np.int64)[rest]
                tokens += np.bincount(t, c, n_tails).astype(np.int64)
                types += np.bincount(t, minlength=n_tails)
            yield pa.RecordBatch.from_arrays([pa.array(range(n_tails), pa.int32()), pa.array(tokens), pa.array(types)], names=["tail", "tokens", "types"])

    rows = vocabulary.select("hashes", "counts", "tails").mapInArrow(sums, "tail int, tokens long, types long").groupBy("tail").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    tokens, types = np.zeros(n_tails, np.int64), np.zeros(n_tails, np.int64)
    for r in rows:
        tokens[r["tail"]], types[r["tail"]] = r["tokens"], r["types"]
    return tokens, types


class WordClass(dict):
    """word -> class, remembered for a bounded number of words."""

    def __init__(self, head: list[int], n_head: int, n_tails: int, most: int = 300_000):
        super().__init__()
        self.head, self.n_head, self.n_tails, self.most = {h: 1 + k for k, h in enumerate(head)}, n_head, n_tails, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self.head.get(xxhash.xxh3_64_intdigest(word))
        value = self[word] = 1 + self.n_head + ending(word) % self.n_tails if value is None else value
        return value


def codes(classes: np.ndarray, n: int) -> np.ndarray:
    """Triple codes (two before, one before, own class) of a text whose last class is the end; before the start stands the end."""
    padded = np.concatenate([[0, 0], classes]).astype(np.int64)
    return (padded[:-2] * n + padded[1:-1]) * n + padded[2:]


def counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and their counts."""
    if counts is None:
        return np.unique(codes, return_counts=True)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts[order], starts)


def pack(codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted codes as steps and counts, each in 4 bytes where they fit; the first byte is the width."""
    return tuple(bytes([w]) + x.astype(f"u{w}").tobytes() for x in (np.diff(codes, prepend=0), counts) for w in (4 if x.max() < 1 << 32 else 8,))


def unpack(steps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = (np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64) for x in (steps, counts))
    return np.cumsum(steps), counts


TRIPLES = "part int, steps binary, counts binary"


def class_triples(texts: DataFrame, head: list[int], n_head: int, n_tails: int, parts: int) -> DataFrame:
    """Counts of all distinct class triples of (text) rows, one row for each part of the contexts."""
    n = 1 + n_head + n_tails

    def packed(pieces: list[np.ndarray]) -> pa.RecordBatch:
        code, count = counted(np.concatenate(pieces))
        part = (mix64((code // n).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        code, count, part = code[order], count[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1)).tolist()
        rows = [(int(part[a]), *pack(code[a:b], count[a:b])) for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(3)], names=["part", "steps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, pieces, held = WordClass(head, n_head, n_tails), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                pieces.append(codes(np.fromiter((*map(classes.__getitem__, words), 0), np.int64, len(words) + 1), n))
                held += len(words) + 1
                if held >= CHUNK:
                    yield packed(pieces)
                    pieces, held = [], 0
        if pieces:
            yield packed(pieces)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        code, count = (np.concatenate(x) for x in zip(*map(unpack, pdf["steps"], pdf["counts"])))
        steps, counts = pack(*counted(code, count))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "steps": [steps], "counts": [counts]})

    return texts.mapInArrow(run, TRIPLES).groupBy("part").applyInPandas(add, TRIPLES)


@dataclass
class LogBilinear:
    """Context vectors, one matrix for each position, target vectors and biases."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def predicted(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.context[far] @ self.far + self.context[near] @ self.near

    def log_sums(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Natural logarithms of the contexts' sums over all classes, by a batched matrix product."""
        scores = self.predicted(far, near) @ self.target.T + self.bias
        top = scores.max(1)
        return top + np.log(np.exp(scores - top[:, None]).sum(1))

    def log10_table(self) -> np.ndarray:
        """Normalised log10-probabilities of every class after every two classes (for few classes)."""
        n = len(self.bias)
        far, near = np.divmod(np.arange(n * n), n)
        out = np.empty((n * n, n), np.float32)
        for k in range(0, n * n, n):
            f, m = far[k : k + n], near[k : k + n]
            out[k : k + n] = (self.predicted(f, m) @ self.target.T + self.bias - self.log_sums(f, m)[:, None]) / np.log(10)
        return out

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def like(self, vector: np.ndarray) -> LogBilinear:
        """A model of this one's shapes from a vector."""
        parts, at = [], 0
        for x in (getattr(self, f.name) for f in fields(self)):
            parts.append(vector[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*parts)


def new_model(own: np.ndarray, width: int = 24, seed: int = 3) -> tuple[LogBilinear, np.ndarray]:
    """An untrained model, and the classes' frequencies, from their counts."""
    rng, n = np.random.default_rng(seed), len(own)
    frequency = (own + 0.5) / (own + 0.5).sum()
    return LogBilinear(*(rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((n, width), (width, width), (width, width), (n, width))), np.log(frequency).astype(np.float32)), frequency


#: Rounds of training; steps of a round in each part at least (more passes where a part has few contexts), and contexts of a step.
ROUNDS, STEPS, CONTEXTS = 3, 120, 512


def train_part(model: LogBilinear, frequency: np.ndarray, code: np.ndarray, count: np.ndarray, done: float = 0.0, share: float = 1.0, least: int = STEPS, noise: int = 10, rate: float = 0.02) -> LogBilinear:
    """Whole passes of noise-contrastive estimation (Adam) over distinct triples in order of their codes, weighted by their counts.

    Steps take contexts in a hashed order.  A context of more than a step's usual tokens is in every step of a
    pass with an equal share of its counts, so that each pass has each triple's count once.  `done` and `share`:
    where in the whole training this call stands, for the rate.
    """
    n = len(model.bias)
    names = [f.name for f in fields(model)]
    model = LogBilinear(*(getattr(model, k).copy() for k in names))
    log_noise, weight = np.log(noise * frequency).astype(np.float32), (noise * frequency).astype(np.float32)
    pair = code // n
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    ends, tokens = np.r_[starts[1:], len(code)], np.add.reduceat(count, starts)
    steps = -(-len(starts) // CONTEXTS)
    usual = tokens.sum() / steps
    often = np.flatnonzero(tokens > usual / 8)
    rest = np.flatnonzero(tokens <= usual / 8)
    rest = rest[np.argsort(mix64(pair[starts[rest]].astype(np.uint64) + np.uint64(1)), kind="stable")]
    passes = -(-least // steps)
    first, second = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    for t in range(1, passes * steps + 1):
        some = rest[(t - 1) % steps :: steps]
        take = np.r_[often, some]
        part = np.r_[np.full(len(often), 1 / steps), np.ones(len(some))] / usual
        sizes = ends[take] - starts[take]
        row = np.repeat(np.arange(len(take)), sizes)
        at = np.arange(len(row)) + np.repeat(starts[take] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        word, positive = code[at] % n, (count[at] * part[row]).astype(np.float32)
        far, near = np.divmod(pair[starts[take]], n)
        cf, cn = model.context[far], model.context[near]
        q = cf @ model.far + cn @ model.near
        odds = q @ model.target.T
        odds += model.bias - log_noise
        np.clip(odds, -30, 30, out=odds)
        np.negative(odds, out=odds)
        np.exp(odds, out=odds)
        odds += 1
        p = np.reciprocal(odds, out=odds)
        hit = positive * (1 - p[row, word])
        g = p * weight  # noise part, in expectation: k Pn(w) sigma(odds)
        g *= (tokens[take] * part).astype(np.float32)[:, None]
        g[row, word] -= hit
        dq = g @ model.target
        dc = np.zeros_like(model.context)
        np.add.at(dc, far, dq @ model.far.T)
        np.add.at(dc, near, dq @ model.near.T)
        grads = {"context": dc, "near": cn.T @ dq, "far": cf.T @ dq, "target": g.T @ q, "bias": g.sum(0)}
        step = rate * min(1.0, 3 * (1 - done - share * t / (passes * steps)) + 0.05)
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
            setattr(model, k, getattr(model, k) - np.float32(step / (1 - 0.9**t)) * first[k] / (np.sqrt(second[k] * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-9)))
    return model


def train(triples: np.ndarray) -> LogBilinear:
    """Training on one machine, on dense triple counts."""
    n = round(len(triples) ** (1 / 3))
    model, frequency = new_model(np.bincount(np.arange(n**3) % n, weights=triples, minlength=n))
    code = np.flatnonzero(triples)
    return train_part(model, frequency, code, triples[code], least=ROUNDS * STEPS * 2) if len(code) else model


def trained(triples: DataFrame, n: int) -> LogBilinear:
    """Rounds of passes over all parts of the triples, each followed by the mean of the parts' models by tokens."""
    spark = triples.sparkSession

    def own_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = np.zeros(n, np.int64), 0
        for batch in batches:
            for steps, counts in zip(batch.column("steps").to_pylist(), batch.column("counts").to_pylist()):
                code, count = unpack(steps, counts)
                own += np.bincount(code % n, count, n).astype(np.int64)
                parts += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([float(parts)]), pa.array([own.astype(np.float64).tobytes()], pa.binary())], names=["slot", "tokens", "vector"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in pdf["vector"])
        return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "tokens": [pdf["tokens"].sum()], "vector": [total.tobytes()]})

    sums = "slot int, tokens double, vector binary"

    def summed(rows: DataFrame) -> tuple[float, np.ndarray | None]:
        got = rows.groupBy("slot").applyInPandas(add, sums).collect()  # at most 16 vectors of a model's size
        return sum(r["tokens"] for r in got), sum(np.frombuffer(r["vector"], np.float64) for r in got) if got else None

    parts, own = summed(triples.mapInArrow(own_counts, sums))
    model, frequency = new_model(np.zeros(n) if own is None else own)
    if not parts:
        return model
    least = STEPS * 2 if parts == 1 else STEPS
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model, frequency))

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            start, frequency = shared.value
            for batch in batches:
                for part, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "steps", "counts"))):
                    code, count = unpack(steps, counts)
                    tokens = float(count.sum())
                    vector = train_part(start, frequency, code, count, k / ROUNDS, 1 / ROUNDS, least).vector().astype(np.float64) * tokens
                    yield pa.RecordBatch.from_arrays([pa.array([part % 16], pa.int32()), pa.array([tokens]), pa.array([vector.tobytes()], pa.binary())], names=["slot", "tokens", "vector"])

        tokens, vector = summed(triples.mapInArrow(run, sums))
        model = model.like(vector / tokens)
        shared.destroy()
    return model


def context_sums(model: LogBilinear, spark: SparkSession, parts: int) -> np.ndarray:
    """Logarithms of all contexts' sums; a table of n * n numbers, made in `parts` tasks."""
    n = len(model.bias)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for far in batch.column("id").to_pylist():
                sums = shared.value.log_sums(np.full(n, far), np.arange(n)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([far], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["far", "sums"])

    out = np.empty((n, n), np.float32)
    for row in spark.range(0, n, 1, parts).mapInArrow(run, "far long, sums binary").collect():  # n rows of n numbers
        out[row["far"]] = np.frombuffer(row["sums"], np.float32)
    shared.destroy()
    return out


class ClassScores:
    """log10-probabilities of classes after two classes."""

    def __init__(self, model: LogBilinear, sums: np.ndarray):
        self.far, self.near = model.context @ model.far, model.context @ model.near
        self.target, self.bias, self.sums = model.target, model.bias, sums

    def of(self, padded: np.ndarray) -> np.ndarray:
        """Of all classes of a sequence but its first two."""
        out = np.empty(len(padded) - 2, np.float64)
        for k in range(0, len(out), SCORED):
            far, near, own = padded[k : k + SCORED][: len(out) - k], padded[k + 1 : k + 1 + SCORED][: len(out) - k], padded[k + 2 : k + 2 + SCORED]
            q = self.far[far]
            q += self.near[near]
            out[k : k + SCORED] = np.einsum("ij,ij->i", q, self.target[own]) + self.bias[own] - self.sums[far, near]
        return out / np.log(10)

    def texts(self, sequences: list[np.ndarray]) -> list[float]:
        """Sums over texts, each of whose last class is the end; before the start stands the end."""
        if not sequences:
            return []
        scores = self.of(np.concatenate([x for s in sequences for x in (np.zeros(2, np.int64), s)]))
        at, out = 0, []
        for s in sequences:
            out.append(float(scores[at : at + len(s)].sum()))
            at += len(s) + 2
        return out


@dataclass
class Scorer:
    """Everything that scoring needs besides the token counts; it grows with the square of the classes."""

    scores: ClassScores
    head: list[int]
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    tokens: int
    types: int
    n_head: int = HEAD
    head_counts: tuple[int, ...] = ()

    def frequent(self) -> np.ndarray:
        """Counts of the end and the head's words by their class; -1 for tail classes."""
        known = np.full(1 + self.n_head + len(self.tail_tokens), -1, np.int64)
        known[0] = self.tokens - sum(self.head_counts) - int(self.tail_tokens.sum())
        known[1 : 1 + len(self.head_counts)] = self.head_counts
        return known

    def classes(self) -> WordClass:
        return WordClass(self.head, self.n_head, len(self.tail_tokens))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))

    def within_class(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a token's share of its class."""
        tail = classes - 1 - self.n_head
        shares = (counts + 1) / (self.tail_tokens + self.tail_types + 1)[np.maximum(tail, 0)]
        return np.where(tail >= 0, np.log10(shares), 0.0)


class Numbers(dict):
    """key -> running number."""

    def __missing__(self, key) -> int:
        value = self[key] = len(self)
        return value


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored_by_broadcast(texts: DataFrame, scorer: Scorer, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((scorer, hashes, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known, known_counts = shared.value
        classes = s.classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                number, sequences = Numbers(), []
                for text in part.column("text").to_pylist():
                    words = text.lower().split()
                    words.append(END)
                    sequences.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                distinct = list(number)
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
                place = np.searchsorted(known, h)
                place[place == len(known)] = 0
                c = np.where(known[place] == h, known_counts[place], 0).astype(np.int64) if len(known) else np.zeros(len(h), np.int64)
                cls = np.fromiter((0 if w == END else classes[w] for w in distinct), np.int64, len(distinct))
                base, share, seen = s.base(c), s.within_class(cls, c), c > 0
                scores = s.scores.texts([cls[i] for i in sequences])
                out = [(len(i), int(seen[i].sum()), float(base[i].sum()), x + float(share[i].sum())) for i, x in zip(sequences, scores)]
                yield result(part, s, out)

    return texts.mapInArrow(run, OUT)


def result(part: pa.RecordBatch, scorer: Scorer, out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    n, known, base, score = (pa.array([r[k] for r in out], t) for k, t in enumerate(types))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), n, known, pa.array([scorer.tokens] * len(out), pa.int64()), base, score], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


PIECES = "rid long, doc_id long, held_out boolean, n_tokens long, class_score double, head_known long, head_base double, hashes array<long>, tails array<int>, times array<int>"


def scored_by_join(texts: DataFrame, scorer: Scorer, vocabulary: DataFrame) -> DataFrame:
    """The same scores for a vocabulary of any size: distinct tokens of each text meet their counts in a join.

    The end and the head's words, which most texts have, are counted by the scorer itself, so that they are no keys of the join.
    """
    shared = texts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        classes, frequent = s.classes(), s.frequent()
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_tokens", "class_score", "head_known", "head_base", "hashes", "tails", "times")}
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                cls = np.fromiter((*map(classes.__getitem__, words), 0), np.int64, len(words) + 1)
                cols["n_tokens"].append(len(words) + 1)
                cols["class_score"].append(s.scores.texts([cls])[0])
                head = frequent[cls]
                head = head[head >= 0]
                cols["head_known"].append(int((head > 0).sum()))
                cols["head_base"].append(float(s.base(head).sum()))
                times = Counter(w for w, c in zip(words, cls.tolist()) if c > s.n_head)
                cols["hashes"].append([xxhash.xxh3_64_intdigest(w) - (1 << 64) * (xxhash.xxh3_64_intdigest(w) >> 63) for w in times])
                cols["tails"].append([classes[w] - 1 - s.n_head for w in times])
                cols["times"].append(list(times.values()))
            types = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), *(pa.array(v, t) for v, t in zip(cols.values(), types))], names=["rid", "doc_id", "held_out", *cols])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["hash", "count"])

    rows = materialize(texts.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, PIECES), "lm-pieces")
    tokens = rows.select("rid", F.explode(F.arrays_zip("hashes", "tails", "times")).alias("x")).select("rid", F.col("x.hashes").alias("hash"), F.col("x.tails").alias("tail"), F.col("x.times").alias("times"))
    counted = tokens.join(vocabulary.select("hashes", "counts").mapInArrow(unpacked, "hash long, count long"), "hash", "left").withColumn("c", F.coalesce("count", F.lit(0)).cast("double"))
    sizes = F.array(*[F.lit(float(n)) for n in scorer.tail_tokens + scorer.tail_types + 1])
    share = F.when(F.col("tail") >= 0, F.log10((F.col("c") + 1) / F.get(sizes, F.col("tail")))).otherwise(0.0)
    base = F.log10((F.col("c") + 1) / F.lit(float(scorer.tokens + scorer.types + 1)))
    sums = counted.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).cast("long").alias("n_known"), F.sum(base * F.col("times")).alias("base_score"), F.sum(share * F.col("times")).alias("share"))
    joined = rows.drop("hashes", "tails", "times").join(sums, "rid", "left")  # a text may have no tail token
    known, base = F.col("head_known") + F.coalesce("n_known", F.lit(0)), F.col("head_base") + F.coalesce("base_score", F.lit(0.0))
    score = F.col("class_score") + F.coalesce("share", F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(scorer.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def score_documents(documents: DataFrame, most_broadcast: int = BROADCAST_TOKENS, parts: int | None = None) -> DataFrame:
    """One row per row of `documents` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows that aren't held out.  Null and empty texts are the end token alone;
    a null id counts as an empty id text (held in, crc32 0) and stays null; repeated rows count
    and are scored each time; with no training rows every token is unseen; an empty table gives
    no rows; very long texts are scored whole; other columns are not read.  Sums run in text order, so ties don't arise.
    """
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), text_bytes().alias("text"))
    training = texts.filter(~F.col("held_out")).select("text")
    vocabulary = materialize(token_counts(training, parts), "lm-vocabulary")
    types, tokens = vocabulary.agg(F.coalesce(F.sum("n_types"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_head, n_tails = class_sizes(types)
    frequent = most_frequent(vocabulary, n_head)
    head = list(frequent)
    tail_tokens, tail_types = tail_statistics(vocabulary, head, n_tails)
    triples = materialize(class_triples(training, head, n_head, n_tails, -(-tokens // PART_TOKENS) or 1), "lm-triples")
    model = trained(triples, 1 + n_head + n_tails)
    scorer = Scorer(ClassScores(model, context_sums(model, spark, parts)), head, tail_tokens, tail_types, tokens, types, n_head, tuple(frequent.values()))
    if types > most_broadcast:
        return scored_by_join(texts, scorer, vocabulary)
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for row in vocabulary.select("hashes", "counts").toLocalIterator():  # `types` tokens, at most `most_broadcast`
        hashes.append(np.frombuffer(bytes(row["hashes"]), np.uint64))
        counts.append(np.frombuffer(bytes(row["counts"]), np.int64))
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    c = c[order]
    return scored_by_broadcast(texts, scorer, h[order], c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c)
