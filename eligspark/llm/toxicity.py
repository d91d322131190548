"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary bigram model are learned from labelled texts.  Each interpolates its discounted bigrams with its
own continuation counts (in how many contexts the class has a word), these with the counts of the word's stems, and these
with the counts that both classes share (in how many classes a stem occurs), so that a rare expression is nearly as likely
under both.  A text's words are compared under the two models; the differences, averaged over the text and over its most
telling words, are calibrated to a probability on texts that the models compared there had not seen.

Learning takes a bounded sample of labelled rows; scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligspark.llm.common import ODD, mix64, slices

#: Labelled rows that the models are learned from at most, and their words: those of the lowest hashed ids, in that order.
MOST_LABELLED, MOST_WORDS = 8_000, 3_000_000
#: Bigrams of fewer texts are left to the continuation counts (their mass stays in the backoff weight).
LEAST_TEXTS = 2
FOLDS = 3
THRESHOLD = 0.3
#: Positions of the most telling words that are averaged.
TELLING = (1, 2, 4)

WORDLIKE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Latin-1 signs, general punctuation and ideographic marks in UTF-8.
SIGNS = re.compile(rb"\xc2[\xa0-\xbf]|\xe2[\x80-\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]")
#: Prefixes, in characters, that a word's probability falls back to.
STEMS = (3, 4, 5, 6, 7)
#: Words whose probabilities a process remembers.
MOST_KNOWN = 400_000
START = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def words(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits, in UTF-8."""
    raw = text.encode() if text.isascii() else SIGNS.sub(b" ", text.lower().encode())
    return raw.translate(WORDLIKE).split()


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))


def stem_hashes(vocabulary: list[bytes]) -> np.ndarray:
    """(stems, words) hashes of the words' proper prefixes; of the word itself where it is no longer than the prefix."""
    out = np.tile(word_hashes(vocabulary), (len(STEMS), 1))
    texts = [w.decode() for w in vocabulary]
    for k, n in enumerate(STEMS):
        long = [i for i, t in enumerate(texts) if len(t) > n]
        out[k, long] = np.fromiter((xxhash.xxh3_64_intdigest(texts[i][:n], seed=1) for i in long), np.uint64, len(long))
    return out


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before * ODD + word)


def behind(word: np.ndarray, edges: np.ndarray, start) -> np.ndarray:
    """What stands before each position of the texts that `edges` cut; `start` where a text begins."""
    before = np.roll(word, 1)
    before[edges[:-1][edges[:-1] < len(word)]] = start
    return before


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of the counts of counts; one half where there are too few."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def place_of(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table; its length for others."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[place] == keys, place, len(table))


@dataclass
class Level:
    """Probabilities of one level of the fall-back (a stem length, or whole words) under both classes."""

    key: np.ndarray  # sorted hashes
    p: np.ndarray  # (2, keys)
    children: np.ndarray  # (keys + 1,) distinct next keys of both classes, last: 0
    left: np.ndarray  # (2,) weight left to the level below

    def step(self, key: np.ndarray, below: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, room for the next level) of keys, given those of the level below and the room there."""
        place = place_of(self.key, key)
        known = np.column_stack([self.p, np.zeros(2)])[:, place]
        p = np.where(place < len(self.key), known, self.left[:, None] * below / (1 + room))
        return p, self.children[place]


def counts_of(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.bincount(np.searchsorted(table, keys), minlength=len(table))[: len(table)]


@dataclass
class Models:
    """Both classes' models as sorted tables."""

    floor: float  # shared probability of a first stem or short word that neither class has
    levels: list[Level]  # stems from short to long, then whole words
    plain: Level  # whole words that fall back to the floor at once
    word: np.ndarray  # sorted hashes of known words
    context: np.ndarray  # (2, words + 2) weight left to the word level behind a word, an unknown word, the start
    pair: np.ndarray
    upper: np.ndarray  # (2, pairs) discounted share of the bigram behind its first word

    def words(self, hashes: np.ndarray, stems: np.ndarray) -> np.ndarray:
        """(2, 2, words) probabilities, with stems and without, under both classes."""
        p, room = np.full((2, len(hashes)), self.floor), np.zeros(len(hashes))
        plain, _ = self.plain.step(hashes, p, room)
        for at, key in zip(self.levels, [*stems, hashes]):
            p, room = at.step(key, p, room)
        return np.stack([p, plain])

    def levels_apart(self) -> np.ndarray:
        """The log ratios, with stems and without, of a word that the classes have nothing of."""
        return np.array([sum(np.log(at.left[1] / at.left[0]) for at in chain) for chain in (self.levels, [self.plain])])

    def behind_word(self, hashes: np.ndarray) -> np.ndarray:
        return self.context[:, place_of(self.word, hashes)]


def level_of(own: list[np.ndarray], counts: list[np.ndarray], below, next_keys: np.ndarray) -> Level:
    """A level from both classes' keys and counts; `below(keys)`: probabilities under the level below, already shared out."""
    key = np.unique(np.concatenate(own))
    p, left = np.zeros((2, len(key))), np.ones(2)
    for c in (0, 1):
        n = np.zeros(len(key))
        n[np.searchsorted(key, own[c])] = counts[c]
        d, total = discount(n), n.sum()
        left[c] = d * (n > 0).sum() / total if total else 1.0
        p[c] = np.maximum(n - d, 0) / max(total, 1)
    p += left[:, None] * below(key)
    return Level(key, p, np.r_[counts_of(next_keys, key), 0.0], left)


def counted(word: np.ndarray, edges: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word, number of texts) of the distinct bigrams of texts of word numbers; a text counts a bigram once."""
    before, text = behind(word, edges, n_words), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    keys = before.astype(np.int64) * (n_words + 1) + word
    order = np.lexsort((text, keys))
    k, t = keys[order], text[order]
    once = k[np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]] if len(k) else k
    distinct, n = np.unique(once, return_counts=True)
    return distinct // (n_words + 1), distinct % (n_words + 1), n


def learned(texts: list[np.ndarray], toxic: np.ndarray, hashes: np.ndarray, stems: np.ndarray) -> Models:
    """Models of both classes from texts of word numbers, given the words' and their stems' hashes."""
    n_words, parts = len(hashes), []
    for c in (0, 1):
        own = [t for t, label in zip(texts, toxic) if label == c]
        edges = np.r_[0, np.cumsum([len(t) for t in own])].astype(np.int64)
        parts.append(counted(np.concatenate(own) if own else np.empty(0, np.int64), edges, n_words))
    # continuation counts: in how many contexts a class has a word, and how many of its words have a stem
    contexts = [np.bincount(w, minlength=n_words)[:n_words] for _, w, _ in parts]
    present = [np.flatnonzero(n) for n in contexts]
    both = np.unique(np.concatenate(present))
    # what both classes share at the bottom: in how many classes a key occurs, spread over one key more than there are
    chain = [*stems, hashes]
    seen = np.concatenate([np.unique(chain[0][p]) for p in present])
    floor = 1 / (len(seen) + 1)
    bottom = dict(zip(*(x.tolist() for x in np.unique(seen, return_counts=True))))
    levels: list[Level] = []
    p, room = floor * np.fromiter((bottom.get(k, 1) for k in chain[0].tolist()), float, n_words) * np.ones((2, 1)), np.zeros(n_words)
    for at, keys in enumerate(chain):
        own, counts = zip(*[(keys[mine], n[mine]) if at == len(stems) else np.unique(keys[mine], return_counts=True) for mine, n in zip(present, contexts)])
        at_key = dict(zip(keys[both].tolist(), both.tolist()))  # any word with the key: all have the same stems below

        def below(key: np.ndarray, p=p, room=room, at_key=at_key) -> np.ndarray:
            any_word = np.array([at_key[k] for k in key.tolist()], np.int64)
            return p[:, any_word] / (1 + room[any_word])

        # the next keys of a stem: longer stems, and words that end there
        longer = both[keys[both] != hashes[both]]
        level = level_of(own, counts, below, np.unique(np.stack([keys[longer], chain[at + 1][longer]]), axis=1)[0] if at < len(stems) else keys[:0])
        levels.append(level)
        p, room = level.step(keys, p, room)
    in_classes = sum((n > 0).astype(float) for n in contexts)
    by_hash = dict(zip(hashes.tolist(), range(n_words)))
    plain = level_of([hashes[p] for p in present], [n[p] for n, p in zip(contexts, present)], lambda key: floor * in_classes[[by_hash[k] for k in key.tolist()]], np.empty(0, np.uint64))
    order = np.argsort(hashes)
    context, upper = [], []
    keys = [bigram(np.r_[hashes, START][b], hashes[w]) for b, w, _ in parts]
    pair = np.unique(np.concatenate([k[n >= LEAST_TEXTS] for k, (_, _, n) in zip(keys, parts)]))
    for c, (b, w, n) in enumerate(parts):
        # behind a word: what the kept bigrams take, and the rest
        d, kept = discount(n), n >= LEAST_TEXTS
        sums, taken = (np.bincount(b[m], weights=x[m], minlength=n_words + 1) for m, x in ((n > 0, n), (kept, np.maximum(n - d, 0))))
        rest = np.where(sums > 0, 1 - taken / np.maximum(sums, 1), 1.0)
        context.append(np.r_[rest[:-1][order], 1.0, rest[-1]])
        share = np.zeros(len(pair))
        share[np.searchsorted(pair, keys[c][kept])] = (np.maximum(n - d, 0) / np.maximum(sums, 1)[b])[kept]
        upper.append(share)
    return Models(floor, levels, plain, hashes[order], np.array(context), pair, np.array(upper))


class Lexicon:
    """Words that a process has met, with what the models say of them; emptied when full."""

    def __init__(self, models: Models):
        self.models = models
        self.known: dict[bytes, int] = {}
        self.hashes, self.p, self.context, self.level = np.empty(0, np.uint64), np.empty((2, 2, 0)), np.empty((2, 0)), models.levels_apart()

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """Numbers of all words of the texts, one after another."""
        if len(self.known) > MOST_KNOWN:
            self.__init__(self.models)
        known = self.known
        new = list({w for t in texts for w in t if w not in known})
        if new:
            hashes = word_hashes(new)
            p = self.models.words(hashes, stem_hashes(new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.hashes = np.r_[self.hashes, hashes]
            self.p, self.context = np.concatenate([self.p, p], axis=2), np.concatenate([self.context, self.models.behind_word(hashes)], axis=1)
        return np.fromiter((known[w] for t in texts for w in t), np.int64, sum(map(len, texts)))

    def differences(self, number: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each word, less what an unknown expression would have: by stems, and by whole words."""
        if not len(number):
            return np.zeros((2, 0))
        hashes = self.hashes[number]
        weight = self.context[:, behind(number, edges, 0)]
        weight[:, edges[:-1][edges[:-1] < len(number)]] = self.models.context[:, -1:]
        place = place_of(self.models.pair, bigram(behind(hashes, edges, START), hashes))
        p = np.column_stack([self.models.upper, np.zeros(2)])[:, place] + weight * self.p[:, :, number]
        return np.log(p[:, 1] / p[:, 0]) - self.level[:, None]


def telling(values: np.ndarray) -> list[float]:
    """The mean of the 1, 2, 4 highest; missing ones are 0."""
    n, most = len(values), TELLING[-1]
    best = np.sort(np.partition(values, n - most)[-most:] if n > most else values)[::-1]
    best = np.r_[best, np.zeros(most - len(best))]
    return [best[:k].mean() for k in TELLING]


def features(lexicon: Lexicon, texts: list[list[bytes]]) -> np.ndarray:
    """Per text: the mean difference of its words, and of its 1, 2, 4 most telling ones, by stems and by whole words; 0 without words."""
    edges = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    values = lexicon.differences(lexicon.numbers(texts), edges)
    out = np.zeros((len(texts), 1 + 2 * len(TELLING)))
    for k, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        if a < b:
            out[k] = [values[0, a:b].mean(), *telling(values[0, a:b]), *telling(values[1, a:b])]
    return out


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (last: constant) by Newton's method with a ridge on all but the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Detector:
    """Models and calibration; without both classes among the labelled rows only their smoothed share."""

    models: Models | None
    weights: np.ndarray
    share: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.models is None or not texts:
            return np.full(len(texts), self.share)
        lexicon = self.__dict__.get("lexicon") or self.__dict__.setdefault("lexicon", Lexicon(self.models))  # one a process
        z = features(lexicon, [words(t) for t in texts]) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(texts: list[bytes], toxic: np.ndarray) -> Detector:
    """Models from all texts (words joined by spaces), calibration from texts that models of the other folds compare; equal texts share a fold."""
    share = (toxic.sum() + 0.1) / (len(toxic) + 1)
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.int64) for t in texts]
    vocabulary = list(numbers)
    hashes, stems = word_hashes(vocabulary), stem_hashes(vocabulary)
    fold = np.array([xxhash.xxh3_64_intdigest(t) % FOLDS for t in texts], int)
    x, y = [], []
    for f in range(FOLDS):
        inner, outer = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(outer) and 0 < toxic[inner].sum() < len(inner):
            lexicon = Lexicon(learned([coded[k] for k in inner], toxic[inner], hashes, stems))
            x += [features(lexicon, [[vocabulary[i] for i in coded[k].tolist()] for k in outer[at : at + 500]]) for at in range(0, len(outer), 500)]
            y.append(toxic[outer])
    if not x or not 0 < np.concatenate(y).sum() < len(np.concatenate(y)):
        return Detector(None, np.zeros(0), float(share))
    return Detector(learned(coded, toxic, hashes, stems), calibrated(np.vstack(x), np.concatenate(y).astype(float)), float(share))


def held_out():
    """Rows that nothing is learned from; a null id counts as an empty id text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_words: int = MOST_WORDS) -> Detector:
    """A detector from at most `most` labelled rows with at most `most_words` words together, in the order of hashed ids.

    Of several labels of an id the highest counts; rows without id, label or text don't; equal texts of a class count once.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            joined = [b" ".join(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([len(t) for t in texts], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in joined], pa.int64()), pa.array(joined, pa.binary())], names=["doc_id", "toxic", "n", "name", "words"])

    found = rows.mapInArrow(run, "doc_id long, toxic int, n long, name long, words binary")
    found = found.groupBy("name", "toxic").agg(F.min_by("words", "doc_id").alias("words"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    before = F.sum("n").over(_order())
    sample = found.withColumn("sum", before).filter(F.col("sum") <= most_words).select("toxic", "words", F.xxhash64("doc_id").alias("h"), "name")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of the bounded sample in one task; its pickled detector is the one row."""
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        rows = pa.concat_tables(parts).sort_by([("h", "ascending"), ("name", "ascending")]) if parts else None
        texts, toxic = (rows.column("words").to_pylist(), rows.column("toxic").to_numpy() > 0) if parts else ([], np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(texts, toxic.astype(int)))], pa.binary())], names=["detector"])

    made = sample.coalesce(1).mapInArrow(fit, "detector binary").first()
    return pickle.loads(made["detector"]) if made else fitted([], np.zeros(0, int))  # without rows there is no task


def _order():
    """Over at most MOST_LABELLED rows, so one task may hold them."""
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64("doc_id"), "doc_id", "name").rowsBetween(Window.unboundedPreceding, 0)


def score_toxicity(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `documents`: doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold).

    Null, empty and wordless texts have the score of a text that says nothing; null ids stay null (and count as an empty
    id text for held_out); repeated rows are scored each time; equally telling words are taken in text order; very long
    texts are scored whole; without labels of both classes every score is the smoothed share of toxic rows; an empty
    table gives no rows; other columns are not read.
    """
    detector = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            scores = detector.value.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(scores >= threshold, pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
