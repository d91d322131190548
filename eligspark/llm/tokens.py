"""Token counts by a compiled finite-state transducer (no library call per text).

The tokenizer file (byte pair encoding with a word-end suffix) is compiled into a
deterministic transducer over the bytes of one pre-token.  A state stands for everything a
prefix can still do to the encoding: the longest suffix that some vocabulary entry starts
with, and for each place inside that suffix the last token and the token count of the
encoding that ends there.  Reading a byte moves to the next state and emits the *change*
of the token count; the final byte (which carries the word-end suffix) emits the last
change.  States are made when first reached and the table is emptied when it is full, as in
lazily built automata for regular expressions, so memory is bounded.

A prefix's encoding is found from shorter ones: its last token is the one vocabulary entry
that ends there and may follow the last token of what is before it (two tokens may stand
side by side exactly if encoding their joined string gives the two back).

Long texts are cut into chunks.  A chunk becomes a state map: the unfinished run at its
head (whose effect depends on the state in which the chunk is entered), the count of
everything between, and the run at its tail.  Maps compose associatively; `scanned`
composes them as the up-sweep of a prefix scan, and a run over many chunks goes through
each chunk's map of the entry states that it reaches.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizer's regular expressions see it (Unicode White_Space).
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
LETTER = regex.compile(r"\p{L}")
NUMBER = regex.compile(r"\p{N}")
CHUNK = 1 << 16
#: Longest run that is joined into one string when it ends, longest word whose count is remembered, state maps remembered within a run.
LONGEST_JOINED, LONGEST_WORD, MOST_MAPS = 1 << 17, 1 << 10, 1 << 12

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"


def byte_letters() -> list[str]:
    """The 256 letters that stand for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    out = [""] * 256
    for b in own:
        out[b] = chr(b)
    for k, b in enumerate(rest):
        out[b] = chr(256 + k)
    return out


class State:
    """A state and the transitions found so far: byte -> (next state, emitted change), final byte -> emitted change."""

    __slots__ = ("finals", "moves", "places", "tail")

    def __init__(self, tail: bytes, places: tuple):
        self.tail, self.places = tail, places
        self.moves: dict[int, tuple[State, int]] = {}
        self.finals: dict[int, int] = {}


class CountTransducer:
    """Token counts of single pre-tokens; see the module's description."""

    def __init__(self, definition: str, most_states: int = 200_000, most_words: int = 300_000):
        spec = json.loads(definition)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE definition with a word-end suffix is needed")
        self.suffix = model["end_of_word_suffix"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.inner: set[bytes] = set()
        self.final: set[bytes] = set()
        for token in model["vocab"]:
            ends = token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ends else token
            if all(c in byte_of for c in body):
                (self.final if ends else self.inner).add(bytes(byte_of[c] for c in body))
        self.prefixes = {t[:k] for t in self.inner | self.final for k in range(1, len(t) + 1)}
        self.longest = max(map(len, self.prefixes))
        self.pair_ok: dict = {}
        self.words: dict[bytes, int] = {}
        self.most_states, self.most_words = most_states, most_words
        self._empty_states()

    def _empty_states(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(b"", ((b"", 0),))

    def merge(self, body: bytes, final: bool) -> list[str]:
        """The encoding by its definition: merge the pair of lowest rank, leftmost first."""
        parts = [self.letters[b] for b in body]
        if final and parts:
            parts[-1] += self.suffix
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _may_follow(self, left: bytes, right: bytes, final: bool) -> bool:
        key = (left, right, final)
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) > 1_000_000:
                self.pair_ok.clear()
            want = [len(x) for x in (left, right) if x]
            got = self.merge(left + right, final)
            lengths = [len(p) for p in got]
            if final:
                lengths[-1] -= len(self.suffix)
            ok = self.pair_ok[key] = lengths == want
        return ok

    def _last_token(self, seen: bytes, places: tuple, final: bool) -> tuple[bytes, int]:
        """(last token, token count relative to the state's) once `seen` is read; places: per length back."""
        vocabulary = self.final if final else self.inner
        for length in range(min(len(seen), len(places)), 0, -1):
            token = seen[-length:]
            if token in vocabulary:
                left, count = places[length - 1]
                if self._may_follow(left, token, final):
                    return token, count + 1
        raise ValueError("the vocabulary lacks a single byte")

    def move(self, state: State, byte: int) -> tuple[State, int]:
        """Make the transition of `state` on an inner byte: (next state, emitted change)."""
        seen = state.tail + bytes((byte,))
        token, count = self._last_token(seen, state.places, False)
        while seen not in self.prefixes:
            seen = seen[1:]
        places = ((token, 0), *((t, c - count) for t, c in state.places[: len(seen)]))
        if len(self.states) >= self.most_states:
            self._empty_states()
        key = (seen, places)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(seen, places)
        state.moves[byte] = made = (target, count)
        return made

    def finish(self, state: State, byte: int) -> int:
        """Make the transition of `state` on the last byte: the emitted change."""
        state.finals[byte] = count = self._last_token(state.tail + bytes((byte,)), state.places, True)[1]
        return count

    def run(self, word: bytes) -> int:
        """The sum of what the transitions along a pre-token emit: its token count."""
        state, total = self.start, 0
        for byte in word[:-1]:
            made = state.moves.get(byte)
            state, emitted = made if made is not None else self.move(state, byte)
            total += emitted
        byte = word[-1]
        emitted = state.finals.get(byte)
        return total + (emitted if emitted is not None else self.finish(state, byte))

    def run_pieces(self, pieces: tuple[str, ...]) -> int:
        """The token count of one pre-token that comes in pieces.

        Each piece is a map from the state at its start to (state at its end, emitted count); of a map only the entries
        that are reached are made, and equal pieces share theirs, so that the whole text is never one string of bytes.
        """
        maps: dict[tuple[str, int], tuple[State, int, State]] = {}
        state, total = self.start, 0
        *inner, last = pieces
        last = last.encode()
        for piece in inner:
            known = maps.get((piece, id(state)))
            if known is None:
                entry, emitted = state, 0
                for byte in piece.encode():
                    made = state.moves.get(byte)
                    state, change = made if made is not None else self.move(state, byte)
                    emitted += change
                if len(maps) > MOST_MAPS:
                    maps.clear()
                known = maps[piece, id(entry)] = (state, emitted, entry)  # the entry state stays alive, so that its id stays its own
            state, emitted, _ = known
            total += emitted
        for byte in last[:-1]:
            made = state.moves.get(byte)
            state, change = made if made is not None else self.move(state, byte)
            total += change
        emitted = state.finals.get(last[-1])
        return total + (emitted if emitted is not None else self.finish(state, last[-1]))

    def count(self, word: bytes) -> int:
        if len(word) > LONGEST_WORD:
            return self.run(word)
        n = self.words.get(word)
        if n is None:
            if len(self.words) >= self.most_words:
                self.words.clear()
            n = self.words[word] = self.run(word)
        return n


def run_class(char: str) -> str:
    """L or O for characters that join runs, N for numbers, S for white space."""
    if LETTER.match(char):
        return "L"
    if NUMBER.match(char):
        return "N"
    return "S" if regex.match(f"[{SPACE}]", char) else "O"


def normal(text: str) -> str:
    """Canonical composition and lower case by single characters (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@dataclass
class ChunkMap:
    """State map of a piece of text: what its first run adds to the run before it, the count inside, and the run left open
    at its end.  Open runs are the pieces they came in.  `whole`: it is one unfinished run, held in `head` alone."""

    head: tuple[str, ...]
    inside: int
    tail: tuple[str, ...]
    whole: bool


def chunk_map(piece: str, machine: CountTransducer) -> ChunkMap:
    """The map of a normalised piece."""
    words = PRETOKEN.findall(piece)
    if not words:
        return ChunkMap((), 0, (), not piece)
    head = (words[0],) if piece.startswith(words[0]) and run_class(piece[0]) in "LO" else ()
    tail = (words[-1],) if piece.endswith(words[-1]) and run_class(piece[-1]) in "LO" else ()
    if head and len(words) == 1 and tail:
        return ChunkMap(head, 0, (), True)
    inner = words[len(head) : len(words) - len(tail)]
    return ChunkMap(head, sum(map(machine.count, (w.encode() for w in inner))), tail, False)


def closed(run: tuple[str, ...], machine: CountTransducer) -> int:
    """The count of a run that has ended."""
    if sum(map(len, run)) <= LONGEST_JOINED:
        return sum(machine.count(w.encode()) for w in PRETOKEN.findall("".join(run)))
    return machine.run_pieces(run)


def compose(a: ChunkMap, b: ChunkMap, machine: CountTransducer) -> ChunkMap:
    """First a, then b.  Runs that meet at the seam go through the transducer together."""
    if a.whole and not a.head:
        return b
    if b.whole and not b.head:
        return a
    left = a.head if a.whole else a.tail
    joins = bool(left) and bool(b.head) and run_class(left[-1][-1]) == run_class(b.head[0][0])
    if a.whole and b.whole:
        return ChunkMap(a.head + b.head, 0, (), True) if joins else ChunkMap(a.head, 0, b.head, False)
    if a.whole:
        return ChunkMap(a.head + b.head, b.inside, b.tail, False) if joins else ChunkMap(a.head, closed(b.head, machine) + b.inside, b.tail, False)
    if b.whole:
        return ChunkMap(a.head, a.inside, a.tail + b.head, False) if joins else ChunkMap(a.head, a.inside + closed(a.tail, machine), b.head, False)
    seam = closed(left + b.head, machine) if joins else closed(left, machine) + closed(b.head, machine)
    return ChunkMap(a.head, a.inside + seam + b.inside, b.tail, False)


def scanned(maps: Iterator[ChunkMap], machine: CountTransducer) -> ChunkMap:
    """The composition of all maps, as the up-sweep of a prefix scan: a balanced tree whose inputs go as soon as two of
    equal height meet, so that only one map of each height is held."""
    held: list[tuple[int, ChunkMap]] = []
    for one in maps:
        height = 0
        while held and held[-1][0] == height:
            one, height = compose(held.pop()[1], one, machine), height + 1
        held.append((height, one))
    total = ChunkMap((), 0, (), True)
    while held:
        total = compose(held.pop()[1], total, machine)
    return total


def cut_points(text: str, size: int) -> list[int]:
    """Where `text` may be cut near each multiple of `size`: between two ASCII characters (composition never
    crosses there), without an apostrophe near (contractions stay whole)."""
    cuts, at = [0], size
    while at < len(text):
        while at < len(text) and not (text[at - 1 : at + 1].isascii() and "'" not in text[max(0, at - 3) : at + 3]):
            at += 1
        if at < len(text):
            cuts.append(at)
        at += size
    return [*cuts, len(text)]


class TokenCounter:
    """Token counts of whole texts, as the tokenizer's library gives them by default without added tokens."""

    def __init__(self, definition: str, chunk: int = CHUNK):
        self.machine = CountTransducer(definition)
        self.chunk = chunk
        special = sorted(self.machine.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, chunks).  Special strings in the text are one token each."""
        if self.special is not None and any(s in text for s in self.machine.special):
            pieces = self.special.split(text)
            tokens, chunks = len(pieces) - 1, 0
        else:
            pieces, tokens, chunks = [text], 0, 0
        for piece in pieces:
            if len(piece) <= self.chunk:
                tokens += sum(map(self.machine.count, map(str.encode, PRETOKEN.findall(normal(piece)))))
                chunks += 1
            else:
                cuts = cut_points(piece, self.chunk)
                total = scanned((chunk_map(normal(piece[a:b]), self.machine) for a, b in zip(cuts, cuts[1:])), self.machine)
                tokens += closed(total.head, self.machine) + total.inside + closed(total.tail, self.machine)
                chunks += len(cuts) - 1
        return tokens, chunks


@lru_cache(maxsize=2)
def counter_of(definition: str) -> TokenCounter:
    """One counter per worker process and tokenizer, so that later tasks find states and words that are known already."""
    return TokenCounter(definition)


def count_tokens(documents: DataFrame, definition: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: doc_id, n_bytes, n_tokens, over_limit, n_chunks.

    `definition` is the tokenizer file's content (about 2 MB, read once on the driver).  Null
    and empty texts have 0 bytes and tokens; null ids stay null; repeated rows stay repeated;
    an empty table gives no rows; other columns, whatever their names, are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(definition)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [counter.count(t) for t in texts]
            tokens = [c[0] for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array([c[1] for c in counts], pa.int32())], schema=schema
            )

    columns = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return columns.mapInArrow(run, SCHEMA)
