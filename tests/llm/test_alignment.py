"""Alignment against plain Python over the libraries' own output."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eligspark.llm import alignment
from eligspark.llm.queries import ALIGNED, tokenizer_definition, tokenizer_model
from tests.llm.fixtures import documents, frame, key

A, B = tokenizer_definition(ALIGNED[0]), tokenizer_model(ALIGNED[1])


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path(ALIGNED[0]))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ALIGNED[1]))
    chars = {c: bytes((x,)) for c, x in alignment.byte_of_char().items()}

    def groups(text):
        """[(A ids, B ids)] of space + text, or None where it has no tokens."""
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [b"".join(chars[c] for c in a.id_to_token(k)) for k in ids_a]
        raw_b = [bytes((int(b.id_to_piece(k)[3:5], 16),)) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return None
        ends = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for x in raw:
                at += len(x)
                own.append(at)
            ends.append(own)
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            out.append((ids_a[i:p], ids_b[j:q]))
            i, j = p, q
        return out

    return groups


def digest(groups):
    return hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest()


def brute(rows, plain):
    found = [plain(t) for _, t in rows]
    linked = [Counter((u, v) for x, y in g or () for u in x for v in y) for g in found]
    count = Counter(p for c in linked for p in c)
    top = defaultdict(int)
    for (u, _), n in count.items():
        top[u] = max(top[u], n)
    out = []
    for (i, _), g, c in zip(rows, found, linked):
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(n for (u, v), n in c.items() if count[u, v] == top[u])
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(count[p] * n for p, n in c.items()), digest(g)))
    return sorted(map(key, out))


EXTRA = [(500, "  two  spaces \n lines\n\n and\ttabs "), (501, "a▁b"), (502, "<|endoftext|> <s> <unk> <0x41>"), (503, "日本語 のテキスト und ÄÖÜ 😀😀"), (504, "x\0y z"), (505, "=" * 3000 + " " + "ab" * 3000), (506, "don't we'll I'm 12345 1,234.5"), (507, " "), (508, " a  b　c")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 700])
def test_against_brute_force(spark, plain, most):
    rows = documents(5, 25) + EXTRA
    got = alignment.align(frame(spark, rows).repartition(3), A, B, most_pairs=most).select(*COLUMNS).collect()
    assert sorted(map(key, got)) == brute(rows, plain)


def test_empty(spark):
    got = alignment.align(frame(spark, []), A, B)
    assert got.count() == 0 and got.columns[0] == "doc_id"


def test_bounded_memory_of_segments(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_SEGMENTS", 50)
    aligner = alignment.Aligner(A, B)
    texts = [t for _, t in documents(6, 12) if t]
    for _ in range(2):
        for t in texts:
            g = plain(t)
            assert aligner.texts([t])[0][2:5] == (len(g), sum(len(x) * len(y) for x, y in g), digest(g))
            assert len(aligner.text) <= 50 + len(t)


ALIGNER = alignment.Aligner(A, B)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,'aAbBeEtTß€éñ0123▁\x00 😀")), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_any_text(plain, texts):
    for t, row in zip(texts, ALIGNER.texts(texts)):
        g = plain(t)
        assert row[2:5] == ((len(g), sum(len(x) * len(y) for x, y in g), digest(g)) if g else (0, 0, ""))
