"""Token counts against the tokenizer's own library."""

import os
import random

import pytest

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

from eligspark.llm.tokens import TokenCounter, chunk_map, compose, count_tokens, cut_points, normal, scanned  # noqa: E402

LETTERS = "abcdefgst'’.,!?- \n éÉeÉñΣσİıſK一二½Ⅷ3५🎉​\x1c\x85<|endoftext|>don't we'll I'd they'Re  ''s"


@pytest.fixture(scope="module")
def definition():
    with open(P.path("word_bpe_49k.json")) as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1 << 16, 40, 7])
def test_equals_library(definition, library, chunk):
    counter = TokenCounter(definition, chunk=chunk)
    texts = [*random_texts(800, chunk), "<|endoftext|>a<|startoftext|>", "'some", "''s", "a<|endoftext|", "ΑΣ ΟΔΟΣ", "", " ", "a" * 5000, "ab'll " * 900]
    assert [counter.count(t)[0] for t in texts] == [expected(library, t) for t in texts]


def test_states_are_bounded_and_rebuilt(definition, library):
    counter = TokenCounter(definition)
    counter.machine.most_states, counter.machine.most_words = 50, 20
    texts = random_texts(300, 5)
    assert [counter.count(t)[0] for t in texts] == [expected(library, t) for t in texts]
    assert len(counter.machine.states) <= 50 and len(counter.machine.words) <= 20


def test_composition_is_associative(definition):
    machine = TokenCounter(definition).machine
    for text in random_texts(100, 9):
        text = text.replace("'", "")
        cuts = cut_points(text, 9)
        maps = [chunk_map(normal(text[a:b]), machine) for a, b in zip(cuts, cuts[1:])]
        left = maps[0]
        for m in maps[1:]:
            left = compose(left, m, machine)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = compose(m, right, machine)
        assert left == right == scanned(iter(maps), machine)


def test_frame(spark, definition, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, "x"), (4, None), (5, ""), (6, "é" * 3000)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_tokens int")
    got = count_tokens(frame, definition, limit=5).collect()
    want = [(i, len((t or "").encode()), expected(library, t or "")) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert count_tokens(frame.limit(0), definition).count() == 0


def test_a_run_over_many_chunks_equals_the_library(definition, library, monkeypatch):
    from eligspark.llm import tokens

    monkeypatch.setattr(tokens, "LONGEST_JOINED", 200)
    rnd = random.Random(6)
    counter = TokenCounter(definition, chunk=97)
    texts = ["ab" * 3000, "".join(rnd.choice("abcdeéß") for _ in range(5000)), "=-" * 2000 + "abc " * 50 + "é" * 1500, "x" * 97 + "!" * 500 + "x" * 1000 + " end"]
    for text in texts:
        assert counter.count(text)[0] == expected(library, text)


def test_memory_of_one_very_long_run():
    """64 M characters that are one run stay under 500 MB, the text itself among them."""
    import subprocess
    import sys

    code = (
        "import resource, public_tokenizers; from eligspark.llm.tokens import TokenCounter; from eligspark.llm.queries import tokenizer_definition\n"
        "c = TokenCounter(tokenizer_definition()); c.count('warm up'); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "n = c.count('ab' * 32_000_000)[0]; print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    n, mb = map(int, out.stdout.split())
    assert n > 10_000_000 and mb < 500
