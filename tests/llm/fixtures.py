"""Small texts with what the operators have to cope with: nulls, empty and long texts, copies, near copies, ties, clashing columns."""

import random

SYLLABLES = "an the er in on re ti ou st ly ing ble és ión ge sch lle que ña ü".split()


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text) rows."""
    rnd = random.Random(seed)
    rows = [(k, prose(rnd, rnd.choice([3, 12, 40, 120, 300]))) for k in range(n)]
    passage = prose(rnd, 60)
    for k in range(0, n, 7):
        rows[k] = (k, rows[k][1] + " " + passage + " " + prose(rnd, 5))
    base = prose(rnd, 150)
    for k in range(8):
        words = base.split(" ")
        for _ in range(k):
            words[rnd.randrange(len(words))] = "xx" + str(k)
        rows.append((n + k, " ".join(words)))
    rows += [(n + 20, rows[3][1]), (n + 21, rows[3][1].upper()), (n + 22, None), (n + 23, ""), (n + 24, " \n\t "), (n + 25, "one"), (n + 26, "ab" * 4000), (n + 27, "du " * 300), (2, rows[2][1]), (None, rows[4][1]), (None, None)]
    return rows


def frame(spark, rows):
    """Rows with further columns whose names clash with what operators make."""
    return spark.createDataFrame([(i, t, "x", "src0", 5, 7, "law", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words int, law string, rate double")


def key(row):
    return tuple(map(str, row))
