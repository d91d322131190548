"""Queries without an SQL oracle against brute force over whole small tables."""

import re
import sys
import unicodedata

from eligspark.plans.catalogue import QUERIES

#: (doc_id, text): nulls, blanks, lists in several scripts, long runs, repeated rows and ids.
TEXTS = [
    (1, "one. Two; three"), (2, None), (3, ""), (4, " \n\t "), (5, "ab" * 4000), (6, "du " * 300), (7, "Écru. Éa; élan, ST"), (8, "que ñandú.\n1) ß über ge. Sch lle"), (9, "the an er\nin on; Re ti.\n• ou st"), (9, "the an er\nin on; Re ti.\n• ou st"), (None, "null id; Here"), (None, None),
]

UPPER = "[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Lu") + "]"
SPLITS = (r"\s*[•\n]\s*", r"(?:^|(?<=\s))\d{1,2}[.)]\s+", rf"(?<=[.;])\s+(?={UPPER})", rf"(?<=[a-z)])(?={UPPER}[a-z]{{2}})")


def listed(text):
    """X30 in plain Python."""
    parts = [text or ""]
    for pattern in SPLITS:
        parts = [x for p in parts for x in re.split(pattern, p, flags=re.ASCII)]
    parts = [x.strip(" .;,:-") for x in parts]
    return {x for x in parts if len(x) >= 3 and x.lower() not in ("document", "documents", "documents required", "list of documents")}


def test_doc_list_split(spark, tmp_path):
    lines = ["Documents required:", "1. Aadhaar card", "2) Bank passbook. Voter card; Élan pass", "• Photo • ab", "aadhaarCard", "Photo"]
    rows = [*TEXTS, *[(k, "\n".join(f"{line} {k % 3}" if k % 2 else line for line in lines * (k % 5)) + "\nlast") for k in range(200, 240)], (300, "x\n" * 500 + "far down")]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.n_items) for r in QUERIES["doc_list_split"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, len(listed(t))) for i, t in rows), key=str)
