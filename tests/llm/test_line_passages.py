import random

import pytest

from tidemark.llm import line_dedup as d

MADE = random.Random(5)
VOCABULARY = ["".join(MADE.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(MADE.randint(3, 9))) for _ in range(5000)]
COPIES = 8


def prose(words, lengths, end=". "):
    """words made-up words in sentences of a length from lengths; the last may be shorter."""
    out = []
    while words:
        n = min(words, MADE.choice(lengths))
        out.append(" ".join(MADE.choice(VOCABULARY) for _ in range(n)).capitalize())
        words -= n
    return end.join(out) + end


#: name -> (sentences of the passage, what ends them, what stands before them, least share of words of later copies that goes)
KINDS = {
    "sentences": (range(10, 25), ". ", "", 0.99),
    "short sentences": (range(4, 9), ". ", "", 0.99),
    "lines": (range(12, 20), "\n", "\n", 0.99),
    "one line": ([200], "\n", "\n", 0.99),
    "one sentence": ([200], ". ", "", 0.99),
    "inside a sentence": ([200], " ", "open", 0.99),
}


@pytest.mark.parametrize("kind", KINDS)
def test_planted_passages_go(spark, kind):
    lengths, end, before, least = KINDS[kind]
    rows, words = [], 0
    for k in range(30):
        n = 51 + k * 69 // 29
        passage = prose(n, lengths, end)
        for _ in range(COPIES):
            own = prose(40, range(5, 20))
            rows.append((len(rows), own.removesuffix(". ") + " " if before == "open" else own + before, passage, prose(40, range(5, 20))))
        words += n * (COPIES - 1)
    docs = spark.createDataFrame([(i, a + p + b) for i, a, p, b in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in d.dedup_lines(docs).collect()}
    gone = 0
    for i, a, p, b in rows:
        gone += len((a + p + b).split()) - len(got[i].split())
        if i % COPIES == 0:
            assert got[i] == a + p + b  # the first copy stays whole
        assert set(a.split()) | set(b.split()) <= set(got[i].split())  # what is not shared stays
    assert gone >= least * words
