import hashlib
import zlib
from collections import Counter

import cases
import pytest
from tidemark.llm import merkle as m
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, place int, path int"


def H(*x):  # noqa: N802
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append((level[other] if other < len(level) else None, k % 2))
        k //= 2
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf(*r) for r in sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for x in langs}
    over = tree([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for k, r in enumerate(sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))):
            way, now = path(trees[x], k) + path(over, n), leaf(*r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(*r[:4], r[4] + 1)
            for sibling, right in way:
                now = H(now) if sibling is None else H(sibling, now) if right else H(now, sibling)
            out.append((r[0], leaf(*r), trees[x][-1][0], over[-1][0], H(*[s for s, _ in way if s]), now, now == over[-1][0]))
    return Counter(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, m.documents_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def rows_of(n, langs):
    return [(k, f"text {k}", langs[k % len(langs)], "s", k) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 512, 513, 1025])
def test_sizes_of_one_group(spark, n):
    """Around whole blocks, where the tree gains a pass or ends in a run of one."""
    assert found(spark, rows_of(n, ["en"])) == brute(rows_of(n, ["en"]))


def test_many_passes(spark, monkeypatch):
    """Blocks of four leaves: four passes, more groups than a block holds, one group with most rows."""
    monkeypatch.setattr(m, "LEVELS", 2)
    monkeypatch.setattr(m, "BLOCK", 4)
    monkeypatch.setattr(m, "_STACK", m._STACK.replace("sequence(1, 8)", "sequence(1, 2)"))
    rows = rows_of(140, ["en"]) + [(k, "x", f"l{k % 23}", None, None) for k in range(140, 200)]
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (None, "a", "en", "s", 1), (None, "b", None, None, None), (5, None, None, "s", 3), (5, "", "", "", 0), (6, "é東京", "en", "s", 3), (6, "é東京", "en", "s", 3), (6, "other", "en", "s", 5),
        (-3, cases.LONG, "é", "s", len(cases.LONG)), (7, "x", "Z", "s", 2**63 - 1), *[(k, "y", None, "s", 2**63 - 1) for k in range(40)],
    ]
    assert found(spark, rows) == brute(rows)
    assert not found(spark, [])


def test_tampering_shows(spark, small):
    rows = QUERIES["op12_merkle"](spark, small).collect()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)
    assert 0 < sum(not r.verified for r in rows) < len(rows)


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in cases.table(spark, small, "documents").collect()]
    assert Counter(map(tuple, QUERIES["op12_merkle"](spark, small).collect())) == brute(docs)
