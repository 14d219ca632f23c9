import hashlib
import re

import cases
from tidemark.llm import decontamination as d
from tidemark.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(None if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, seen = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    seen |= got
        out.append((doc_id, len(w), len(hit), sorted(seen, key=lambda i: (i is None, i or ""))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.hit_words, list(r["items"])) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    items = [(1, "word5 of sentence 5 word6 OF sentence 6"), (2, None), (3, ""), (4, "b c"), (4, "x Y z"), (5, "delta-says,no REALLY")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", cases.F.lit(1))
    for shard, query in ((1 << 20, 1 << 20), (64, 8)):
        assert found(d.contamination(cases.docs(spark), table, shard_bytes=shard, query_bytes=query)) == brute(cases.ROWS, items)
    assert d.contamination(cases.docs(spark, []), table).count() == 0
    none = d.contamination(cases.docs(spark), table.limit(0)).collect()
    assert len(none) == len(cases.ROWS) and all(r.hit_words == 0 for r in none)


def test_null_and_textual_ids(spark):
    """Two items share a window, one of them without an id; ids may be any text; a document without an id keeps its row."""
    for items, kind in (([(1, "b c d"), (None, "b c d"), (None, "c d e"), (10, "b c d")], "long"), ([("x-1", "b c d"), (None, "B c D"), ("x-10", "b c d"), ("x-1", "c d e")], "string")):
        table = spark.createDataFrame(items, f"item_id {kind}, text string")
        docs = [(1, "a b c d e"), (None, "b c d"), (None, None), (1, "a b c d e"), (2, "c d")]
        assert found(d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), table)) == brute(docs, items)


def test_kept_columns(spark):
    docs = cases.docs(spark).withColumn("items", cases.F.lit("old"))
    got = d.contamination(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"), keep=docs.columns)
    assert set(got.columns) == {*docs.columns, *d.FOUND.names} and sorted(r.text or "" for r in got.collect()) == sorted(t or "" for _, t in cases.ROWS)


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in cases.table(spark, small, "documents").collect()]
    items = [(r.item_id, r.text) for r in cases.table(spark, small, "benchmark").collect()]
    want = [(i, n, h, len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, s in brute(docs, items)]
    got = sorted((tuple(r) for r in QUERIES["op2_decontamination"](spark, small).collect()), key=repr)
    assert got == sorted(want, key=repr) and any(r[5] for r in got)


def test_spans_cover_what_is_hit(spark):
    row = d.contamination(spark.createDataFrame([(1, "so it said: One two three, four! end")], "doc_id long, text string"), spark.createDataFrame([(9, "one TWO three four")], "item_id long, text string")).first()
    (span,) = row.spans
    assert "so it said: One two three, four! end"[span.start : span.stop] == "One two three, four"
