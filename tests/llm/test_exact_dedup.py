import hashlib
import re
from collections import Counter

import cases
import pytest
from tidemark.llm import exact_dedup as e
from tidemark.llm.queries import QUERIES


def plain(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute(rows):
    """(doc_id, keep_id, size, kept, sha) of each row; of equal rows any one may be the one that stays."""
    by = {}
    for k, (i, t) in enumerate(rows):
        by.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for text, own in by.items():
        best = min(own)
        out += [(rows[k][0], rows[best[3]][0], len(own), k == best[3], hashlib.sha256(text.encode()).hexdigest()) for *_, k in own]
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("bits,capacity,buffer", [(64, e.CAPACITY, e.BUFFER), (64, 60, 300), (8, 60, 1), (12, 1, 1 << 20)])
def test_awkward_rows(spark, bits, capacity, buffer):
    """Also with buckets that split to the last bit, hashes that collide, and a buffer of one text."""
    rows = [*cases.ROWS, *[(100 + k, f"a b {k % 40}" + " " * (k % 7)) for k in range(400)], *[(900 + k, " x \u0085") for k in range(3)]]
    assert found(e.groups(cases.docs(spark, rows), bits=bits, capacity=capacity, buffer=buffer)) == brute(rows)
    assert not found(e.groups(cases.docs(spark, []), bits=bits, capacity=capacity))


def test_hot_text(spark):
    rows = [(k, "one hot  text" if k % 3 else f"t {k % 50}") for k in range(3000)]
    assert found(e.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), capacity=100)) == brute(rows)


def test_directory_covers_every_key(spark):
    """Slots lie without gap or overlap below the buckets; no bucket that could split is overfull."""
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(2000)], "doc_id long, text string")
    entries = e.entries_of(docs, ["doc_id"], "text", 64, e.BUFFER).filter("body is not null").select("entry", "h", "body").cache()
    slots, depth, n = e.directory(entries, 1000)
    held = Counter()
    slot_of = {r.slot: r.bucket for r in slots.collect()}
    for r in entries.collect():
        held[slot_of[(r.h % (1 << 64)) >> (64 - depth)]] += len(r.body)
    assert len(held) == n > 40 and max(held.values()) <= 1000


def test_directory_passes_each_cell_on_once(spark):
    """No join below the cells: stored tables grow with cells alone, however often the directory doubles."""
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(2000)], "doc_id long, text string")
    entries = e.entries_of(docs, ["doc_id"], "text", 64, e.BUFFER).filter("body is not null").select("entry", "h", "body").cache()
    tables, kept = [], e.common.stored

    def stored(df, name):
        out = kept(df, name)
        tables.append((name, out.count(), df._jdf.queryExecution().optimizedPlan().toString().count("Join")))
        return out

    e.common.stored = stored
    try:
        depths = [(capacity, e.directory(entries, capacity)[1]) for capacity in (100_000, 1000, 100)]
    finally:
        e.common.stored = kept
    assert [d for _, d in depths] == sorted(d for _, d in depths) and depths[-1][1] > 8
    assert [name for name, *_ in tables] == ["cells", "splits", "buckets"] * 3
    assert all(joins == (name == "buckets") for name, _, joins in tables)


def test_deduplicated_keeps_columns(spark):
    docs = cases.docs(spark).withColumn("kept", cases.F.lit("old"))
    rows = e.deduplicated(docs)
    assert rows.columns == docs.columns and sorted(plain(r.text) for r in rows.collect()) == sorted({plain(t) for _, t in cases.ROWS})


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in cases.table(spark, small, "documents").collect()]
    got = found(QUERIES["op13_exact_dedup"](spark, small))
    assert got == brute(docs) and any(r[2] > 1 for r in got)
