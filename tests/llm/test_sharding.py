import zlib
from collections import Counter

import pytest

import cases
from tidemark.llm import sharding


def check(got, rows, shards):
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert set(counts) <= set(range(shards)) and (not rows or max(sizes) - min(sizes) <= 1)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_awkward_rows(spark, shards):
    check(sharding.assign(cases.docs(spark), shards).collect(), cases.ROWS, shards)
    check(sharding.assign(cases.docs(spark, []), shards).collect(), [], shards)


def test_one_group_of_a_third_and_small_ones(spark):
    rows = [(k, "the same") for k in range(400)] + [(1000 + k, f"pair {k // 2}") for k in range(600)] + [(3000 + k, f"alone {k}") for k in range(200)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    check(got, rows, 16)
    at = {r.doc_id: r.shard for r in got}
    together = sum(at[1000 + 2 * k] == at[1001 + 2 * k] for k in range(300))
    assert together > 200  # 19 by chance


def test_query(spark, small):
    got = sharding.op9_sharding(spark, small).collect()
    check(got, [(r.doc_id, r.text) for r in cases.table(spark, small, "documents").collect()], 16)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
