import math
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, key long, q int"


def brute(rows, positives=5, negatives=3, relabel=True):
    known = []
    for k, (i, x, label) in enumerate(rows):
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            label = (label + 1) % 10 if relabel and i is not None and i % 7 == 0 else label
            known.append((k, i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, label, q in known:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, p, strict=False)), last(j), m, other, j) for m, j, other, p in known if m != k), key=lambda r: r[:3])
        for s, _, _, _, j in [r for r in scored if r[3] == label][:positives]:
            fit = [r for r in scored if r[3] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(i, j, n + 1, r[4], -s, -r[0]) for n, r in enumerate(fit[:negatives])]
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, h.mine(df, relabel=True, **more).collect()))


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(5, width))
    x = mids[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist()


@pytest.mark.parametrize("case", range(3))
def test_against_brute_force(spark, monkeypatch, case):
    """Few and many anchors a block, several batches and ranges, odd width, many ties."""
    monkeypatch.setattr(h, "ANCHORS", [1024, 3, 7][case])
    monkeypatch.setattr(h, "BATCH_ROWS", [16_384, 100, 64][case])
    monkeypatch.setattr(h, "PAIRS", [1 << 21, 200, 4096][case])
    rng = np.random.default_rng(case)
    x = vectors(900, [16, 7, 4][case], case, [1.0, 0.5, 0.2][case])
    x = [x[k // 3 * 3] if k % 4 else x[k] for k in range(900)]
    rows = [(int(i), v, int(rng.integers(0, 10))) for i, v in zip(rng.permutation(900), x, strict=True)]
    assert found(spark, rows) == Counter(brute(rows)) and sum(Counter(brute(rows)).values()) > 60


def test_hot_vector(spark):
    """A third of all rows hold one vector, under every label; nothing is dropped for it."""
    x = vectors(300, 8, 5)
    rows = [(k, x[0] if k % 3 else x[k], k % 4) for k in range(300)]
    assert found(spark, rows) == Counter(brute(rows))


def test_awkward_rows(spark):
    one, two, three = [0.5, 0.5, 0.25], [0.5, 0.25], [-0.5, 0.1, 0.0]
    rows = [
        (0, one, 1), (0, one, 1), (50, two, 2), (50, one, 2), (100, [], 1), (None, one, 1), (None, two, 2), (7, None, 1), (8, one, None), (9, [0.1, None, 0.2], 1),
        (10, [math.nan, 1.0, 1.0], 1), (11, [math.inf, 1.0], 2), (12, [0.4, 0.3, 0.1], 2), (13, [0.35, 0.3, 0.1], 1), (-50, three, 2), (-7, three, 1), (14, [0.3, 0.3], 3), (150, [0.0, 0.0, 0.0], 3), (16, [1.0], 3),
    ]
    assert found(spark, rows) == Counter(brute(rows)) and brute(rows)
    assert not found(spark, []) and not found(spark, [(1, one, 1)]) and not found(spark, [(50, one, 1)])


def test_large_components(spark):
    rows = [(k, [3e5 * (k % 13), 2e5 * (k % 7) + 0.5, 1e5], k % 3) for k in range(120)]
    assert found(spark, rows) == Counter(brute(rows))
    with pytest.raises(ValueError, match="64 bits"):
        found(spark, [(0, [3e30], 1), (1, [1.0], 1)])


def test_bounds_hold_and_filter():
    """Scores always lie within the bounds; on clustered vectors the bounds rule most rows out."""
    x = np.floor(256 * np.array(vectors(2000, 16, 9, 0.3))).astype(np.int64)
    books = h.codebooks(x[:500])
    codes, missed = h.encode(x, books)
    rows = type("R", (), {"codes": codes, "missed": missed, "q": x.astype(float)})
    low, high = h._Anchors(x[:20], books, np.float64).bounds(rows, slice(0, 2000))
    true = x[:20] @ x.T
    assert (low <= true).all() and (true <= high).all()
    assert (high >= np.sort(low, axis=1)[:, -6, None]).mean() < 0.2
