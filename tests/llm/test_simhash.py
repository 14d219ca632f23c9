import random
import re

import xxhash

import cases
from tidemark.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component) by comparing all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return sorted(((rows[k][0], prints[k], least.get(root(k))) for k in range(len(rows))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    rows = [r if r[0] != 5 else (5, cases.LONG[:20_000]) for r in cases.ROWS]
    assert found(simhash.near_duplicates(cases.docs(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.docs(spark, [])).count() == 0


def test_against_all_pairs(spark, small):
    docs = cases.table(spark, small, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert found(simhash.near_duplicates(docs)) == want
    assert found(simhash.near_duplicates(docs, tile=2)) == want  # every block key is dealt into tiles


def test_rows_without_id_link_others(spark, monkeypatch):
    """0 - 7 - 63 with a null doc_id in the middle is one component; 2^40 and its neighbour have no doc_id at all."""
    texts = {"a": 0, "b": 7, "c": 63, "d": 1 << 40, "e": 1 << 40 | 1, "f": 0xFFFFFFFF << 20}
    monkeypatch.setitem(globals(), "fingerprint", lambda text: texts[text])
    rows = [(1, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "e"), (9, "f"), (9, "f"), (None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found_rows = spark.createDataFrame([(i, texts[t]) for i, t in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, shingle, key=None: found_rows)
    assert found(simhash.near_duplicates(docs)) == brute(rows)


def test_one_of_each(spark):
    """Repeated rows, null ids, and one doc_id at two unlike texts: exactly one row a component, and no unique text goes."""
    a, b, c = ("the quick brown fox jumps over the lazy dog", "an entirely different text about other things", "and here is a third one that nobody repeats")
    rows = [(6, a), (6, a), (None, a), (7, a), (8, a), (8, b), (None, c), (None, c), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", cases.F.lit("x")).repartition(3)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(6, a), (8, b), (None, c), (4, None)], key=repr)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_chain_of_links(spark):
    """Fingerprints 3 bits apart, one after another, are one component through their links."""
    chain, fp = [], 0
    for k in range(20):
        chain.append((fp, k))
        fp ^= 7 << (3 * k)
    signed = [(f - (1 << 64) if f >> 63 else f, k) for f, k in chain]
    links = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), tile=3)
    from tidemark.llm.components import components

    assert {(r.node, r.component) for r in components(links).collect()} == {(k, 0) for k in range(20)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def wide(text):
    """512 bits: of every word of 64, the majority of a splitmix64 step of each distinct shingle's hash."""
    full, hashes = (1 << 64) - 1, {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)}
    out = b""
    for word in range(1, 9):
        mixed = []
        for h in hashes:
            x = (h + word * 0x9E3779B97F4A7C15) & full
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
            mixed.append(x ^ (x >> 31))
        out += sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)).to_bytes(8, "little")
    return out


def brute_similar(rows):
    """Component number of every row, by comparing all pairs: 85 bits or fewer and an equal block of two bytes."""
    prints = [wide(t) for _, t in rows]
    numbers = [int.from_bytes(p, "little") for p in prints]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (numbers[a] ^ numbers[b]).bit_count() <= 85 and any(prints[a][k : k + 2] == prints[b][k : k + 2] for k in range(0, 64, 2)):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(rows))]


def one_each(rows):
    """Rows that stay, each the least doc_id of its component, nulls last; only for rows without ties."""
    best = {}
    for row, c in zip(rows, brute_similar(rows), strict=True):
        best[c] = min(best.get(c, row), row, key=lambda r: (r[0] is None, r[0] or 0))
    return sorted(best.values(), key=repr)


def copies(docs, share, copy_id):
    """Copies of texts of 60 words or more with words replaced at random."""
    rng = random.Random(7)
    out = []
    for i, text in docs:
        words = (text or "").split()
        if 60 <= len(words) <= 2000:
            out.append((copy_id + i, " ".join(f"swap{rng.random()}" if rng.random() < share else w for w in words)))
    return out


def test_one_of_similar_against_all_pairs(spark, small):
    docs = [(r.doc_id, r.text) for r in cases.table(spark, small, "documents").select("doc_id", "text").collect()]
    rows = docs + copies(docs[:60], 0.01, 10**6) + copies(docs[:60], 0.03, 2 * 10**6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = one_each(rows)
    for tile in (simhash.TILE, 2):  # with 2, every block is dealt into tiles
        assert sorted(((r.doc_id, r.text) for r in simhash.one_of_similar(df, tile=tile).collect()), key=repr) == want


def test_one_of_similar_recall(spark, small):
    """Nine in ten copies of a five-word similarity of 0.8 or more go, all texts unlike any other stay."""
    docs = [(r.doc_id, r.text) for r in cases.table(spark, small, "documents").select("doc_id", "text").collect()]
    sets = {i: shingles(t) for i, t in docs}
    planted = [c for share in (0.002, 0.01, 0.02) for c in copies(docs, share, (1 + int(share * 1000)) * 10**6)]
    close = {i for i, t in planted if len(s := shingles(t)) and len(s & sets[i % 10**6]) >= 0.8 * len(s | sets[i % 10**6])}
    kept = {r.doc_id for r in simhash.one_of_similar(spark.createDataFrame(docs + planted, "doc_id long, text string")).collect()}
    assert len(close) > 100 and len(close - kept) >= 0.95 * len(close)
    owner = {}
    for i, s in sets.items():
        for x in s:
            owner.setdefault(x, set()).add(i)
    alone = {i for i, s in sets.items() if s and all(len(owner[x]) == 1 for x in s)}
    assert alone and alone <= kept


def test_one_of_similar_awkward_rows(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog", "an entirely different text about other things", "and here is a third one that nobody repeats")
    rows = [(6, a), (6, a), (None, a), (7, a), (8, a), (8, b), (None, c), (None, c), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", cases.F.lit("x")).withColumn("fp", cases.F.lit(1)).repartition(3)
    got = simhash.one_of_similar(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(6, a), (8, b), (None, c), (4, None)], key=repr)
    assert simhash.one_of_similar(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, cases.LONG), (2, cases.LONG + " end"), (3, "end")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_similar(long).collect()) == [1, 3]
