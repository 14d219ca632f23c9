import os
import re

import cases
import pytest
import xxhash

from tidemark.llm import line_dedup as d

PASSAGE = "".join(f"This is shared sentence number {k} of the planted passage, which many documents hold. " for k in range(12))
WIDE = 2**64 - 1
BLANK = bytes(range(33))


def mixed(x):
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & WIDE
    return x ^ (x >> 29)


def line_hash(text):
    if len(text) > d.LONG:
        return xxhash.xxh64_intdigest(text)
    h = len(text) * 0xD6E8FEB86659FD93 & WIDE
    for k in range(0, max(1, len(text)), 8):
        h = (h ^ int.from_bytes(text[k : k + 8], "little")) * 0x9E3779B97F4A7C15 & WIDE
        h ^= h >> 29
        h = h * 0xC2B2AE3D27D4EB4F & WIDE
        h ^= h >> 32
    return h


def chunks(text):
    """[(start, stop, lines)] of the chunks of a text, word by word and line by line, as the module's docstring has it."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x20]+", text)]
    sentences = []
    for k, (a, _) in enumerate(words):
        if not k or text[words[k - 1][1] - 1 : words[k - 1][1]] in (b".", b"!", b"?") or b"\n" in text[words[k - 1][1] : a]:
            sentences.append([])
        sentences[-1].append(words[k])
    lines = []
    for s in sentences:
        rank = [mixed(int.from_bytes(text[max(a, b - 8) : b], "little") * 0xD6E8FEB86659FD93 & WIDE) for a, b in s]
        ends = [k for k in range(1, len(s) - 1) if rank[k - 1] > rank[k] <= rank[k + 1]]
        lines += [(s[a][0], s[b][1]) for a, b in zip([0, *[k + 1 for k in ends]], [*ends, len(s) - 1], strict=True)]
    h = [line_hash(text[a:b]) for a, b in lines]
    rank = [mixed((h[k] + (h[k - 1] * 0x9E3779B97F4A7C15 if k else 0)) & WIDE) for k in range(len(h))]
    ends = [k for k in range(1, len(h) - 1) if rank[k - 1] > rank[k] <= rank[k + 1]]
    spans = zip([0, *[k + 1 for k in ends]], [*ends, len(lines) - 1], strict=True) if lines else ()
    return [(lines[a][0], lines[b][1], b - a + 1) for a, b in spans]


def brute(rows, min_words=d.MIN_WORDS):
    """{(doc_id, text): text without what stands elsewhere and earlier}, by dictionaries over whole texts."""
    own, places = {}, {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        place = (-(2**63) if doc_id is None else doc_id, HASHES[text])
        own[place] = raw, chunks(raw), (doc_id, text)
    for doc_id, text in rows:  # repeated rows count
        place = (-(2**63) if doc_id is None else doc_id, HASHES[text])
        for k, (a, b, n) in enumerate(own[place][1]):
            if n > 1:
                places.setdefault(own[place][0][a:b], []).append((*place, k))
    out = {}
    for place, (raw, parts, key) in own.items():
        moved = {}
        for k, (a, b, n) in enumerate(parts):
            first = min(places.get(raw[a:b], [(*place, k)]))
            if n > 1 and first != (*place, k):
                moved[k] = first
        gone, k = set(), 0
        starts = [m.start() for m in re.finditer(rb"(?<![^\x00-\x20])[^\x00-\x20]", raw)]
        while k < len(parts):
            if k not in moved:
                k += 1
                continue
            last = k
            while last + 1 in moved and moved[last + 1] == (*moved[last][:2], moved[last][2] + 1):
                last += 1
            gone |= spanned(raw, parts, k, last, own[moved[k][:2]], moved[k][2], moved[last][2], starts, min_words)
            k = last + 1
        out[key] = None if key[1] is None else without(raw, gone, starts).decode()
    return out


def spanned(raw, parts, k, last, first, there_k, there_last, starts, min_words):
    other, theirs, _ = first
    a, b = parts[k][0], parts[last][1]
    at, to = theirs[there_k][0], theirs[there_last][1]
    low = max(theirs[max(0, there_k - d.BESIDE)][0], at - d.BESIDE_BYTES)
    up = there_last + d.BESIDE + 1
    high = min(theirs[up][0] if up < len(theirs) else len(other), to + d.BESIDE_BYTES)
    n = 0
    while a - n > 0 and at - n > low and raw[a - n - 1] == other[at - n - 1]:
        n += 1
    begin = min(x for x in starts if x >= a - n and (x > a - n or not n or at - n == 0 or other[at - n - 1] in BLANK or (at - n == low and at - low < d.BESIDE_BYTES)))
    n = 0
    while b + n < len(raw) and to + n < high and raw[b + n] == other[to + n]:
        n += 1
    ends = [m.end() for m in re.finditer(rb"[^\x00-\x20]+", raw)]
    stop = max(x for x in ends if x <= b + n and (x < b + n or not n or to + n >= len(other) or other[to + n] in BLANK))
    words = {x for x in starts if begin <= x < stop}
    return words if len(words) >= min_words else set()


def without(raw, gone, starts):
    """raw without those words; see _cut for what goes with them."""
    out, k = b"", 0
    ends = [m.end() for m in re.finditer(rb"[^\x00-\x20]+", raw)]
    gaps = [raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)]
    out = gaps[0]
    while k < len(starts):
        if starts[k] not in gone:
            out += raw[starts[k] : ends[k]] + gaps[k + 1]
            k += 1
            continue
        first = k
        while k < len(starts) and starts[k] in gone:
            k += 1
        if first and b"\n" in gaps[k] and b"\n" not in gaps[first]:
            out = out[: len(out) - len(gaps[first])] + gaps[k]
    return out


HASHES = {}


def learn(spark, rows):
    texts = sorted({t for _, t in rows if t is not None})
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    HASHES.update({r.t: r.h for r in table.select("t", cases.F.xxhash64("t").alias("h")).collect()})
    HASHES[None] = spark.range(1).select(cases.F.xxhash64(cases.F.lit(None).cast("string")).alias("h")).first().h


def check(spark, rows, docs, **more):
    learn(spark, rows)
    want = brute(rows)
    got = d.dedup_lines(docs.withColumn("was", cases.F.col("text")), **more).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id, r.was]
        assert r.removed_chunks <= r.n_chunks and r.removed_lines <= r.n_lines
    return got


def test_awkward_rows(spark):
    rows = [*cases.ROWS, (20, f"Own begin. {PASSAGE}Own end."), (21, PASSAGE), (22, f"Other words before it! {PASSAGE}"), (23, PASSAGE + PASSAGE), (24, f"x\n{PASSAGE}\n\ny")]
    rows = [r if r[1] is None else (r[0], r[1][:60_000]) for r in rows]
    got = check(spark, rows, cases.docs(spark, rows))
    assert sum(r.removed_chunks > 0 for r in got if r.doc_id in (21, 22, 23, 24)) == 4
    check(spark, rows, cases.docs(spark, rows), bits=64)  # a filter that lets nearly all through changes nothing
    check(spark, rows, cases.docs(spark, rows), bits=0)  # nor does the join on hashes
    assert d.dedup_lines(cases.docs(spark, [])).count() == 0
    assert d.dedup_lines(cases.docs(spark, []), bits=0).count() == 0


def test_very_long_text(spark):
    got = {r.doc_id: r for r in d.dedup_lines(cases.docs(spark, [(1, cases.LONG), (2, "Own words. " + cases.LONG)])).collect()}
    assert got[1].text == cases.LONG and got[2].text.strip() == "Own words."


@pytest.mark.parametrize("bits", [d.FILTER_BITS, 0])
def test_table(spark, small, bits):
    docs = cases.table(spark, small, "documents").select("doc_id", "text")
    got = check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs, bits=bits)
    assert any(r.removed_chunks for r in got)


def test_chunks_have_several_lines_and_survive_insertion():
    shared = "".join(f"Sentence {k} says {k * k} to all of them. " for k in range(200)).encode()
    c = d.chunk([b"", shared, b"Something new first. And more! " + shared, b"one", os.urandom(3000)])
    body = [{c.block.raw[a:b] for a, b, o in zip(c.start, c.stop, c.owner, strict=True) if o == k} for k in range(5)]
    assert len(body[1] & body[2]) >= len(body[1]) - 2 and not body[0] and body[3] == {b"one"}
    last = [k for k in range(len(c.owner)) if k + 1 == len(c.owner) or c.owner[k + 1] != c.owner[k]]
    assert all(n > 1 or k in last for k, n in enumerate(c.lines))


def test_one_shared_line_stays(spark):
    line = "all of these eleven words stand in three quite unlike documents."
    texts = [f"{''.join(f'{w} number {k} of {w}s. ' for k in range(30))}{line} {''.join(f'{w} then {k}. ' for k in range(30))}" for w in ("apple", "river", "stone")]
    got = d.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(texts))
