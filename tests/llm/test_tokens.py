import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cases
from tidemark.llm import common, packing, token_files, tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    return Tokenizer.from_file(tokens.public_path(name))


@pytest.mark.parametrize("name", FILES)
def test_pieces_equal_the_library(spark, small, name):
    texts = [r.text for r in cases.table(spark, small, "documents").collect() if r.text] + [t for _, t in cases.ROWS if t]
    flat, counts = tokens.encoder(tokens.public_path(name)).encode([t.encode() for t in texts], 1)
    want = [[*e.ids, 1] for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [x for ids in want for x in ids]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abAB'é東 \n\t.,!1290-ßÀ×<|> ll")), max_size=30), min_size=1, max_size=4))
def test_pieces_equal_the_library_on_odd_texts(name, texts):
    flat, counts = tokens.encoder(tokens.public_path(name)).encode([t.encode() for t in texts], 0)
    want = [[*e.ids, 0] for e in library(name).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [x for ids in want for x in ids]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _packed(spark, docs, rows):
    pieces = packing.pack(docs, tokens.public_path(FILES[0]), end_id=1, group_tokens=100_000).collect()
    encode = library(FILES[0])
    want = sorted(([*encode.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows), key=repr)
    sequences, whole = {}, {}
    for p in pieces:
        assert len(p["ids"]) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    single = [p for p in pieces if p.length == p.doc_tokens]
    for p in pieces:
        if p.length != p.doc_tokens:
            whole.setdefault(p.doc_id, []).append((p.start, p["ids"]))
    got = [list(p["ids"]) for p in single] + [[x for _, ids in sorted(parts) for x in ids] for parts in whole.values()]
    assert sorted(got, key=repr) == want
    return len(sequences), sum(map(len, want))


def test_packing_awkward_rows(spark):
    _packed(spark, cases.docs(spark), cases.ROWS)
    assert packing.pack(cases.docs(spark, []), tokens.public_path(FILES[0]), 1).count() == 0


def test_packing_leaves_little_padding(spark, medium):
    docs = cases.table(spark, medium, "documents")
    rows = packing.pack(docs, tokens.public_path(FILES[0]), 1).agg(cases.F.sum("length").alias("n"), cases.F.count_distinct("sequence_id").alias("s")).first()
    assert rows.n / (rows.s * 2048) > 0.98
    _packed(spark, cases.table(spark, medium, "documents").limit(150), [(r.doc_id, r.text) for r in docs.limit(150).collect()])


def test_best_fit_takes_the_tightest_window():
    place, offset, used = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert used == 2 and place.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]


def test_sequences_are_padded(spark):
    out = packing.sequences(packing.pack(cases.docs(spark), tokens.public_path(FILES[0]), 1)).collect()
    assert all(len(r["ids"]) == len(r["mask"]) == len(r["positions"]) == 2048 for r in out)


def _files(spark, docs, rows):
    encode = library(FILES[1])
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    manifest = token_files.write_token_files(docs, common.fresh_dir(spark, "arrow"), tokens.public_path(FILES[1]), end_id=0, row_length=64, rows_per_batch=4)
    assert sorted(map(tuple, token_files.read_documents(manifest).collect()), key=repr) == sorted(want, key=repr)
    return manifest


def test_token_files_awkward_rows(spark):
    manifest = _files(spark, cases.docs(spark), cases.ROWS)
    path = max(manifest.collect(), key=lambda r: r.n_ids).path
    file = token_files.TokenFile(path)
    flat = np.concatenate([file.ids(k) for k in range(file.batches)])
    ids, mask = file.row(2)
    assert ids.tolist() == flat[128:192].tolist() and mask.all()
    _files(spark, cases.docs(spark, []), [])


def test_token_files_query(spark, small):
    docs = cases.table(spark, small, "documents")
    _files(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_other_rules_are_encoded_whole(spark, tmp_path):
    """A file whose split rules are not the known ones: pieces would give wrong ids, so the library takes whole texts."""
    rules = json.loads(open(tokens.public_path(FILES[1])).read())
    rules["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    assert tokens.PieceEncoder(tokens.public_path(FILES[1])).cuts and tokens.PieceEncoder(tokens.public_path(FILES[0])).cuts
    encoder = tokens.PieceEncoder(str(path))
    assert not encoder.cuts
    texts = ["Alpha beta, gamma's", "", "x"]
    flat, counts = encoder.encode([t.encode() for t in texts], 7)
    want = [[*encoder._library.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_ids_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="write them wide"):
        token_files.write_token_files(cases.docs(spark), common.fresh_dir(spark, "arrow"), tokens.public_path(FILES[1]), end_id=70_000)
