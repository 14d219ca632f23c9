import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from tidemark.llm import avi


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
def test_round_trip(texts):
    for text, data in zip(texts, avi.encode_texts(texts), strict=True):
        frames, size, n = avi.read_avi(data)
        samples = avi._unpack_blocks(np.frombuffer(b"".join(map(avi._scan_data, frames)), np.uint8).reshape(-1, 72))
        assert samples.tobytes()[:size] == avi.payload_of(text) and n == len(text) and size % 64 == 0 and size


def test_awkward_rows(spark):
    got = avi.decode(avi.encode(cases.docs(spark))).collect()
    assert len(got) == len(cases.ROWS)
    by_id = {}
    for doc_id, text in cases.ROWS:
        by_id.setdefault(doc_id, []).append((text or "").encode())
    for r in got:
        payload = avi.payload_of(by_id[r.doc_id][0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(by_id[r.doc_id][0]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert sum(c.frames for c in r.clips) == r.n_frames and [c.first_frame for c in r.clips] == np.cumsum([0] + [c.frames for c in r.clips])[:-1].tolist()
    assert avi.decode(avi.encode(cases.docs(spark, []))).count() == 0
    assert avi.decode(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()[0].n_bytes is None


def test_query(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in cases.table(spark, small, "documents").collect()}
    media = {r.doc_id: r.media for r in avi.encode(cases.table(spark, small, "documents")).collect()}
    got = avi.op6_avi_media(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        payload = avi.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_sha256, r.media_bytes, r.media_sha256) == (len(texts[r.doc_id]), hashlib.sha256(payload).hexdigest(), len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest())


def test_a_cut_between_unlike_scenes(spark):
    scenes = b"a" * (avi.FRAME_BYTES * 6) + bytes(range(256)) * (avi.FRAME_BYTES * 6 // 256)
    row = avi.decode(spark.createDataFrame([(1, scenes.decode("latin-1"))], "doc_id long, text string").transform(avi.encode)).first()
    assert row.clips[0].first_frame == 0 and row.clips[0].frames == 6 and len(row.clips) >= 2
