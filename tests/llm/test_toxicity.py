import bisect
from pathlib import Path

import cases
from tidemark.llm import common, toxicity


def measured(spark, folder):
    """(labels, scores and predictions of labelled rows that nothing was learned from) by language."""
    labels, docs = (common.table(spark, folder, t) for t in ("labels", "documents"))
    rows = toxicity.op1_toxicity(spark, folder).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    return rows


def share(rows, toxic):
    return sum(r.predicted for r in rows if r.toxic == toxic) / sum(r.toxic == toxic for r in rows)


def test_held_out_accuracy(spark, small):
    """Four thousand labels: nine of ten toxic texts in all, and most in every language; two of a hundred clean ones at most."""
    rows = measured(spark, str(Path(small).parent / "sf0.1"))
    assert share(rows, 1) >= 0.9 and share(rows, 0) <= 0.02
    for lang in {r.lang for r in rows}:
        assert share([r for r in rows if r.lang == lang], 1) >= 0.8
    order = sorted(r.score for r in rows if not r.toxic)
    toxic = [r.score for r in rows if r.toxic]
    assert sum(bisect.bisect_left(order, x) + bisect.bisect_right(order, x) for x in toxic) / 2 / (len(toxic) * len(order)) > 0.95


def test_few_labels_leave_clean_documents_alone(spark, medium):
    assert share(measured(spark, medium), 0) <= 0.02


def test_dictionaries_are_trained(spark, small):
    """Both begin with the magic number of a trained zstandard dictionary and hold what their texts repeat."""
    toxic = [f"the grumbolt {k} went to zarkon{k % 7} with all of the people".encode() for k in range(60)]
    plain = [f"the people {k} went to garden{k % 7} with all of the trees".encode() for k in range(120)]
    model = toxicity.fit([*((t, 1) for t in toxic), *((t, 0) for t in plain)], {1: 60, 0: 120})
    assert model.toxic[:4] == model.ordinary[:4] == (0xEC30A437).to_bytes(4, "little")
    assert toxicity._placed(b" grumbol")[:8] in model.toxic and toxicity._placed(b" grumbol")[:8] not in model.ordinary
    scores = model.scores([b"a grumbolt is there", b"a garden is there", b""])
    assert scores[0] > max(scores[1:])


def test_awkward_rows(spark, small):
    model = toxicity.trained(common.table(spark, small, "documents"), common.table(spark, small, "labels"))
    docs = cases.docs(spark)
    got = toxicity.score(docs, model)
    assert set(got.columns) == set(docs.columns) and got.count() == len(cases.ROWS)
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert toxicity.score(cases.docs(spark, []), model).count() == 0


def test_no_labels_give_a_flat_score(spark):
    docs = cases.docs(spark, clash=False)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score(docs, toxicity.trained(docs, labels)).collect()}
    assert len(scores) == 1
    odd = spark.createDataFrame([(1, 1), (None, 1), (2, None), (5, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.trained(docs, odd)).count() == len(cases.ROWS)


def test_labels_of_held_out_rows_have_no_part(spark, small):
    docs, labels = common.table(spark, small, "documents"), common.table(spark, small, "labels")
    turned = labels.withColumn("toxic", cases.F.when(toxicity.held_out(), 1 - cases.F.col("toxic")).otherwise(cases.F.col("toxic")))
    a, b = (toxicity.trained(docs, x) for x in (labels, turned))
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and a.bias == b.bias and (a.weights == b.weights).all()


def test_a_text_that_does_not_fit_hides_no_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5000)
    docs = spark.createDataFrame([(k, f"words of text {k} " + "long " * (2000 if k == 7 else 1)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    pairs, counts = toxicity.sample(docs, labels)
    assert len(pairs) == 59 and not any(b"text 7 " in t for t, _ in pairs) and counts == {0: 30, 1: 30}
