import cases
import corpus_pipeline
import test_decontamination
import test_line_dedup
import test_simhash
import test_tokens
from tidemark.llm import common, toxicity


def test_stages_against_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    columns, before = docs.columns, docs
    items = [(r.item_id, r.text) for r in common.table(spark, small, "benchmark").collect()]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, before, small), f"test-{name}")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name != "packing":
            assert now.columns == columns
            after[name] = {r.doc_id: r.text for r in now.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, small).collect()}
            assert after[name].keys() == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
        if name == "line_dedup":
            test_line_dedup.learn(spark, rows)
            want = {i: new for (i, old), new in test_line_dedup.brute(rows).items() if new == old or (new or "").strip("\n\r\t ")}
            assert after[name] == want
        if name == "simhash":
            assert sorted(after[name].items(), key=repr) == test_simhash.one_each(rows) and now.count() == len(after[name])
        if name == "decontamination":
            assert after[name].keys() == {i for i, n, h, _ in test_decontamination.brute(rows, items) if not (h > 0 and 20 * h >= n)}
        if name == "packing":
            test_tokens._packed(spark, before, rows)
        before = now
    assert corpus_pipeline.run(spark, small).count() == before.count()


SENTENCES = [f"the {a} {b} goes over a {c} hill near the old {d} town" for a, b, c, d in zip("red green blue black".split(), "fox cow owl cat".split(), "low high far near".split(), "stone river lake wood".split(), strict=True)]
KINDS = "doc_id long, text string, lang string, source string, n_chars long, score string, items int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7, "own", 3) for i, t in rows], KINDS).repartition(3)


def texts(df):
    assert all(r.score == "own" and r["items"] == 3 for r in df.collect())
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_nulls_repeats_and_shared_ids(spark, small):
    """Each stage on rows without doc_id, repeated rows and one doc_id at two texts, against what it says of them."""
    stages = dict(corpus_pipeline.STAGES)
    a, b, c, _ = SENTENCES
    item = common.table(spark, small, "benchmark").filter("text IS NOT NULL").orderBy("item_id").first().text
    rows = [(6, a), (6, a), (None, a), (7, a), (8, a), (8, b), (None, None), (None, c), (9, ""), (9, "  ")]
    kept = texts(stages["simhash"](spark, rows_of(spark, rows), small))
    assert kept == sorted([(6, a), (8, b), (None, c), (9, "")], key=repr) or kept == sorted([(6, a), (8, b), (None, c), (9, "  ")], key=repr)
    rows = [(8, item), (8, b), (None, item), (None, b), (4, item), (4, item), (5, None), (5, "")]
    assert texts(stages["decontamination"](spark, rows_of(spark, rows), small)) == sorted([(8, b), (None, b), (5, None), (5, "")], key=repr)
    clean = [(8, b), (8, b), (None, b), (None, None), (5, "")]
    assert texts(stages["toxicity"](spark, rows_of(spark, clean), small)) == sorted(clean, key=repr)
    packed = stages["packing"](spark, rows_of(spark, clean), small).groupBy("sequence_id").count().collect()
    assert sum(r["count"] for r in packed) == len(clean)
    for name in ("toxicity", "line_dedup", "simhash", "decontamination", "packing"):
        assert stages[name](spark, rows_of(spark, clean).limit(0), small).count() == 0


def test_awkward_rows_pass_every_stage(spark, small):
    docs = cases.docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs.withColumn("n_chars", cases.F.lit(1).cast("long")), small), "test-stage")
        assert docs.count() > 0
    empty = cases.docs(spark, []).withColumn("n_chars", cases.F.lit(1).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        empty = common.stored(stage(spark, empty, small), "test-stage")
        assert empty.count() == 0
        empty = cases.docs(spark, []).withColumn("n_chars", cases.F.lit(1).cast("long"))
