import test_pseudonyms as base
from tidemark.llm import pseudonyms as p

ROWS = [(5, "+1 (017) 555-7713"), (6, "+1-117-555-7713"), (7, "(099) 555-7713")]


def test_any_area_code_in_full_format(spark):
    got = base.run(spark, ROWS)
    assert all(got[i].n_phone == 1 and base.shape(got[i].text) == base.shape(t) and got[i].text != t for i, t in ROWS)
    done = p.pseudonymise(spark.createDataFrame(ROWS, "doc_id long, text string"), key="k")
    assert sorted(map(tuple, p.restore(done.select("doc_id", "text"), key="k").select("doc_id", "text").collect())) == sorted(ROWS)
