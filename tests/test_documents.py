"""Canonical JSON on the JVM against the Python form, closed shapes, envelopes, account documents, re-checks."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tidemark.functions import canonical, shapes
from tidemark.functions.documents import canonical as plain
from tidemark.functions.documents import seal_of
from tidemark.operators import rechecks
from tidemark.operators.features import FEATURES
from tidemark.sources import accounts, envelopes


def test_numbers_equal_the_python_form(spark):
    rng = random.Random(3)
    xs = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20_000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 24) for _ in range(20_000)] + [round(rng.uniform(-1e6, 1e6), rng.randint(0, 6)) for _ in range(20_000)]
    xs += [0.0, -0.0, 1e16, 9999999999999998.0, 1e15, 1e-4, 9.999e-5, 1e-5, 5e-324, 1.7976931348623157e308, 8.41e21, 2e-3, 1e23, 2.0**-44, 9007199254740993.0, 0.1 + 0.2]
    xs = [x for x in xs if math.isfinite(x)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", canonical.number(F.col("x")).alias("s")).collect()
    assert [r.s for r in got if r.s != repr(r.x)] == []
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(math.nan,)], "x double").select(canonical.number(F.col("x"))).collect()


def test_values_equal_the_python_form(spark):
    schema = "b struct<z: string, a: array<double>, m: map<string, int>, l: array<struct<y: boolean, x: bigint>>>, a string, d decimal(18,8)"
    texts = ["", 'quote " back \\ slash /', "".join(map(chr, range(40))), "é 東京 \U0001f600 \x7f ", None]
    rows = [((t, [1.0, None, -2.5e-7], {"b": 1, "a\n": None}, [(True, 5), None, (None, None)]), t, None) for t in texts] + [((None, None, None, None), "x", None), (None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = df.select(*df.columns, canonical.value(F.struct(*df.columns), StructType(df.schema.fields)).alias("s"), canonical.content_hash(F.struct(*df.columns), StructType(df.schema.fields)).alias("h")).collect()
    for r in got:
        want = r.asDict(recursive=True)
        del want["s"], want["h"]
        assert r.s == plain(want) and r.h == seal_of(want)


SHAPE = {"name": "string", "k": "integer", "x": "number", "ok": "boolean", "w": "list<number>", "in": {"a": "string", "b.c": "list"}}
GOOD = {"name": "n", "k": 5, "x": 1.5, "ok": True, "w": [1, 2.5], "in": {"a": "", "b.c": []}}


@pytest.mark.parametrize("change,want", [
    ({}, []), ({"x": 3, "w": []}, []), ({"k": True}, ["kind:k"]), ({"k": 5.0}, ["kind:k"]), ({"x": False}, ["kind:x"]), ({"ok": 1}, ["kind:ok"]), ({"name": None}, ["kind:name"]),
    ({"w": [1, True]}, ["kind:w"]), ({"w": [None]}, ["kind:w"]), ({"w": {}}, ["kind:w"]), ({"z": 1, "y": 2}, ["unexpected:y", "unexpected:z"]), ({"in": []}, ["kind:in"]),
    ({"in": {"a": 1, "q": 2}}, ["unexpected:in.q", "kind:in.a", "missing:in.b.c"]),
])
def test_closed_shapes(spark, change, want):
    text = json.dumps(GOOD | change)
    assert spark.range(1).select(shapes.faults(F.lit(text), SHAPE).alias("f")).first().f == want


def test_texts_that_are_no_documents(spark):
    texts = {None: "not_json", "": "not_json", "{": "not_json", '{"a":1} x': "not_json", '{"a":1},{}': "not_json", '{"a":1,"a":2}': "not_json", "[1]": "not_object", "3": "not_object", "null": "not_object", ' {"a":1} ': None, '{"a":NaN}': "not_json"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", shapes.faults(F.col("t"), {"a": "number"}).alias("f")).collect()
    assert {r.t: (r.f[0] if r.f else None) for r in rows} == texts


def test_envelopes_go_to_one_of_two_places(spark):
    candle = ["1", 2, 3.5, "4", "5", "6", "7", "8", "1"]
    cases = {
        json.dumps({"code": "0", "data": [candle, candle]}): None, json.dumps({"code": 0}): None, json.dumps({"code": 0, "data": []}): None, "nope": "not_json", "[]": "not_object", json.dumps({"data": []}): "code_missing",
        json.dumps({"code": True, "data": []}): "code_missing", json.dumps({"code": "51000", "data": []}): "code_refused", json.dumps({"code": "0", "data": {}}): "data_invalid", json.dumps({"code": "0", "data": None}): "data_invalid",
        json.dumps({"code": "0", "data": [candle, candle[:8]]}): "items_invalid", json.dumps({"code": "0", "data": [candle[:8] + [True]]}): "items_invalid", json.dumps({"code": "0", "data": [candle[:8] + [[1]]]}): "items_invalid", json.dumps({"code": "0", "data": [{}]}): "items_invalid",
    }
    raw = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "id int, text string")
    accepted, quarantine = envelopes.split(raw, "text")
    assert {r.text: r.reason for r in quarantine.collect()} == {t: r for t, r in cases.items() if r}
    assert [(r.id, r.fields) for r in accepted.orderBy("id").collect()] == [(0, ["1", "2", "3.5", "4", "5", "6", "7", "8", "1"])] * 2
    assert envelopes.split(raw, "text", candles=False)[0].count() == 1


def test_account_documents(spark):
    docs = [(1, json.dumps({"totalEq": "5", "details": [{"ccy": "BTC", "availBal": "1.5", "cashBal": "2", "eq": "3"}, {"ccy": "ETH", "availBal": "9"}, {"ccy": "USDT", "availBal": "bad"}]})), (2, "{}"), (3, "x"), (4, None)]
    raw = spark.createDataFrame(docs, "account int, document string")
    rows = accounts.balances(raw, "document")
    assert sorted(map(tuple, rows.collect())) == sorted([(1, "BTC", "1.5", "2", "3"), (1, "USDT", "bad", None, None)])
    wide = accounts.context(raw, rows.withColumn("n", F.lit(1)), "account", "n")
    assert sorted((r.account, float(r.available_usdt), float(r.available_btc)) for r in wide.collect()) == [(1, 0.0, 1.5), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)]
    orders = spark.createDataFrame([("t", *"abcdefghijk", "hidden"), ("u", *"abcdefghijk", "hidden"), (None, *"abcdefghijk", "hidden")], ["tag", *accounts.ORDER_COLUMNS, "secret"])
    own = accounts.own_orders(orders, "t", "demo")
    assert own.columns == [*accounts.ORDER_COLUMNS.values(), "source"] and own.count() == 1


def artifact(**change):
    names = ["a", "b"]
    manifest = {f.name: "x" for f in rechecks.MANIFEST.fields} | {"random_seed": 7, "feature_schema_sha256": seal_of({"features": names})}
    model = {"buy_threshold": 0.6, "sell_threshold": 0.4, "coefficients": [1e-05, -2.0], "means": [0.0, 1.5], "scales": [1.0, 1e16], "intercept": -0.1, "feature_names": names}
    return {"manifest": manifest | change.pop("manifest", {}), "model": model | change.pop("model", {}), "schema_version": "v1"} | change


def test_artifacts_round_trip(spark):
    own = lambda doc, text=None, manifest=None: (text or plain(doc), seal_of(doc), plain(manifest or doc["manifest"]))
    good = artifact()
    cases = [
        (own(good), []), (own(good, json.dumps(good)), ["hash_mismatch", "not_canonical"]), (own(artifact(extra=1)), ["not_canonical"]), (own(artifact(model={"intercept": 1})), ["not_canonical"]),
        (own(artifact(manifest={"random_seed": True})), None), (own(artifact(model={"feature_names": ["b", "a"]})), ["schema_mismatch"]), (own(good, manifest={"x": 1}), ["manifest_mismatch"]), (("nope", seal_of(1), "{}"), ["hash_mismatch", "not_canonical", "schema_mismatch", "manifest_mismatch"]),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, artifact string, sha string, manifest string")
    got = {r.k: r.f for r in df.select("k", rechecks.artifact_faults("artifact", "sha", "manifest").alias("f")).collect()}
    for k, (_, want) in enumerate(cases):
        assert "not_canonical" in got[k] if want is None else got[k] == want


def test_decisions_and_digests(spark):
    kind = StructType().add("kind", "string").add("generation", "long").add("score", "double")
    docs = [{"kind": "lease", "generation": 3, "score": 1e-7}, {"kind": "é", "generation": None, "score": 2.0}]
    rows = [("sup_" + seal_of(d)[:28], plain(d)) for d in docs] + [("sup_" + "0" * 28, plain(docs[0])), ("sup_" + seal_of(docs[1])[:28], "broken")]
    got = rechecks.forged_decisions(spark.createDataFrame(rows, "decision_id string, body string"), "body", kind)
    assert sorted(r.body for r in got.collect()) == sorted([plain(docs[0]), "broken"])
    table = spark.createDataFrame([("i1", (1.5, "a"), ("ok",)), ("i2", (2.0, None), ("ok",)), ("i3", (3.0, "c"), ("no",))], "id string, payload struct<size: double, side: string>, decision struct<why: string>")
    later = table.withColumn("payload", F.when(F.col("id") == "i2", F.struct(F.lit(2.5).alias("size"), F.lit(None).cast("string").alias("side"))).otherwise(F.col("payload")))
    found = {r.id: r for r in rechecks.changed_intents(table.filter("id != 'i3'"), later, "id", ["payload", "decision"]).collect()}
    assert {k: r.outcome for k, r in found.items()} == {"i1": "same", "i2": "changed", "i3": "no_preview"}
    assert found["i1"].digest == seal_of({"intent": "i1", "payload": {"size": 1.5, "side": "a"}, "decision": {"why": "ok"}})


def test_contract_hash_is_that_of_the_document():
    doc = {"bar": "5m", "evaluation_mode": "long-only-bracket-fixed-horizon-non-overlapping", "feature_names": list(FEATURES), "label_horizon": 12, "stop_loss_fraction": 0.015, "take_profit_fraction": 0.025, "warmup_bars": 48}
    assert rechecks.contract_hash(FEATURES) == seal_of(doc) and rechecks.contract_hash(FEATURES[1:]) != seal_of(doc)


def test_an_artifact_is_parsed_once(spark):
    df = spark.createDataFrame([("{}", "", "")], "artifact string, sha string, manifest string")
    plan = df.select(rechecks.artifact_faults("artifact", "sha", "manifest").alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 1


def test_a_document_is_parsed_once(spark):
    shape = {"a": {"b": "integer"}, "c": "string", "d": "list<number>"}
    plan = spark.createDataFrame([("{}",)], "text string").select(shapes.faults(F.col("text"), shape).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json") == 1
