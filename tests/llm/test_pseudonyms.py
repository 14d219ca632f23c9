import re
from datetime import date

import cases
import pytest
from tidemark.llm import pseudonyms as p

ROWS = [
    (1, "card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111 1111 1111 1112"), (2, "call (212) 555-0187 or +1 212-555-0187"), (3, "ssn 123-45-6789, 000-12-3456, 123-45-0000"),
    (4, "ip 10.0.0.255 and 999.1.1.1"), (5, "on 2024-02-29, 31/12/1999, 2023-02-29 and 01.05.2100"), (6, "mail jane.doe42@example.org or x@y.co"), (7, None), (8, ""), (9, "card 4111 1111 1111 1111 again"), (9, "card 4111 1111 1111 1111 again"),
]


def luhn(text):
    digits = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def run(spark, rows, f=p.pseudonymise, key="a key"):
    return {r.doc_id: r for r in f(cases.docs(spark, rows), key).collect()}


def shape(text):
    return re.sub(r"[a-z]", "a", re.sub(r"\d", "0", text))


def test_format_links_and_validity(spark):
    got = run(spark, ROWS)
    for doc_id, text in ROWS:
        if text and doc_id != 4:
            assert shape(got[doc_id].text) == shape(text)
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[1].text)
    assert luhn(cards[0]) and luhn(cards[1]) and cards[2] == "4111 1111 1111 1112" and cards[0] != "4111 1111 1111 1111"
    assert cards[0] in got[9].text and got[1].n_card == 2 and got[9].n_card == 1
    assert "000-12-3456, 123-45-0000" in got[3].text and got[3].n_ssn == 1 and "999.1.1.1" in got[4].text and got[4].n_ipv4 == 1
    assert "2023-02-29" in got[5].text and got[5].n_date == 3 and 2001 <= date.fromisoformat(got[5].text[3:13]).year <= 2100
    assert got[6].n_email == 2 and "@example.org" in got[6].text and "jane" not in got[6].text
    assert got[7].text is None and got[8].text == "" and got[7].n_card == 0


def test_restore_undoes_it(spark):
    done = p.pseudonymise(spark.createDataFrame(ROWS, "doc_id long, text string"), key="k")
    assert sorted(map(repr, p.restore(done.select("doc_id", "text"), key="k").select("doc_id", "text").collect())) == sorted(map(repr, spark.createDataFrame(ROWS, "doc_id long, text string").collect()))
    assert run(spark, ROWS, key="k")[1].text != run(spark, ROWS, key="other")[1].text


def test_unlike_values_stay_unlike(spark):
    rows = [(k, f"{date.fromordinal(693961 + 97 * k)}") for k in range(700)] + [(1000 + k, f"10.0.{k // 256}.{k % 256}") for k in range(700)]
    got = [r.text for r in p.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "a key").collect()]
    assert len(set(got)) == len(rows)


def test_clean_text_stays(spark, small):
    docs = cases.table(spark, small, "documents").select("doc_id", "text")
    old = {r.doc_id: r.text for r in docs.collect()}
    for r in p.pseudonymise(docs, "a key").collect():
        assert (r.text == old[r.doc_id]) == (sum(r[f"n_{k}"] for k in p.KINDS) == 0)
    assert len(p.pseudonymise(cases.docs(spark), "a key").collect()) == len(cases.ROWS) and p.pseudonymise(cases.docs(spark, []), "a key").isEmpty()


SPELLINGS = [
    ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111 1111-1111 1111"],
    ["378282246310005", "3782 822463 10005", "3782-822463-10005"],
    ["6304000000000001115", "6304 0000 0000 0001 115"],
    ["2125550187", "212-555-0187", "(212) 555-0187", "212.555.0187", "+1 212 555 0187", "+12125550187", "1-212-555-0187", "(212)555-0187"],
    ["123-45-6789", "123 45 6789"],
    ["2024-02-29", "29/02/2024", "29.02.2024"],
    ["jane.doe42@example.org", "Jane.Doe42@example.org", "JANE.DOE42@EXAMPLE.ORG", "jane.doe42@Example.org"],
]


def canonical(text, kind):
    if kind == "email":
        return text.lower()
    if kind == "date":
        return text if text[4] == "-" else "-".join(re.split(r"\D", text)[::-1])
    digits = re.sub(r"\D", "", text)
    return digits[-10:] if kind == "phone" else digits


def test_every_spelling_of_a_value_has_one_pseudonym(spark):
    kinds = ["card", "card", "card", "phone", "ssn", "date", "email"]
    assert luhn(SPELLINGS[2][0]) and not luhn(SPELLINGS[2][0][:16])
    rows = [(100 * k + i, f"see {t}, ok") for k, spelled in enumerate(SPELLINGS) for i, t in enumerate(spelled)]
    got = run(spark, rows)
    for k, spelled in enumerate(SPELLINGS):
        new = [got[100 * k + i].text[4:-4] for i in range(len(spelled))]
        assert all(got[100 * k + i][f"n_{kinds[k]}"] == 1 for i in range(len(spelled)))
        assert len({canonical(t, kinds[k]) for t in new}) == 1 and new[0] != spelled[0], new
        assert [re.sub("[A-Z]", "A", shape(t)) for t in new] == [re.sub("[A-Z]", "A", shape(t)) for t in spelled]
    assert p.restore(p.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "a key").select("doc_id", "text"), "a key").select("doc_id", "text").subtract(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_digits_beside_a_card(spark):
    """The card keeps its own pseudonym beside security codes, expiry dates and list numbers."""
    rows = [(1, "4111 1111 1111 1111"), (2, "4111 1111 1111 1111 123"), (3, "4111 1111 1111 1111 12/27"), (4, "12 4111111111111111"), (5, "9 4111-1111-1111-1111"), (6, "1234 4111 1111 1111 1111"), (7, "4111 1111 1111 1111 1227")]
    got = {i: r.text for i, r in run(spark, rows).items()}
    card = got[1]
    assert got[2] == card + " 123" and got[3] == card + " 12/27" and got[7] == card + " 1227"
    assert got[4] == "12 " + card.replace(" ", "") and got[5] == "9 " + card.replace(" ", "-") and got[6] == "1234 " + card


def test_refused_spellings_stay(spark):
    rows = [(1, "010.000.000.001"), (2, "1.2.3.4.5"), (3, "1125550187"), (4, "4111 1111 1111 1112")]
    got = run(spark, rows)
    assert [got[i].text for i, _ in rows] == [t for _, t in rows]


def test_many_values_restore_and_stay_apart(spark):
    cards = [f"{4000000000000000 + 7919 * k}" for k in range(4000)]
    cards = [c for c in cards if luhn(c)]
    long = [c for c in (f"6304{k:012d}{k % 997:03d}" for k in range(4000)) if luhn(c)]
    phones = [f"212555{k:04d}" for k in range(400)]
    mails = [f"u{k}.x@example.org" for k in range(400)]
    values = [*cards, *long, *[f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:16]} {c[16:]}" for c in long if not luhn(c[:16])], *phones, *mails]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    done = p.pseudonymise(docs, "k").select("doc_id", "text")
    new = {r.doc_id: r.text for r in done.collect()}
    assert len(set(new.values())) == len(values) and sum(new[k] == v for k, v in enumerate(values)) < 3
    assert {r.doc_id: r.text for r in p.restore(done, "k").select("doc_id", "text").collect()} == dict(enumerate(values))


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        p.pseudonymise(cases.docs(spark), "")
    with pytest.raises(TypeError):
        p.pseudonymise(cases.docs(spark))
