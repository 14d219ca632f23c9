"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated numbers, dates and addresses in a text are replaced by others of the same format, by a keyed permutation of the
value itself: separators and capitals are taken off first and laid back afterwards, so all spellings of a value get one
pseudonym in every document. Unlike values get unlike ones, and restore() with the key undoes it.

What is found, what makes it valid, and what stays:
  card   13 to 19 digits together, or groups of 4-4-4-4, 4-4-4-4-1 to -3, 4-6-4 or 4-6-5 with blanks or hyphens, that pass
         the Luhn check; the first digit stays, the last is the new check digit. Of 4-4-4-4 with a further group (security
         code, expiry) the first sixteen digits are the card if they pass, else all of 17 to 19, else the last sixteen of 20
  phone  ten digits of the North American plan, with or without separators and country code; any area code after +1 or in
         brackets, else one from 200; country code and the first digits of area and exchange stay
  ssn    ddd-dd-dddd or with blanks, area not 000, 666 or 9xx, no part of zeros; the area stays
  ipv4   four numbers to 255 without leading zeros; all 32 bits are permuted
  date   yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy, a real day of 1901 to 2100; it stays in its century of 36,525 or 36,524 days
  email  the part before the @, letters among letters and digits among digits, by a permutation of its domain's own; the
         domain stays; capitals of either make no difference and stay where they are
Anything else stays as it is. The work is one projection over the text: no shuffle, no state, no Python on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

KEY_SETTING = "spark.tidemark.pseudonyms.key"
ROUNDS = 8
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "ipv4": r"(?<![\d.])(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}(?!\.?\d)",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\.?\d)",
    "ssn": r"(?<![\d-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\d-])",
    "phone": r"(?<![\d+])(?:(?:\+?1[ .-]?)?\(?[2-9]\d{2}\)?|\+1[ .-]?\d{3}|(?:\+?1[ .-]?)?\(\d{3}\))[ .-]?[2-9]\d{2}[ .-]?\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)",
}
PATTERN = "|".join(KINDS.values())


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _secret(key: str, kind: str, round_: Column, half: Column, tweak: Column | None = None) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}|{key}|"), *([] if tweak is None else [tweak, F.lit("|")]), round_.cast("string"), F.lit("|"), half), 256)


def _number(secret: Column) -> Column:
    return F.conv(F.substring(secret, 1, 12), 16, 10).cast("long")


def _rounds(undo: bool) -> Column:
    return F.array(*[F.lit(k) for k in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))])


def _shifted(text: Column, secret: Column, sign: int) -> Column:
    """Each digit and small letter moved within its class by a byte of the secret; other characters stay."""

    def one(i: Column) -> Column:
        c = F.substr(text, i + 1, F.lit(1))
        code = F.ascii(c)
        by = F.conv(F.substr(secret, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        moved = lambda base, n: F.char((F.pmod(code - base + by, F.lit(n)) + base).cast("long"))
        return F.when(code.between(48, 57), moved(48, 10)).when(code.between(97, 122), moved(97, 26)).otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), ""))


def _permuted(text: Column, key: str, kind: str, undo: bool, tweak: Column | None = None) -> Column:
    """A Feistel network over the two halves of a string; halves keep their lengths and the classes of their characters."""

    def step(s: Column, k: Column) -> Column:
        if undo:
            return F.struct(_shifted(s["r"], _secret(key, kind, k, s["l"], tweak), -1).alias("l"), s["l"].alias("r"))
        return F.struct(s["r"].alias("l"), _shifted(s["l"], _secret(key, kind, k, s["r"], tweak), 1).alias("r"))

    def network(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        start = F.struct(F.substr(t, F.lit(1), half).alias("l"), F.substr(t, half + 1, F.length(t)).alias("r"))
        return F.aggregate(_rounds(undo), start, step, lambda s: F.concat(s["l"], s["r"]))

    return _let(text, network)


def _paired(x: Column, y: Column, a: Column, b: Column, key: str, kind: str, undo: bool) -> Column:
    """A Feistel network over a pair of numbers below a and b."""

    def step(s: Column, k: Column) -> Column:
        if undo:
            old_y = F.pmod(s["y"] - _number(_secret(key, kind + "y", k, s["x"].cast("string"))), b)
            return F.struct(F.pmod(s["x"] - _number(_secret(key, kind + "x", k, old_y.cast("string"))), a).alias("x"), old_y.alias("y"))
        new_x = F.pmod(s["x"] + _number(_secret(key, kind + "x", k, s["y"].cast("string"))), a)
        return F.struct(new_x.alias("x"), F.pmod(s["y"] + _number(_secret(key, kind + "y", k, new_x.cast("string"))), b).alias("y"))

    return F.aggregate(_rounds(undo), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def _luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits whose last one is the check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _part(text: Column, start: int, length: Column | int) -> Column:
    return F.substr(text, F.lit(start), F.lit(length) if isinstance(length, int) else length)


def _laid(spelling: Column, digits: Column) -> Column:
    """spelling with its digits replaced by others, one after another."""

    def step(s: Column, i: Column) -> Column:
        c = F.substr(spelling, i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["text"], F.when(is_digit, F.substr(digits, s["used"] + 1, F.lit(1))).otherwise(c)).alias("text"), (s["used"] + is_digit.cast("int")).alias("used"))

    return F.aggregate(F.sequence(F.lit(1), F.length(spelling)), F.struct(F.lit("").alias("text"), F.lit(0).alias("used")), step, lambda s: s["text"])


def _valid(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _check(digits: Column, residue: Column | int = 0) -> Column:
    """The digit behind others that brings their Luhn sum to the residue."""
    return F.pmod(residue - _luhn_sum(F.concat(digits, F.lit("0"))) % 10, F.lit(10)).cast("string")


def _new_card(d: Column, key: str, undo: bool) -> Column:
    """Another valid number of as many digits. Of a longer one the first sixteen keep their Luhn residue, whether or not they are a card."""
    n = F.length(d)
    free = F.when(n <= 16, _part(d, 2, n - 2)).otherwise(F.concat(_part(d, 2, 14), _part(d, 17, n - 17)))

    def body(moved: Column) -> Column:
        first = F.concat(_part(d, 1, 1), _part(moved, 1, 14))
        return F.when(n <= 16, first).otherwise(F.concat(first, _check(first, _luhn_sum(_part(d, 1, 16)) % 10), _part(moved, 15, n)))

    return _let(_let(_permuted(free, key, "card", undo), body), lambda x: F.concat(x, _check(x)))


def _card(m: Column, key: str, undo: bool) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        first, last = (F.length(m) > n) & (n > 16) & _valid(_part(d, 1, 16)), (n == 20) & _valid(_part(d, 5, 16))
        place = F.when(first, 0).when((n < 20) & _valid(d), 1).when(last, 2)

        def put(at: Column) -> Column:
            piece = F.when(at == 0, _part(d, 1, 16)).when(at == 1, d).otherwise(_part(d, 5, 16))
            whole = F.concat(F.when(at == 2, _part(d, 1, 4)).otherwise(""), _let(piece, lambda x: _new_card(x, key, undo)), F.when(at == 0, _part(d, 17, n)).otherwise(""))
            return F.when(at.isNotNull(), whole)

        return _let(place, put)

    return _let(_let(_digits(m), new), lambda d: F.when(d.isNotNull(), _laid(m, d)))


def _phone(m: Column, key: str, undo: bool) -> Column:
    def new(d: Column) -> Column:
        country, ten = _part(d, 1, F.length(d) - 10), F.substr(d, F.length(d) - 9, F.lit(10))
        moved = _permuted(F.concat(_part(ten, 2, 2), _part(ten, 5, 6)), key, "phone", undo)
        return _let(moved, lambda x: F.concat(country, _part(ten, 1, 1), _part(x, 1, 2), _part(ten, 4, 1), _part(x, 3, 6)))

    return _let(_let(_digits(m), new), lambda d: _laid(m, d))


def _ssn(m: Column, key: str, undo: bool) -> Column:
    area, group, serial = (_part(m, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
    pair = _paired(group.cast("int") - 1, serial.cast("int") - 1, F.lit(99), F.lit(9999), key, "ssn", undo)
    new = _let(pair, lambda x: F.concat(area, _part(m, 4, 1), F.lpad((x["x"] + 1).cast("string"), 2, "0"), _part(m, 7, 1), F.lpad((x["y"] + 1).cast("string"), 4, "0")))
    return F.when(~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000"), new)


def _ipv4(m: Column, key: str, undo: bool) -> Column:
    part = [F.element_at(F.split(m, r"\."), k).cast("int") for k in range(1, 5)]
    pair = _paired(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ipv4", undo)
    numbers = [f(pair[c]) for c in ("x", "y") for f in (lambda v: F.floor(v / 256).cast("long"), lambda v: v % 256)]
    return F.when(F.greatest(*part) <= 255, F.concat_ws(".", *[n.cast("string") for n in numbers]))


def _date(m: Column, key: str, undo: bool) -> Column:
    iso = m.contains("-")
    split = F.substr(m, F.lit(3), F.lit(1))
    ordered = F.when(iso, m).otherwise(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))))
    day = F.try_to_date(ordered, "yyyy-MM-dd")
    old = F.year(day) <= 2000
    first = F.when(old, F.lit("1901-01-01")).otherwise(F.lit("2001-01-01")).cast("date")
    a, b = F.when(old, 75).otherwise(92), F.when(old, 487).otherwise(397)  # 36,525 and 36,524 days
    n = F.datediff(day, first)
    pair = _paired(F.floor(n / b).cast("long"), n % b, a, b, key, "date", undo)
    new = F.date_add(first, (pair["x"] * b + pair["y"]).cast("int"))
    text = F.date_format(new, "yyyy-MM-dd")
    out = F.when(iso, text).otherwise(F.concat(F.substr(text, F.lit(9), F.lit(2)), split, F.substr(text, F.lit(6), F.lit(2)), split, F.substr(text, F.lit(1), F.lit(4))))
    return F.when(F.year(day).between(1901, 2100), out)


def _email(m: Column, key: str, undo: bool) -> Column:
    at = F.instr(m, "@")
    own, domain = _part(m, 1, at - 1), F.substr(m, at, F.length(m))

    def cased(new: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substr(new, i, F.lit(1))
            return F.when(F.ascii(F.substr(own, i, F.lit(1))).between(65, 90), F.upper(c)).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(new)), one), "")

    return F.concat(_let(_permuted(F.lower(own), key, "email", undo, F.lower(domain)), cased), domain)


_RULES: dict[str, Callable[[Column, str, bool], Column]] = {"email": _email, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _kind(m: Column) -> Column:
    """First kind whose pattern the whole string has."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _replaced(docs: DataFrame, key: str, undo: bool) -> DataFrame:
    extra = [f"n_{kind}" for kind in KINDS]
    kept = [c for c in docs.columns if c not in (*extra, "text")]

    def new(m: Column) -> Column:
        kind, out = _kind(m), F.lit(None).cast("string")
        for name, rule in _RULES.items():
            out = F.when(kind == name, rule(m, key, undo)).otherwise(out)
        return F.struct(F.when(out.isNotNull(), kind).alias("kind"), F.coalesce(out, m).alias("text"))

    m, n = (common.unused(docs.columns, x) for x in ("matches", "replaced"))
    quoted = [F.col(f"`{c}`") for c in kept]
    found = docs.select(*quoted, F.col("text").cast("string").alias("text"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias(m))
    done = found.withColumn(n, F.when(F.size(m) > 0, F.transform(m, new)))
    parts = F.zip_with(F.split("text", PATTERN, -1), F.transform(n, lambda x: x["text"]), lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    text = F.when(F.size(m) > 0, F.array_join(parts, "")).otherwise(F.col("text")).alias("text")

    def count(kind: str) -> Column:
        of_kind = F.filter(n, lambda x: x["kind"] == kind)
        return F.when(F.col(n).isNull(), 0).otherwise(F.size(of_kind)).cast("long").alias(f"n_{kind}")

    return done.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in extra], *[count(kind) for kind in KINDS])


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with values in text replaced, and a count of replaced values for each kind (n_card and so on).

    Whoever has the key can undo it: keep it apart from the results. Other columns stay; columns with the names of the
    counts are replaced. A null text stays null, an empty one empty, both with counts of 0. Texts of any length are taken
    whole; repeated rows get equal results; an empty table gives no rows.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    return _replaced(docs, key, undo=False)


def restore(docs: DataFrame, key: str) -> DataFrame:
    """The inverse of pseudonymise with the same key.

    One case may differ: of five groups of four digits where only the last four are a card, the first four of the
    result may pass the Luhn check by chance, one time in ten, and would be taken for the card.
    """
    return _replaced(docs, key, undo=True)


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key of the session's spark.tidemark.pseudonyms.key; where that is unset, under one that is no secret, for test tables."""
    key = spark.conf.get(KEY_SETTING, None) or "no secret"
    return pseudonymise(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key)
