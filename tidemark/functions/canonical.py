"""Canonical JSON of typed columns, by column expressions: equal to documents.canonical byte for byte, without Python.

Keys are sorted, nothing is blank, non-ASCII stays. Numbers are written as the shortest digits that read back as the same double, with
an exponent from 1e16 and below 1e-4. Exact numbers, dates and times enter as text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType


_NAMED = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def text(value: Column) -> Column:
    """A JSON string."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(_NAMED.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _scientific(size: Column, digits: Column) -> Column:
    """size rounded to so many digits, as d.ddde+xx. The JVM rounds its own decimal text; whole numbers from 1e16 on are rounded exactly."""

    def exactly(whole: Column) -> Column:
        unit = F.element_at(F.array(*[F.lit(10**k) for k in range(5)]), F.length(whole.cast("string")) - digits + 1)
        low, rest = F.call_function("div", whole, unit), 2 * (whole % unit)
        kept = (low + ((rest > unit) | ((rest == unit) & (low % 2 == 1))).cast("bigint")).cast("string")
        return F.concat(F.substring(kept, 1, 1), F.lit("."), F.substring(kept, F.lit(2), F.length(kept)), F.lit("e+"), (F.length(kept) + F.length(unit.cast("string")) - 2).cast("string"))

    shown = F.call_function("format_string", F.concat(F.lit("%."), (digits - 1).cast("string"), F.lit("e")), size)
    return F.when((size >= 1e16) & (size < 9.2e18), exactly(size.cast("bigint"))).otherwise(shown)


def number(value: Column) -> Column:
    """A double; what is not finite stops the query, as it has no JSON."""
    tries = lambda first: F.array(*[F.lit(k) for k in range(first, 18)])

    def exact(size: Column, digits: Column) -> Column:
        return let(_scientific(size, digits), lambda t: F.when(t.try_cast("double") == size, t))

    def written(size: Column) -> Column:
        # the JVM's own text may have a digit too many; below the normal range a double has fewer than 15, mostly 15 are enough
        more = F.when(size < 2.2250738585072014e-308, tries(1)).otherwise(tries(16))
        found = F.element_at(F.filter(F.transform(more, lambda k: _scientific(size, k)), lambda t: t.try_cast("double") == size), 1)
        return let(F.coalesce(F.when(size >= 2.2250738585072014e-308, exact(size, F.lit(15))), found), shaped)

    def short(size: Column, own: Column) -> Column:
        # up to 15 digits that read back are the shortest ones, whoever wrote them; from 1e-3 to 1e7 the JVM lays them out as wanted here
        plain, power = (size >= 1e-3) & (size < 1e7), F.replace(own, F.lit("E"), F.lit("e"))
        few = (size >= 2.2250738585072014e-308) & (F.length(F.split_part(own, F.lit("E"), F.lit(1))) <= 16)
        return F.when(plain & (F.length(own) <= 16), own).when(~plain & few, let(power, shaped)).otherwise(written(size))

    def shaped(shown: Column) -> Column:
        mantissa, power = F.split_part(shown, F.lit("e"), F.lit(1)), F.split_part(shown, F.lit("e"), F.lit(2)).try_cast("int")
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", "")
        return let(F.struct(digits.alias("d"), power.alias("p")), lambda x: laid_out(x["d"], x["p"]))

    def laid_out(digits: Column, power: Column) -> Column:
        n, point = F.length(digits), power + 1
        zeros = lambda k: F.repeat(F.lit("0"), k)
        fixed = F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        exponent = F.abs(power).cast("string")
        short = F.concat(F.substring(digits, 1, 1), tail, F.when(power < 0, "e-").otherwise("e+"), F.lpad(exponent, F.greatest(F.lit(2), F.length(exponent)), F.lit("0")))
        return F.when((power >= -4) & (power < 16), fixed).otherwise(short)

    size = F.abs(value)
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    lost = F.isnan(value) | (size == float("inf"))
    return F.when(lost, F.raise_error(F.lit("a number that is not finite has no JSON")).cast("string")).otherwise(F.concat(sign, F.when(size == 0, "0.0").otherwise(let(size, lambda x: let(x.cast("string"), lambda own: short(x, own))))))


def value(column: Column, kind: DataType) -> Column:
    """A column of a type as canonical JSON; null is null at any depth."""
    if isinstance(kind, StructType):
        inside = document({f.name: value(column[f.name], f.dataType) for f in kind.fields})
    elif isinstance(kind, ArrayType):
        inside = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: value(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pairs = F.transform(F.array_sort(F.map_keys(column)), lambda k: F.concat(text(k), F.lit(":"), value(F.element_at(column, k), kind.valueType)))
        inside = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, (DoubleType, FloatType)):
        inside = number(column.cast("double"))
    elif isinstance(kind, (BooleanType, IntegralType)):
        inside = column.cast("string")
    else:
        inside = text(column if isinstance(kind, StringType) else column.cast("string"))
    return F.when(column.isNull(), "null").otherwise(inside)


def document(parts: Mapping[str, Column]) -> Column:
    """An object of parts that are canonical already."""
    pairs = [F.concat(text(F.lit(k)), F.lit(":"), parts[k]) for k in sorted(parts)]
    joined = [x for k, pair in enumerate(pairs) for x in ([F.lit(",")] if k else []) + [pair]]
    return F.concat(F.lit("{"), *joined, F.lit("}"))


def content_hash(column: Column, kind: DataType) -> Column:
    return F.sha2(value(column, kind), 256)


__all__ = ["content_hash", "document", "let", "number", "text", "value"]
