"""Checks of JSON documents given as text, against a closed shape: exact key sets, and kinds that keep booleans and numbers apart.

Documents are parsed once into VARIANT; everything stays in the JVM. A document with a key twice, or with anything behind it, is no JSON here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.canonical import let

#: string, number (no boolean), integer (64 bits, written without point or exponent), boolean, object, list, list of
#: one of these as 'list<number>', or the shape of an object.
Shape = Mapping[str, "str | Shape"]

_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "list": "^ARRAY<"}
_END = '"\\u0000end"'


def parsed(text: Column) -> Column:
    """The document as VARIANT, null where it is none."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f",{_END}]")))
    ended = lambda parts: F.try_variant_get(F.get(parts, F.lit(1)), "$", "string") == "\0end"
    return let(F.try_variant_get(both, "$", "array<variant>"), lambda parts: F.when(F.coalesce(ended(parts) & (F.size(parts) == 2), F.lit(False)), F.get(parts, F.lit(0))))


def kind_of(part: Column) -> Column:
    """The SQL type of a VARIANT, VOID for a JSON null."""
    return F.schema_of_variant(part)


def is_kind(part: Column, kind: str) -> Column:
    """Whether a VARIANT is of a kind; false where there is none."""
    if kind.startswith("list<"):
        inner = F.forall(F.try_variant_get(part, "$", "array<variant>"), lambda x: F.coalesce(kind_of(x).rlike(_KINDS[kind[5:-1]]), F.lit(False)))
        return F.coalesce(kind_of(part).rlike(_KINDS["list"]) & inner, F.lit(False))
    return F.coalesce(kind_of(part).rlike(_KINDS[kind]), F.lit(False))


def part_of(whole: Column, key: str) -> Column:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(whole, f"$['{quoted}']", "variant")


def faults(text: Column, shape: Shape) -> Column:
    """What is wrong with a document: not_json, not_object, missing:path, unexpected:path, kind:path; empty if nothing is. Null has not_json.

    Codes come by path in the order of keys; the inside of a part that is missing or no object is not looked at.
    """
    def judged(whole: Column) -> Column:
        wrong = F.when(whole.isNull(), F.array(F.lit("not_json"))).when(~is_kind(whole, "object"), F.array(F.lit("not_object")))
        return F.coalesce(wrong, _inside(whole, shape, ""))

    return let(parsed(text), judged)


def _inside(whole: Column, shape: Shape, at: str) -> Column:
    known = F.array(*[F.lit(k) for k in shape]) if shape else F.array().cast("array<string>")

    def judged(keys: Column) -> Column:
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit(f"unexpected:{at}"), k))
        one = lambda key: let(part_of(whole, key), lambda part: _wrong(keys, part, key, shape[key], f"{at}{key}"))
        return F.concat(extra, *[one(key) for key in sorted(shape)])

    return let(F.json_object_keys(whole.cast("string")), judged)


def _wrong(keys: Column, part: Column, key: str, kind: str | Shape, code: str) -> Column:
    ok = is_kind(part, kind if isinstance(kind, str) else "object")
    none = F.array().cast("array<string>") if isinstance(kind, str) else _inside(part, kind, f"{code}.")
    return F.when(~F.array_contains(keys, key), F.array(F.lit(f"missing:{code}"))).when(~ok, F.array(F.lit(f"kind:{code}"))).otherwise(none)
