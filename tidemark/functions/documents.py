"""Canonical documents: sorted keys, no blanks, no NaN, non-ASCII kept. The one place here that needs Python.

Java prints 1.0E-5 where the canonical form has 1e-05, so hashes of documents go through Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys that hold any of these, in any case, are not logged.
SENSITIVE = ("secret", "passphrase", "api_key", "apikey", "signature", "authorization")
REDACTED = "[REDACTED]"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def seal_of(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def redacted(value: object) -> object:
    """value with what stands under a sensitive key replaced, at any depth."""
    if isinstance(value, dict):
        return {k: REDACTED if any(s in k.lower() for s in SENSITIVE) else redacted(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v) for v in value]
    return value


def _plain(value: object) -> object:
    """A cell as JSON has it: exact numbers and times as text, missing as null."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [_plain(v) for v in value]
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (bool, int, float, str)):
        return value
    return value.item() if hasattr(value, "item") else str(value)


@F.pandas_udf(StringType())
def canonical_json(document: pd.Series) -> pd.Series:
    """Canonical text of a JSON document given as text; null stays null, what is no JSON stops the query."""
    return document.map(lambda x: canonical(json.loads(x)), na_action="ignore")


@F.pandas_udf(StringType())
def redact(document: pd.Series) -> pd.Series:
    """Canonical text of a JSON document without sensitive values."""
    return document.map(lambda x: canonical(redacted(json.loads(x))), na_action="ignore")


@F.pandas_udf(StringType())
def _sealed(rows: pd.DataFrame) -> pd.Series:
    return pd.Series([seal_of({k: _plain(v) for k, v in row.items()}) for row in rows.to_dict("records")], dtype="object")


def row_seal(*columns: str) -> Column:
    """SHA-256 over the canonical document of the columns; exact numbers and times enter as text."""
    return _sealed(F.struct(*columns))


def key_paths(document: str) -> Column:
    """Sorted top-level keys of a JSON document."""
    return F.array_sort(F.json_object_keys(document))
