"""Account documents: balances as rows, balances as columns, orders of one tag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import decimal_or_zero

#: The field names of an account document and of an order, and what the order's columns are called.
ACCOUNT = "totalEq string, uTime string, details array<struct<ccy string, availBal string, cashBal string, eq string>>"
CURRENCIES = ("BTC", "USDT")
ORDER_COLUMNS = {
    "ordId": "ordId", "clOrdId": "clOrdId", "instId": "instId", "side": "side", "ordType": "ordType", "px": "price", "sz": "size",
    "accFillSz": "filledSize", "state": "state", "cTime": "createdAt", "uTime": "updatedAt",
}


def balances(accounts: DataFrame, document: str, currencies: Sequence[str] = CURRENCIES) -> DataFrame:
    """accounts (a JSON document each) -> a row for each listed currency: currency, available, cash_balance, equity, as text.

    Other columns are kept. A document without details, or that is none, gives no rows; a field that is missing is null.
    """
    read = F.from_json(document, ACCOUNT)
    rest = [c for c in accounts.columns if c != document]
    rows = accounts.select(*rest, F.explode(read["details"]).alias("__b")).filter(F.col("__b.ccy").isin(*currencies))
    names = {"ccy": "currency", "availBal": "available", "cashBal": "cash_balance", "eq": "equity"}
    return rows.select(*rest, *[F.col(f"__b.{a}").alias(b) for a, b in names.items()])


def context(accounts: DataFrame, rows: DataFrame, key: str, order: str, currencies: Sequence[str] = ("USDT", "BTC"), amount: str = "available") -> DataFrame:
    """One row an account with a column for each currency: the amount of its last row in order, 0 where there is none or it is no number."""
    exact = rows.withColumn("__amount", decimal_or_zero(F.col(amount).cast("string")))
    wide = exact.groupBy(key).pivot("currency", list(currencies)).agg(F.max_by("__amount", order))
    zero = F.lit(0).cast("decimal(38,18)")
    return accounts.select(key).distinct().join(wide, key, "left").select(key, *[F.coalesce(F.col(c), zero).alias(f"{amount}_{c.lower()}") for c in currencies])


def own_orders(orders: DataFrame, tag: str, source: str) -> DataFrame:
    """Orders of a tag, with the columns that may be shown and no others."""
    return orders.filter(F.col("tag") == tag).select(*[F.col(a).alias(b) for a, b in ORDER_COLUMNS.items()], F.lit(source).alias("source"))


def unresolved_statuses(intents: DataFrame, status: Column, by: Sequence[str] = ()) -> DataFrame:
    """count and the sorted set of statuses of the rows that status names (null: resolved)."""
    found = intents.withColumn("__status", status).filter("__status IS NOT NULL").groupBy(*by)
    return found.agg(F.count("*").alias("count"), F.array_sort(F.collect_set("__status")).alias("statuses"))
