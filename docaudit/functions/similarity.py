"""Compatibility of two values: cheap native tests first; the sequence ratio (an Arrow function) sees only the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as X
from docaudit.functions.exact import sequence_ratio


def contained(a: Column, b: Column, least: int) -> Column:
    return (F.least(F.length(a), F.length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def _judge(df: DataFrame, a: str, b: str, sure: Column, ratio: Column, out: str) -> DataFrame:
    """Rows that `sure` decides keep their verdict; the ratio runs on the others alone (two branches of a union)."""
    keys = {"__a": X.text_key(a), "__b": X.text_key(b)}
    rows = df.withColumns(keys)
    rows = rows.withColumn(out, sure)
    done = rows.where(F.col(out))
    rest = rows.where(~F.coalesce(F.col(out), F.lit(False))).withColumn(out, sequence_ratio("__a", "__b") >= ratio)
    return done.unionByName(rest).drop("__a", "__b")


def values_compatible(df: DataFrame, a: str, b: str, *, company: Column | bool = False, out: str = "compatible") -> DataFrame:
    """Equal, blank on a side, contained (3 letters or more), or a ratio of 0.72 (0.52 for company names)."""
    x, y = F.col("__a"), F.col("__b")
    sure = (x == "") | (y == "") | (x == y) | contained(x, y, 3)
    return _judge(df, a, b, sure, F.when(F.lit(company) if isinstance(company, bool) else company, 0.52).otherwise(0.72), out)


def country_equivalent(df: DataFrame, a: str, b: str, *, out: str = "equivalent") -> DataFrame:
    x, y = F.col("__a"), F.col("__b")
    return _judge(df, a, b, (x == y) | contained(x, y, 6), F.lit(0.84), out)


def text_match(df: DataFrame, path: str, a: str, b: str, *, out: str = "matches") -> DataFrame:
    """Equal keys; for companies also a ratio of 0.82 or containment of 8 letters; for postcodes equal digits."""
    x, y, p = F.col("__a"), F.col("__b"), F.lower(path)
    company, code = p.contains("company"), p.contains("postcode")
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    sure = ((x != "") & (x == y)) | (company & contained(x, y, 8)) | (code & (digits(F.col(a)) != "") & (digits(F.col(a)) == digits(F.col(b))))
    return _judge(df, a, b, sure, F.when(company, 0.82).otherwise(2.0), out)


# Weights of a matching field between a candidate and an example, own side and other side alike.
CONTEXT_WEIGHTS = (("company", 2.5), ("street", 2.0), ("postcode", 1.0))


def context_score(pairs: Sequence[tuple[Column, float]], same_city: Column, same_country: Column) -> Column:
    """Sum of the weights of matching fields, 4 for the same other city, 8 for an equivalent other country."""
    total = F.lit(0.0)
    for match, weight in pairs:
        total = total + F.when(match, weight).otherwise(0.0)
    return total + F.when(same_city, 4.0).otherwise(0.0) + F.when(same_country, 8.0).otherwise(0.0)
