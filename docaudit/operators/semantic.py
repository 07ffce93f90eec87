"""Row-local checks of leaf values: one pass, no shuffle; each value yields the issues that apply to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as X

# Texts that stand for an absent value.
NULL_WORDS = ("null", "none", "n/a", "nan", "unknown")
MEASURES = r"quantity|weight|volume|charge"


def _issues(df: DataFrame, keys: Sequence[str], path: str, rules: list) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, cond in rules]))
    return df.select(*keys, path, F.inline(found))


def string_issues(df: DataFrame, keys: Sequence[str], path: str, value: str) -> DataFrame:
    """keys, path, code, severity. A blank string has no other issue."""
    v, p = F.col(value), F.lower(path)
    filled = X.strip(v) != ""
    state = X.date_state(v)
    dated = p.contains("date") | p.endswith(".data")
    digits = F.length(F.regexp_replace(v, r"\D", ""))
    return _issues(df, keys, path, [
        ("blank_string", 42, ~filled),
        ("null_literal", 55, F.lower(X.strip(v)).isin(*NULL_WORDS)),
        ("invalid_postcode", 68, filled & p.contains("postcode") & (digits == 0)),
        ("unusual_postcode_length", 52, filled & p.contains("postcode") & (F.length(v) > 14)),
        ("invalid_city", 72, filled & p.endswith("city") & v.rlike(r"(?U)^[\d\W_]+$")),
        ("invalid_phone", 50, filled & p.contains("phone") & (digits < 5)),
        ("impossible_date", 76, filled & dated & ~F.coalesce(state, F.lit(True))),
        ("unusual_date_format", 28, filled & dated & state.isNull() & v.rlike(r"\d")),
        ("surrounding_whitespace", 32, filled & (X.strip(v) != v)),
    ])


def number_issues(df: DataFrame, keys: Sequence[str], path: str, value: str) -> DataFrame:
    v, p = F.col(value), F.lower(path)
    return _issues(df, keys, path, [
        ("nonfinite_number", 85, F.isnan(v) | (F.abs(v) == float("inf"))),
        ("negative_measurement", 80, (v < 0) & p.rlike(MEASURES)),
        ("zero_package_quantity", 35, (v == 0) & p.contains("quantity")),
    ])
