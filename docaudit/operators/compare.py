"""Comparison of predicted with true documents: full outer matching of leaves, outcomes, metrics.

Both documents of a sample sit in one row, so their leaves meet inside the row (map_zip_with is the full outer join on
paths) and no leaf is shuffled; only counters are, after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as X

COUNTERS = ("tp", "fp", "fn", "similarity_sum", "similarity_support", "empty_gt", "empty_correct", "hallucinated")


def outcomes(truth: Column, prediction: Column) -> Column:
    """Array of struct<path, t, p, ...> over the union of the paths of two leaf maps."""
    joined = F.map_zip_with(truth, prediction, lambda k, t, p: F.struct(t.alias("t"), p.alias("p")))
    return F.map_entries(joined)


def leaf_pairs(pairs: DataFrame, keep: list[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row for each path of either document: keep, path, t_type, t_value, p_type, p_value (null type: missing)."""
    out = pairs.select(*keep, F.explode(outcomes(F.col(truth), F.col(prediction))).alias("e"))
    return out.select(*keep, F.col("e.key").alias("path"), *[F.col(f"e.value.{s}.{f}").alias(f"{s}_{n}") for s in "tp" for f, n in (("jtype", "type"), ("value", "value"))])


def _is_empty(kind: Column, value: Column) -> Column:
    return kind.isNull() | (kind == "null") | ((kind == "string") & (X.strip(value) == ""))


def with_outcomes(leaves: DataFrame, *, case: bool = True) -> DataFrame:
    """Counters of each leaf pair, and the kind of difference."""
    out = leaves.withColumns({
        "t_empty": _is_empty(F.col("t_type"), F.col("t_value")), "p_empty": _is_empty(F.col("p_type"), F.col("p_value")),
        "same": F.col("t_type").eqNullSafe(F.col("p_type")) & F.col("t_value").eqNullSafe(F.col("p_value")),
    })
    both = ~F.col("t_empty") & ~F.col("p_empty")
    # most leaves are the same as they stand; only the others are brought to canonical form
    t, p = (F.when(both & ~F.col("same"), X.canonical(F.col(f"{s}_type"), F.col(f"{s}_value"), case=case)) for s in "tp")
    out = out.withColumns({"t_c": t, "p_c": p})
    there = F.col("t_type").isNotNull()
    equal = F.col("same") | F.coalesce(F.col("t_c") == F.col("p_c"), F.lit(False))
    one = lambda c: c.cast("long")
    filled = there & ~F.col("t_empty")
    similar = F.when(both, F.when(equal, F.lit(1.0)).otherwise(X.edit_similarity(F.col("t_c.text"), F.col("p_c.text")))).otherwise(F.lit(0.0))
    return out.withColumns({
        "equal": equal,
        "similarity": similar,
        "tp": one(both & equal),
        "fp": one(~F.col("p_empty") & ~(both & equal)),
        "fn": one(filled & ~(both & equal)),
        "similarity_sum": F.when(filled, similar).otherwise(F.lit(0.0)),
        "similarity_support": one(filled),
        "empty_gt": one(there & F.col("t_empty")),
        "empty_correct": one(there & F.col("t_empty") & F.col("p_empty")),
        "hallucinated": one(F.col("t_empty") & ~F.col("p_empty")),
    })


def counters() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS]


def ratios(digits: int = 6) -> dict[str, Column]:
    """precision, recall, f1, similarity and support from the counters."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    precision, recall = X.ratio_or(tp, tp + fp, 1.0), X.ratio_or(tp, tp + fn, 1.0)
    r = lambda c: F.round(c, digits)
    return {
        "precision": r(precision),
        "recall": r(recall),
        "f1": r(X.ratio_or(2 * precision * recall, precision + recall, 0.0)),
        "similarity": r(X.ratio_or(F.col("similarity_sum"), F.col("similarity_support"), 1.0)),
        "support": F.col("tp") + F.col("fn"),
    }


def differences(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """Rows that differ: prediction_only, annotation_only, formatting_only or value_mismatch, with their similarity."""
    o = with_outcomes(leaves)
    same = (F.col("t_type") == F.col("p_type")) & F.col("t_value").eqNullSafe(F.col("p_value"))
    kind = F.when(F.col("t_empty"), "prediction_only").when(F.col("p_empty"), "annotation_only").when(F.col("equal"), "formatting_only").otherwise("value_mismatch")
    score = F.when(F.col("t_empty") | F.col("p_empty"), F.lit(0.0)).when(F.col("equal"), F.lit(1.0)).otherwise(F.col("similarity"))
    return o.where(~(F.col("t_empty") & F.col("p_empty")) & ~F.coalesce(same, F.lit(False))).select(*keep, "path", kind.alias("kind"), F.round(score, 6).alias("similarity"))
