"""Profiling of leaves: typed values, field statistics, dominant classes, rare values, variants, outliers, rules, risk.

Leaves come in long form (sample_id, path, jtype, value). Every operator aggregates in two steps (values, then fields), so
a hot field is pre-aggregated before its rows meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docaudit.functions import text as X


def typed_values(leaves: DataFrame) -> DataFrame:
    """path, jtype, value: occurrences and samples. Values of different types are different values."""
    return leaves.groupBy("path", "jtype", "value").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("sample_id").alias("samples"))


def value_inventory(leaves: DataFrame) -> DataFrame:
    values = leaves.groupBy("path", "jtype", "value").agg(F.count(F.lit(1)).alias("occurrences"))
    total = F.sum("occurrences").over(Window.partitionBy("path"))
    share = F.col("occurrences") / total
    return values.select("path", "jtype", "value", "occurrences", F.round(share, 6).alias("frequency"), X.rarity(F.col("occurrences"), share).alias("rarity"))


def field_statistics(leaves: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """One row for each observed or expected path; an unobserved one has zeros."""
    values = leaves.groupBy("path", "jtype", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("jtype") != "null"
    per = values.groupBy("path").agg(
        F.sum("n").alias("occurrences"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count_if(present).alias("unique_values"),
        F.count_if(present & (F.col("n") == 1)).alias("singletons"),
        F.count_distinct("jtype").alias("types"),
        F.min(F.when(F.col("jtype").isin("integer", "number"), F.col("value").cast("double"))).alias("least"),
        F.max(F.when(F.col("jtype").isin("integer", "number"), F.col("value").cast("double"))).alias("most"),
        F.max(F.when(F.col("jtype") == "string", F.length("value"))).cast("long").alias("longest"),
    )
    if not expected:
        return per
    wanted = leaves.sparkSession.createDataFrame([(p,) for p in expected], "path string")
    full = per.join(wanted, "path", "full")
    counts = ("occurrences", "nulls", "unique_values", "singletons", "types")
    return full.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "least", "most", "longest")


def numeric_summary(values: DataFrame, key: str, value: str) -> DataFrame:
    """Median, quartiles and median absolute deviation of value for each key."""
    first = values.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("s_key")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("q")
    )
    away = values.join(first, F.col(key) == F.col("s_key")).select("s_key", F.abs(F.col(value) - F.col("q")[1]).alias("away"))
    mad = away.groupBy(F.col("s_key").alias("m_key")).agg(F.expr("percentile(away, 0.5)").alias("mad"))
    return first.join(mad, F.col("s_key") == F.col("m_key")).select(F.col("s_key").alias("stat_key"), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mad")


def outliers(values: DataFrame, key: str, value: str, *, least: int = 10, z: float = 7.0, fence: float = 4.0) -> DataFrame:
    """Rows whose robust z exceeds the limit, or (no spread of deviations) that lie beyond the quartile fences."""
    stats = numeric_summary(values, key, value).where(F.col("n") >= least)
    met = values.join(stats, F.col(key) == F.col("stat_key"))
    score = 0.6745 * F.abs(F.col(value) - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    width = F.col("q3") - F.col("q1")
    fenced = (width > 0) & ((F.col(value) < F.col("q1") - fence * width) | (F.col(value) > F.col("q3") + fence * width))
    return met.where(F.coalesce(score > z, fenced)).withColumn("score", score)


def minority(classified: DataFrame, key: str, cls: str, *, least: int = 10, dominant: float = 0.9, share: float = 0.02) -> DataFrame:
    """Classes that are a small minority of their key: key, class, n, dominant class, confidence."""
    counts = classified.groupBy(key, cls).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(key)
    ranked = counts.withColumns({"total": F.sum("n").over(whole), "top": F.max(F.struct("n", F.col(cls).alias("c"))).over(whole)})
    limit = F.greatest(F.lit(2), F.floor(F.col("total") * share))
    return ranked.where((F.col("total") >= least) & (F.col("top.n") / F.col("total") >= dominant) & (F.col("n") <= limit) & (F.col(cls) != F.col("top.c"))).select(
        key, cls, "n", F.col("top.c").alias("dominant"), F.round(F.col("top.n") / F.col("total"), 6).alias("confidence")
    )


def variants(leaves: DataFrame, *, dominant: int = 5, rare: int = 2) -> DataFrame:
    """Spellings seen at most `rare` times whose folded key has a spelling seen at least `dominant` times."""
    values = leaves.where("jtype = 'string'").groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("key", X.text_key("value")).where("key <> ''")
    group = Window.partitionBy("path", "key")
    ranked = values.withColumn("top", F.max(F.struct("n", "value")).over(group))
    return ranked.where((F.col("top.n") >= dominant) & (F.col("n") <= rare) & (F.col("value") != F.col("top.value"))).select("path", "value", "n", F.col("top.value").alias("usual"), F.col("top.n").alias("usual_n"))


def rare_values(leaves: DataFrame, *, least: int = 20, unique: float = 0.2, count: int = 2, rate: float = 0.02) -> DataFrame:
    values = leaves.where("jtype <> 'null'").groupBy("path", "jtype", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("path")
    ranked = values.withColumns({"total": F.sum("n").over(whole), "kinds": F.count(F.lit(1)).over(whole)})
    return ranked.where((F.col("total") >= least) & (F.col("kinds") / F.col("total") <= unique) & (F.col("n") <= count) & (F.col("n") / F.col("total") <= rate)).select("path", "jtype", "value", "n")


def typo_candidates(values: DataFrame, *, rare: int = 2, common: int = 5) -> DataFrame:
    """values(field, value, n): rare spellings next to common ones with the same digit runs; the nearest suggestion each.

    Candidates meet on field, digit runs and a shared piece of the word (an edit of so few letters leaves one of the pieces
    whole), never on the field alone.
    """
    v = values.where(F.length(X.text_key("value")) >= 4).withColumns({"key": F.lower("value"), "digits": F.array_join(X.digit_runs("value"), "|")})
    size = F.length("key")
    bound = F.when(size < 8, 1).when(size < 80, 2).otherwise(3)
    # deletion neighbourhood by pieces: a text cut in bound + 1 pieces keeps one under `bound` edits, shifted by at most bound
    pieces = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("i"), F.substring(c, (F.floor(F.length(c) * i / 4) + 1).cast("int"), F.greatest(F.floor(F.length(c) * (i + 1) / 4) - F.floor(F.length(c) * i / 4), F.lit(1)).cast("int")).alias("piece")))
    few = v.where(F.col("n") <= rare).select("field", "digits", "value", "n", "key", bound.alias("bound"))
    many = v.where(F.col("n") >= common).select(F.col("field").alias("c_field"), F.col("digits").alias("c_digits"), F.col("value").alias("suggested"), F.col("n").alias("suggested_n"), F.col("key").alias("c_key"))
    cut = many.select("*", F.explode(pieces(F.col("c_key"))).alias("p")).select("*", F.col("p.piece").alias("c_piece")).drop("p")
    # every place where such a piece may stand in the rare spelling; lengths differ by three at most
    size_ = F.length("key")
    lengths = F.sequence(F.greatest(F.floor((size_ - 3) / 4), F.lit(1)).cast("int"), F.ceil((size_ + 3) / 4).cast("int"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size_ - n + 1, F.lit(1))), lambda s: F.substring(F.col("key"), s, n))
    grams = F.array_distinct(F.flatten(F.transform(lengths, at)))
    spread = few.select("*", F.explode(grams).alias("piece"))
    met = spread.join(cut, (F.col("field") == F.col("c_field")) & (F.col("digits") == F.col("c_digits")) & (F.col("piece") == F.col("c_piece")))
    met = met.where((F.col("suggested_n") >= 5 * F.col("n")) & (F.abs(F.length("key") - F.length("c_key")) <= 3)).dropDuplicates(["field", "value", "suggested"])
    near = met.withColumn("distance", F.levenshtein("key", "c_key", 3)).where((F.col("distance") >= 0) & (F.col("distance") <= F.greatest("bound", F.when(F.length("c_key") < 8, 1).when(F.length("c_key") < 80, 2).otherwise(3))))
    best = near.groupBy("field", "value").agg(F.min(F.struct("distance", (-F.col("suggested_n")).alias("neg"), "suggested")).alias("b"), F.first("n").alias("n"))
    return best.select("field", "value", "n", F.col("b.suggested").alias("suggested"), F.col("b.distance").cast("long").alias("distance"))


def learn_rules(pairs: DataFrame, *, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """pairs(relation, anchor, dependent, ordinal): dominant dependent of each anchor that has exceptions."""
    counts = pairs.groupBy("relation", "anchor", "dependent").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    group = Window.partitionBy("relation", "anchor")
    ranked = counts.withColumns({
        "support": F.sum("n").over(group),
        "nth": F.row_number().over(group.orderBy(F.col("n").desc(), "first")),
    })
    rules = ranked.where("nth = 1").withColumn("share", F.col("n") / F.col("support"))
    return rules.where((F.col("support") >= support) & (F.col("share") >= confidence) & (F.col("n") < F.col("support"))).select(
        "relation", "anchor", "dependent", "support", F.round("share", 6).alias("confidence"), (F.col("support") - F.col("n")).alias("exceptions")
    )


def rule_exceptions(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    r = rules.select(F.col("relation").alias("r_relation"), F.col("anchor").alias("r_anchor"), F.col("dependent").alias("expected"), "support", "confidence")
    met = pairs.join(r, (F.col("relation") == F.col("r_relation")) & (F.col("anchor") == F.col("r_anchor")) & (F.col("dependent") != F.col("expected")))
    return met.select("relation", "ordinal", "anchor", "dependent", "expected", X.outlier_severity(F.col("confidence"), F.col("support")).alias("severity"))


def dedupe_issues(issues: DataFrame, key: Sequence[str] = ("sample_id", "code", "field", "message")) -> DataFrame:
    """One issue for each key: the most severe, then the earliest emitted."""
    best = F.max_by(F.struct(*[c for c in issues.columns if c not in key]), F.struct(F.col("severity"), -F.col("emit_order")))
    return issues.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def risk(issues: DataFrame) -> DataFrame:
    """sample_id, risk: the highest severity plus 0.12 of the next four, at most 100, rounded half to even."""
    ranked = issues.groupBy("sample_id").agg(F.sort_array(F.collect_list("severity"), asc=False).alias("s"))
    score = F.col("s")[0] + 0.12 * F.aggregate(F.slice("s", 2, 4), F.lit(0.0), lambda a, x: a + x)
    return ranked.select("sample_id", F.size("s").cast("long").alias("n_issues"), F.least(F.lit(100), F.bround(score).cast("int")).alias("risk"))


def risk_level(score: Column, high: int = 70) -> Column:
    return F.when(score.isNull(), "clean").when(score >= high, "high").when(score >= 40, "medium").otherwise("low")


def nearest_peers(features: DataFrame, *, limit: int = 3) -> DataFrame:
    """features(sample_id, feature, weight): for each sample its `limit` peers of the highest weighted Jaccard similarity
    (ties: the smaller id); a peer shares at least one feature.

    Samples with equal features form a class. Classes meet over an inverted index of features, each with its few smallest
    members, so copies are never expanded into pairs; a sample takes its peers from the classes that its own class met.
    """
    classes = features.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.struct("feature", "weight"))).alias("set"))
    classes = classes.withColumn("class", F.xxhash64("set"))
    known = classes.groupBy("class").agg(F.first("set").alias("set"), F.slice(F.array_sort(F.collect_set("sample_id")), 1, limit + 1).alias("least"))
    total = F.aggregate("set", F.lit(0.0), lambda a, x: a + x["weight"])
    index = known.select("class", total.alias("total"), "least", F.inline("set"))
    left = index.select(F.col("class").alias("l"), F.col("total").alias("l_total"), "feature", "weight")
    right = index.select(F.col("class").alias("r"), F.col("total").alias("r_total"), F.col("feature").alias("r_feature"), F.col("least"))
    met = left.join(right, F.col("feature") == F.col("r_feature")).groupBy("l", "r").agg(F.sum("weight").alias("shared"), F.first("l_total").alias("a"), F.first("r_total").alias("b"), F.first("least").alias("least"))
    scored = met.select("l", F.round(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")), 6).alias("score"), F.explode("least").alias("peer"))
    nth = F.row_number().over(Window.partitionBy("l").orderBy(F.col("score").desc(), "peer"))
    top = scored.withColumn("nth", nth).where(F.col("nth") <= limit + 1).select("l", "score", "peer")
    each = classes.select("sample_id", "class").join(top, F.col("class") == F.col("l")).where("sample_id <> peer")
    own = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("score").desc(), "peer"))
    return each.withColumn("nth", own).where(F.col("nth") <= limit).select("sample_id", "peer", "score", F.col("nth").cast("long").alias("nth"))
