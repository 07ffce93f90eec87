"""Quality rules with risk-controlled thresholds.

Every document gets a few measures (shares of symbols, repeated lines, repeated words, capitals, exclamation marks). Its
excess is the largest of them in units of its rule's scale (RULES), so one cutoff of the excess is a cutoff for every rule
at once, and a document is rejected if any rule rejects it. Cutoffs come from the labelled good documents: within a stratum
(language) the cutoff walks one ladder from loose to strict, tests at each step the hypothesis "this cutoff rejects more
than alpha of the good documents" with the exact binomial tail, and stops at the first step it cannot refute. The fixed
order keeps the error of a ladder at its level; the level is delta divided by the number of ladders, one for each stratum
that has labels enough to refute anything (their count alone decides). So with probability 1 - delta no stratum loses
more than alpha of its good documents to all rules together. Of the certified cutoffs the most useful one is taken (bad
documents caught, less COST for each good one rejected), or none. A stratum with too few labels gets no cutoff and loses
nothing to the rules.

Only DataFrame functions run. Defined results: null or empty text: no words, all counts 0, base_failed true. Null lang:
a stratum of its own. Labels that are null, or of unknown documents, are left out; a document labelled more than once
takes its larger label, and an id that several rows have counts once, with their largest excess. Repeated rows: one result
each. Extra columns are ignored. Empty tables: empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docaudit.llm.common import UPPER, broadcast_within, let, materialise, split_words, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Per stratum: the share of good documents that all rules together may reject, and the chance of exceeding it.
ALPHA, DELTA = 0.02, 0.05
LADDER = (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
#: Bad documents that one rejected good document weighs when a cutoff is chosen among the certified ones.
COST = 10
#: Rule: its value, from the counts of one document, and the scale at which it is usually held to be too much.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.1),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.3),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.2),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.3),
    "shouts": ("n_shouts / greatest(word_chars, 1)", 0.02),
}
#: The largest of the rules' values in units of their scales.
EXCESS = "greatest(" + ", ".join(f"({value}) / {scale}D" for value, scale in RULES.values()) + ")"


def _covered(windows: Column) -> Column:
    """Words that lie in a 3-word window whose hash occurs at least twice: windows are sorted with their positions, equal
    neighbours mark positions, and each marked position adds the up to three words before the next one."""
    tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        hit = F.filter(s, lambda x, j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(let(tagged, positions), total)


def repeated_words(words: Column) -> Column:
    """words: array. Count of the words in 3-word windows found twice or more in the text."""
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_shouts."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"))

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    found = let(split_words(text), lambda words: let(worded, lambda lines: counts(words, lines)))
    base = docs.select(*keep, found.alias("m"), F.length(F.translate(text, " \t\n\x0b\f\r", "")).alias("word_chars"), _without(text, SYMBOLS).alias("n_symbols"), _without(text, UPPER).alias("n_capitals"), _without(text, "!").alias("n_shouts"))
    as_long = lambda c, name: F.col(c).cast("long").alias(name)
    return base.select(*keep, as_long("m.n_words", "n_words"), as_long("word_chars", "word_chars"), as_long("n_symbols", "n_symbols"), as_long("m.n_lines", "n_lines"), as_long("m.n_dup_lines", "n_dup_lines"), as_long("m.n_repeat_words", "n_repeat_words"), as_long("n_capitals", "n_capitals"), as_long("n_shouts", "n_shouts"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) with k < n p, exactly: the term at k from logarithms, those below it by their ratios."""
    log_choose = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
    at_k = log_choose + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def below(a: Column, i: Column) -> Column:
        term = a["term"] * i / (n - i + 1) * F.lit((1.0 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    steps = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(at_k) * F.aggregate(steps, start, below, lambda a: a["sum"]))


def cutoffs(measured: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, ladder: Sequence[float] = LADDER) -> DataFrame:
    """For each stratum its cutoff of the excess: stratum, cutoff, good, rejected, caught (bad ones), p_value. Of the
    certified cutoffs the one that catches most bad documents, a rejected good one weighing COST of them (ties: the loosest);
    none that gains nothing."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("l_id")).agg((F.max("quality") == 1).alias("fine"))
    held = measured.where(~base_failed()).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.expr(EXCESS).alias("excess"))
    held = held.join(known, F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min("stratum").alias("stratum"), F.max("excess").alias("excess"), F.first("fine").alias("fine"))
    counted = held.groupBy("stratum").agg(
        F.count_if("fine").alias("good"),
        F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.count_if(F.col("fine") & (F.col("excess") > c)).alias("rejected"), F.count_if(~F.col("fine") & (F.col("excess") > c)).alias("caught")) for c in ladder]).alias("tests"),
    )
    # strata that could pass with no rejection at the whole level; before the tests multiply the rows
    counted = counted.where(F.pow(F.lit(1.0 - alpha), F.col("good")) <= delta)
    counted = counted.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
    tested = counted.select("stratum", "good", "strata", F.inline("tests"))
    k, n = F.col("rejected"), F.col("good")
    tested = tested.withColumn("p_value", F.when(k >= n * alpha, F.lit(1.0)).otherwise(binomial_tail(k, n, alpha)))
    walk = Window.partitionBy("stratum").orderBy(F.col("cutoff").desc())
    passed = tested.withColumn("ok", F.min((F.col("p_value") <= delta / F.col("strata")).cast("int")).over(walk)).where("ok = 1")
    gained = passed.withColumn("gain", F.col("caught") - COST * F.col("rejected")).where("gain > 0")
    best = Window.partitionBy("stratum").orderBy(F.col("gain").desc(), F.col("cutoff").desc())
    return gained.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("stratum", "cutoff", "good", "rejected", "caught", "p_value")


def apply_cutoffs(measured: DataFrame, cuts: DataFrame, *, stratum: str = "lang", strata_broadcast: int = 10_000) -> DataFrame:
    """measured with base_failed and kept."""
    known = cuts.select(F.col("stratum").alias("c_stratum"), F.col("cutoff").alias("c_cutoff"))
    out = measured.join(broadcast_within(known, strata_broadcast), F.coalesce(F.col(stratum), F.lit("")) == F.col("c_stratum"), "left")
    rejected = F.coalesce(F.expr(EXCESS) > F.col("c_cutoff"), F.lit(False))
    return out.select(*[measured[c] for c in measured.columns], base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    measured = materialise(measures(docs), "rule-measures")
    cuts = materialise(cutoffs(measured, labels, **options), "rule-cutoffs")
    return apply_cutoffs(measured, cuts)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), tri AS (
  SELECT doc_id, i, w[i : i + 2] AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest([i, i + 1, i + 2]) AS u(p) GROUP BY doc_id
), m AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(t) - length(translate(t, '!', '')) AS n_shouts
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), v AS (
  SELECT *, greatest(n_symbols / greatest(word_chars, 1) / 0.1::DOUBLE, n_dup_lines / greatest(n_lines, 1) / 0.3::DOUBLE, n_repeat_words / greatest(n_words, 1) / 0.2::DOUBLE,
                     n_capitals / greatest(word_chars, 1) / 0.3::DOUBLE, n_shouts / greatest(word_chars, 1) / 0.02::DOUBLE) AS x
  FROM f
), l AS (
  SELECT doc_id, min(stratum) AS stratum, max(x) AS x, max(quality) AS quality FROM v JOIN labels USING (doc_id) WHERE quality IN (0, 1) AND NOT base_failed GROUP BY doc_id
), n AS (
  SELECT stratum, count(*) AS n FROM l WHERE quality = 1 GROUP BY stratum HAVING 0.98 ** count(*) <= 0.05
), c AS (
  SELECT stratum, cut, n, count(*) FILTER (quality = 1 AND x > cut) AS k, count(*) FILTER (quality = 0 AND x > cut) AS caught
  FROM l JOIN n USING (stratum), unnest([4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5]::DOUBLE[]) AS u(cut) GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN k >= n * 0.02 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.02) + (n - i) * ln(0.98))) FROM unnest(generate_series(0, k)) AS u(i)) END AS pv FROM c
), s AS (
  SELECT *, min(CASE WHEN pv <= 0.05 / (SELECT count(*) FROM n) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum ORDER BY cut DESC) AS ok FROM p
), cuts AS (
  SELECT stratum, cut FROM s WHERE ok = 1 AND caught - 10 * k > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught - 10 * k DESC, cut DESC) = 1
), rejected AS (
  SELECT doc_id FROM v JOIN cuts USING (stratum) WHERE x > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM f LEFT JOIN (SELECT DISTINCT doc_id FROM rejected) rejected USING (doc_id)
"""
