"""Location completion: `CITY` becomes `CITY, suffix` where completed examples with a similar context agree.

Suffix spellings are clustered first (equal after folding, or one containing the other); the cluster's most frequent and
best written spelling stands for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docaudit.functions import text as X


def suffix_aliases(suffixes: DataFrame, *, contained: int = 6, rounds: int = 30) -> DataFrame:
    """suffixes(suffix, n) -> suffix, canonical. Distinct suffixes are few (countries); equivalent ones meet on the first
    letters of their key or on a key that contains the other, and the least key of a cluster spreads in a few rounds."""
    s = suffixes.groupBy("suffix").agg(F.sum("n").alias("n")).withColumn("key", X.text_key("suffix")).where("key <> ''")
    keys = s.select("key").distinct()
    # all pieces of a key that are long enough, so that containment is an equi-join
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.transform(F.sequence(i, F.length("key")), lambda j: F.substring(F.col("key"), i, j - i + 1)))))
    holds = keys.select(F.col("key").alias("long"), F.explode(F.filter(pieces, lambda p: F.length(p) >= contained)).alias("short"))
    edges = holds.join(keys, F.col("short") == F.col("key")).where("long <> short").select(F.col("long").alias("a"), F.col("short").alias("b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).cache()
    label = keys.withColumn("root", F.col("key"))
    for _ in range(rounds):
        spread = both.join(label, F.col("b") == F.col("key")).groupBy("a").agg(F.min("root").alias("near"))
        met = label.join(spread, F.col("key") == F.col("a"), "left")
        new = met.select("key", F.least("root", F.coalesce("near", "root")).alias("root"), (F.coalesce("near", "root") < F.col("root")).alias("moved")).cache()
        if not new.where("moved").limit(1).count():
            break
        label = new.select("key", "root")
    name = X.strip("suffix")
    shouted = name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}")
    odd = F.length(F.regexp_replace(name, r"(?U)[\w\s.-]", ""))
    # the most frequent, then the best written: capital first, not all capitals, few odd characters, short
    quality = F.struct(F.col("n"), name.rlike(r"^\p{Lu}").cast("int"), (~shouted).cast("int"), -odd, -F.length(name), "suffix")
    known = s.join(label.select(F.col("key").alias("l_key"), "root"), F.col("key") == F.col("l_key"))
    best = known.groupBy(F.col("root").alias("b_root")).agg(F.max_by("suffix", quality).alias("canonical"))
    return known.join(best, F.col("root") == F.col("b_root")).select("suffix", "canonical")


def completed(rows: DataFrame) -> DataFrame:
    """rows(id, place, ...) that are complete, with city, city_key and suffix."""
    parts = X.location_parts("place")
    return rows.withColumn("l", parts).where("l.suffix IS NOT NULL").select("*", F.col("l.city").alias("city"), X.text_key("l.city").alias("city_key"), F.col("l.suffix").alias("suffix")).drop("l")


def location_rules(examples: DataFrame) -> DataFrame:
    """city_key, suffix, support, and the competitors of each as `suffix (n)`, most frequent first."""
    counts = examples.groupBy("city_key", "suffix").agg(F.count(F.lit(1)).alias("support"))
    whole = counts.groupBy(F.col("city_key").alias("c_key")).agg(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("neg"), "suffix"))).alias("all"))
    met = counts.join(whole, F.col("city_key") == F.col("c_key"))
    rivals = F.transform(F.filter("all", lambda x: x["suffix"] != F.col("suffix")), lambda x: F.concat(x["suffix"], F.lit(" ("), (-x["neg"]).cast("string"), F.lit(")")))
    return met.select("city_key", "suffix", "support", F.array_join(rivals, ", ").alias("competitors"))


def propose(
    candidates: DataFrame, examples: DataFrame, context: Column, c_profile: Sequence[str], profile: Sequence[str], *, support: int = 2, confidence: float = 0.6, strong: float = 10.0, weak: float = 5.0
) -> DataFrame:
    """candidates(c_id, c_key, ...) and examples(id, city_key, suffix, ...), matched on the city: for each candidate the
    winning suffix with its confidence, support and best context, and whether it is accepted.

    context: the similarity of a candidate's profile (c_profile) to an example's (profile). Examples, and candidates, of one city and
    profile are counted together before they meet, so a hot city costs pairs of profiles, not of documents.
    """
    asked = candidates.select("c_key", *c_profile).distinct()
    known = examples.groupBy("city_key", "suffix", *profile).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"))
    met = asked.join(known, F.col("c_key") == F.col("city_key")).withColumn("context", context)
    per = met.groupBy("c_key", *c_profile, "suffix").agg(F.sum("n").alias("support"), F.max("context").alias("context"), F.max_by("id", F.struct("context", "id")).alias("evidence"))
    score = 1 + F.col("context") + 2 * F.log2(1 + F.col("support"))
    order = F.row_number().over(Window.partitionBy("c_key", *c_profile).orderBy(F.col("score").desc(), F.col("support").desc(), "suffix"))
    ranked = per.withColumn("score", F.round(score, 9)).withColumns({"share": F.col("score") / F.sum("score").over(Window.partitionBy("c_key", *c_profile)), "nth": order}).where("nth = 1")
    ok = (F.col("share") >= confidence) & ((F.col("support") >= support) | (F.col("context") >= strong)) & (F.col("context") >= weak)
    won = ranked.select(*[F.col(c).alias(f"w_{c}") for c in ("c_key", *c_profile)], "suffix", "support", "context", "evidence", "share", ok.alias("accepted"))
    same = F.lit(True)
    for c in ("c_key", *c_profile):
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    return candidates.join(won, same).select("c_id", "suffix", "support", "context", "evidence", F.round("share", 6).alias("confidence"), "accepted")
