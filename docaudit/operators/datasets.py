"""Dataset building: pairing of files, orphans, splits, first-wins, manifests, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docaudit.functions import text as X


def candidate_names(stem: Column) -> Column:
    """array<struct<priority, in_truths, name>>: annotation stems that an image stem may have, best first."""
    short = X.strip_dpi(stem)
    place = lambda p, t, n: F.struct(F.lit(p).alias("priority"), F.lit(t).alias("in_truths"), n.alias("name"))
    return F.array(
        place(1, False, stem), place(2, False, F.concat(stem, F.lit("_0"))), place(4, True, stem), place(5, True, F.concat(F.lit("gt_"), stem)),
        place(6, True, short), place(7, True, F.concat(F.lit("gt_"), short)),
    )


def pair_files(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """images(dir, stem), annotations(dir, stem, truths): the best annotation for each image, by priority.

    Exact names are an equi-join on candidate names; the wildcard rule (`stem_*`) is one as well: annotations offer every
    prefix of theirs that ends before an underscore.
    """
    wanted = images.select("dir", "stem", F.inline(candidate_names(F.col("stem"))))
    a = annotations.select(F.col("dir").alias("a_dir"), F.col("stem").alias("a_stem"), F.col("truths").alias("a_truths"))
    exact = wanted.join(a, (F.col("dir") == F.col("a_dir")) & (F.col("name") == F.col("a_stem")) & (F.col("in_truths") == F.col("a_truths"))).select("dir", "stem", "priority", "a_stem", "a_truths")
    parts = F.split("a_stem", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    offered = a.where(~F.col("a_truths") & F.col("a_stem").contains("_")).select("a_dir", "a_stem", "a_truths", F.explode(prefixes).alias("prefix"))
    wild = images.join(offered, (F.col("dir") == F.col("a_dir")) & (F.col("stem") == F.col("prefix"))).select("dir", "stem", F.lit(3).alias("priority"), "a_stem", "a_truths")
    best = exact.unionByName(wild).groupBy("dir", "stem").agg(F.min(F.struct("priority", "a_stem", "a_truths")).alias("b"))
    return best.select("dir", "stem", F.col("b.priority").alias("priority"), F.col("b.a_stem").alias("annotation"), F.col("b.a_truths").alias("truths"))


def orphans(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """kind, dir, stem of images without annotation and of annotations that no image takes."""
    pairs = pair_files(images, annotations)
    alone = images.join(pairs, ["dir", "stem"], "left_anti").select(F.lit("image").alias("kind"), "dir", "stem")
    used = pairs.select("dir", F.col("annotation").alias("stem"), "truths")
    left = annotations.join(used, ["dir", "stem", "truths"], "left_anti").select(F.lit("annotation").alias("kind"), "dir", "stem")
    return alone.unionByName(left)


def split_by_rank(rows: DataFrame, key: Column, ratios: Sequence[tuple[str, float]], total: int) -> DataFrame:
    """rows with split: the first floor(total * ratio) rows in the order of key, and so on; the last split takes the rest.

    Ranks come from counts by key range rather than one global window, so no task sees all rows.
    """
    if abs(sum(r for _, r in ratios) - 1) > 1e-9 or any(r < 0 for _, r in ratios):
        raise ValueError("split ratios must be positive and sum to 1")
    ranged = rows.withColumn("__key", key).withColumn("__bucket", F.shiftright("__key", 20))
    sizes = ranged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", *rows.columns[:1]))
    ranked = ranged.join(before.select("__bucket", "__before"), "__bucket").withColumn("__nth", nth)
    split, edge = F.lit(None).cast("string"), 0
    for name, ratio in ratios[:-1]:
        edge += int(total * ratio)
        split = F.coalesce(split, F.when(F.col("__nth") <= edge, name))
    return ranked.withColumn("split", F.coalesce(split, F.lit(ratios[-1][0]))).drop("__key", "__bucket", "__n", "__before", "__nth")


def with_ordinal(rows: DataFrame, order: str) -> DataFrame:
    """rows with ordinal, from 0, in the order of an integer column: sizes of key ranges first, then ranks within a range."""
    span = rows.agg(F.min(order).alias("low"), ((F.max(order) - F.min(order)) / 1024 + 1).cast("bigint").alias("width")).first()
    low, width = span["low"] or 0, span["width"] or 1
    ranged = rows.withColumn("__r", F.floor((F.col(order) - low) / width))
    sizes = ranged.groupBy("__r").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__r").alias("__b"), F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    met = ranged.join(before, F.col("__r") == F.col("__b"))
    nth = F.row_number().over(Window.partitionBy("__r").orderBy(order)).cast("bigint")
    return met.withColumn("ordinal", F.col("__before") + nth - 1).drop("__r", "__b", "__before")


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; a pre-aggregated minimum, not a window over hot keys."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*key, "b.*")


def as_of(history: DataFrame, asked: DataFrame, *, by: str = "metric") -> DataFrame:
    """history(metric, ordinal, step, value), asked(metric, at): the value at that step, else the last one logged at an
    earlier step; order is that of the log (ordinal), not of the step. Steps are pre-aggregated, then a running maximum of the
    ordinal over the steps of a metric answers all questions in one pass."""
    steps = history.where("value IS NOT NULL").groupBy(by, "step").agg(F.max(F.struct("ordinal", "value")).alias("last"))
    q = asked.select(F.col(by).alias("q_by"), "at").distinct()
    # steps and questions of a metric in one order: a running maximum of the log ordinal over earlier steps
    line = steps.select(F.col(by).alias("m"), F.col("step").alias("s"), F.lit(0).alias("kind"), "last").unionByName(q.select(F.col("q_by").alias("m"), F.col("at").alias("s"), F.lit(1).alias("kind"), F.lit(None).cast(steps.schema["last"].dataType).alias("last")))
    running = Window.partitionBy("m").orderBy("s", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumns({"best": F.max("last").over(running), "same": F.max(F.when(F.col("kind") == 0, F.struct("s", "last"))).over(running)})
    value = F.when(F.col("same.s") == F.col("s"), F.col("same.last.value")).otherwise(F.col("best.value"))
    return found.where("kind = 1").select(F.col("m").alias(by), F.col("s").alias("at"), value.alias("value"))
