"""Connected components by alternating large-star and small-star steps over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import delete, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root): every node of an edge except the roots, with the smallest node of its component.

    Each round is written to the shared folder. A hot node's edges are never gathered: minima are pre-aggregated, and
    the join back to the edges is one that adaptive execution splits. A round's table goes once the next one is written.

    Defined results: rows with a null end link nothing and are left out; repeated edges and edges of a node with itself
    change nothing; extra columns are ignored; no edges: no rows.
    """
    spark = edges.sparkSession
    now = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        met = large.join(low, large["u"] == low["k"])
        pairs = met.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last = now.inputFiles()
        now = materialise(pairs.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        delete(spark, {f.rsplit("/", 1)[0] for f in last})
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
