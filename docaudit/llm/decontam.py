"""Benchmark decontamination by a prefix-filtered set join.

Item windows are `size` consecutive item words (an item of fewer words, but not none, is one window). The words of a
window are ordered by rarity in the corpus, counted over all documents. A text that contains a window contains every
word of it, so the window's rarest word is a necessary prefix: only positions that hold it become candidates. The
word's place in the window gives the one possible start (positional bound), the document's length must hold the
whole window (length bound), and the candidate is confirmed by comparing the item-sized slice of words exactly.

Only DataFrame functions run. Windows and item words are broadcast if their checked number lies within `broadcast_rows`:
they meet the words where these are read, no text is shuffled, and each document sends one marker row besides its hits.
Beyond the bound each word that may be a window's rarest one is shuffled with the words around it (2 * size - 1 at most), so
the bytes moved grow with the text and no faster; the result is the same. The items of a window stay rows of their own.

Defined results: null or empty text: no words, not contaminated. Null item text or id: no windows. Repeated document rows:
one result each. Repeated item ids: one item. Extra columns are ignored, and kept by the filter whatever their names. Empty
benchmark: nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import broadcast_within, fresh, lower_ascii, materialise, small, split_words, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW = 10


def _words(column: str):
    return split_words(lower_ascii(F.col(column)), SEPARATORS)


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """key (the window's words, joined by spaces), window array<string>, item_id: each window of each item once."""
    worded = benchmark.where("item_id IS NOT NULL").select("item_id", _words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = worded.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
    return each.select(F.array_join("window", " ").alias("key"), "window", "item_id").distinct()


def word_counts(docs: DataFrame, vocabulary: DataFrame, broadcast_rows: int) -> DataFrame:
    """word, n: corpus counts of the words in vocabulary(word), over all documents."""
    words = docs.select(F.explode(_words("text")).alias("word"))
    if small(vocabulary, broadcast_rows):
        return words.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left_semi")


def prefix_index(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """word, offset, window, key: each window under its rarest word (ties: the smaller word, then the first place)."""
    placed = windows.select("key", F.posexplode("window").alias("offset", "word"))
    ranked = placed.join(counts, "word", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest"))
    return ranked.select(F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"), F.split("key", " ").alias("window"), "key")


def _hits(docs: DataFrame, index: DataFrame, size: int, broadcast_rows: int) -> DataFrame:
    """doc_id, text_key, n_words, start, size, key of every window found; and for each document a row of size 0."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.concat(F.array(F.lit("")), _words("text")).alias("w"))
    n_words = (F.size("w") - 1).alias("n_words")
    none = [F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("key")]
    start = F.col("place") - F.col("offset")
    if small(index, broadcast_rows):
        # every document has the empty marker word at place 0; no real word is empty
        marker = F.inline(F.array(F.struct(F.lit("").alias("word"), F.lit(0).alias("offset"), F.array().cast("array<string>").alias("window"), F.lit("").alias("key"))))
        known = index.unionByName(docs.sparkSession.range(1).select(marker))
        placed = texts.select("doc_id", "text_key", "w", F.posexplode("w").alias("place", "word"))
        found = (start >= 1) & (start + F.size("window") <= F.size("w")) & (F.slice("w", start + 1, F.greatest(F.size("window"), F.lit(1))) == F.col("window"))
        met = placed.join(F.broadcast(known), "word").where((F.size("window") == 0) | found)
        return met.select("doc_id", "text_key", n_words, start.alias("start"), F.size("window").alias("size"), "key")
    placed = texts.select("doc_id", "text_key", "w", F.posexplode("w").alias("place", "word")).where("place > 0")
    placed = placed.join(broadcast_within(index.select("word").distinct(), broadcast_rows), "word", "left_semi") if small(index.select("word").distinct(), broadcast_rows) else placed
    low = F.greatest(F.col("place") - (size - 1), F.lit(1))
    near = placed.select("doc_id", "text_key", n_words, "place", "word", low.alias("low"), F.slice("w", low + 1, F.lit(2 * size - 1)).alias("near"))
    from_ = start - F.col("low") + 1
    found = (start >= F.col("low")) & (from_ + F.size("window") - 1 <= F.size("near")) & (F.slice("near", F.greatest(from_, F.lit(1)), F.size("window")) == F.col("window"))
    met = near.join(index, "word").where(found).select("doc_id", "text_key", "n_words", start.alias("start"), F.size("window").alias("size"), "key")
    return met.unionByName(texts.select("doc_id", "text_key", n_words, *none))


def contamination(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, broadcast_rows: int = 500_000) -> DataFrame:
    """For each row of docs: doc_id, text_key (a hash of the text), n_words, n_hit, items (sorted strings)."""
    windows = materialise(item_windows(benchmark, size), "item-windows")
    distinct = windows.select("key", "window").distinct()
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    index = materialise(prefix_index(distinct, word_counts(docs, vocabulary, broadcast_rows)), "prefix-index")
    hits = _hits(docs, index, size, broadcast_rows)
    found = hits.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("size") == 0).alias("copies"),
        F.collect_set(F.when(F.col("size") > 0, F.struct("start", "size"))).alias("spans"),
        F.collect_set(F.when(F.col("size") > 0, F.col("key"))).alias("keys"),
    )
    # spans sorted by start: each adds the words beyond the furthest end before it
    furthest = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    found = materialise(found.select("doc_id", "text_key", "n_words", "copies", furthest.cast("long").alias("n_hit"), "keys"), "hits")
    names = windows.select(F.col("key").alias("w_key"), F.col("item_id").cast("string").alias("item"))
    named = found.where("n_hit > 0").select("doc_id", "text_key", "n_words", "copies", "n_hit", F.explode("keys").alias("key"))
    named = named.join(broadcast_within(names, broadcast_rows), F.col("key") == F.col("w_key")).groupBy("doc_id", "text_key").agg(
        *[F.max(c).alias(c) for c in ("n_words", "copies", "n_hit")], F.array_sort(F.collect_set("item")).alias("items")
    )
    clean = found.where("n_hit = 0").select("doc_id", "text_key", "n_words", "copies", "n_hit", F.array().cast("array<string>").alias("items"))
    out = clean.unionByName(named)
    return out.select("doc_id", "text_key", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with their columns. Nulls, repeated rows, empty tables and names as above."""
    an_id, a_key = fresh(docs, "__id"), fresh(docs, "__key")
    found = materialise(contamination(docs.select("doc_id", "text"), benchmark).where("n_hit > 0").select(F.col("doc_id").alias(an_id), F.col("text_key").alias(a_key)).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(an_id)) & (F.xxhash64(docs["text"]) == F.col(a_key)), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT item_id, w[s : s + 9] AS win FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS k FROM win
), dw AS (
  SELECT doc_id, s, w[s : s + k - 1] AS win FROM d, sizes, unnest(generate_series(1, len(w) - k + 1)) AS t(s)
), hit AS (
  SELECT doc_id, s, len(dw.win) AS k, item_id FROM dw JOIN win USING (win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(s, s + k - 1)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
