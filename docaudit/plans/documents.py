"""Derived inputs of the catalogue: true and predicted order documents, and mixed-type leaves, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.jsonx import Contract, contract_leaves
from docaudit.plans.registry import table

ORDER = Contract(("ref", "customer.name", "customer.city", "customer.segment"), "items", ("qty", "part"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # the items of one order are few; the sort happens within the aggregated array
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_name")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").alias("i_key")).agg(F.array_sort(F.collect_list(item)).alias("lines"))


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, truth_json, prediction_json: the document of each order, and a perturbed prediction of it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.join(_items(spark, sf_dir), F.col("o_orderkey") == F.col("i_key"), "left")
    k = F.col("o_orderkey")
    lines = F.coalesce("lines", F.array().cast(base.schema["lines"].dataType))
    name = F.when(k % 7 == 0, F.upper("c_name")).when(k % 17 == 0, F.concat(F.expr("left(c_name, length(c_name) - 1)"), F.lit("X"))).otherwise(F.col("c_name"))
    ref = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(k.cast("string"))
    seen = F.when(k % 9 == 0, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    null = {"ignoreNullFields": "false"}
    quote = lambda c: F.to_json(F.array(c), null).substr(F.lit(2), F.length(F.to_json(F.array(c), null)) - 2)
    whole = lambda x: x["l_quantity"].cast("bigint").cast("string")

    def document(ref_, name_, city, segment, items) -> F.Column:
        return F.concat(F.lit('{"ref":'), quote(ref_), F.lit(',"customer":{"name":'), quote(name_), F.lit(',"city":'), quote(city), F.lit(',"segment":'), quote(segment), F.lit('},"items":['), F.array_join(items, ","), F.lit("]}"))

    entry = lambda x, q: F.concat(F.lit('{"qty":'), q, F.lit(',"part":'), F.to_json(F.array(x["p_name"])).substr(F.lit(2), F.length(F.to_json(F.array(x["p_name"]))) - 2), F.lit("}"))
    true_items = F.transform(lines, lambda x: entry(x, whole(x)))
    seen_items = F.transform(seen, lambda x, i: entry(x, F.when(i % 2 == 1, F.concat(F.lit('"'), whole(x), F.lit('"'))).otherwise(whole(x))))
    truth = document(k.cast("string"), F.col("c_name"), F.col("n_name"), F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")), true_items)
    segment = F.when(k % 10 == 0, F.lit("INVENTED")).when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    prediction = F.when(k % 19 == 0, F.lit("not json")).otherwise(document(ref, name, F.when(k % 6 == 0, F.lit("")).otherwise(F.col("n_name")), segment, seen_items))
    return base.select(k.alias("k"), truth.alias("truth_json"), prediction.alias("prediction_json"))


def order_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, parsed, truth and prediction (leaf maps), with the parsed VARIANTs t_doc and p_doc."""
    parsed = order_pairs(spark, sf_dir).select("k", F.try_parse_json("truth_json").alias("t_doc"), F.try_parse_json("prediction_json").alias("p_doc"))
    return parsed.select("k", F.col("p_doc").isNotNull().alias("parsed"), "t_doc", "p_doc", contract_leaves(F.col("t_doc"), ORDER).alias("truth"), contract_leaves(F.col("p_doc"), ORDER).alias("prediction"))


#: The same inputs for DuckDB: t and p hold (k, path, jt, v); docs has every order.
DOCS_SQL = r"""
docs AS (
  SELECT o_orderkey AS k, c_name, n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), li AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
         count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT k FROM docs)
), t AS (
  SELECT k, 'ref' AS path, 'string' AS jt, CAST(k AS VARCHAR) AS v FROM docs
  UNION ALL SELECT k, 'customer.name', 'string', c_name FROM docs
  UNION ALL SELECT k, 'customer.city', 'string', n_name FROM docs
  UNION ALL SELECT k, 'customer.segment', CASE WHEN k % 5 = 0 THEN 'null' ELSE 'string' END, CASE WHEN k % 5 = 0 THEN NULL ELSE c_mktsegment END FROM docs
  UNION ALL SELECT k, 'items[' || i || '].qty', 'integer', qty FROM li
  UNION ALL SELECT k, 'items[' || i || '].part', 'string', p_name FROM li
), p AS (
  SELECT k, 'ref' AS path, CASE WHEN k % 11 = 0 THEN 'null' ELSE 'string' END AS jt,
         CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '0' || CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS v FROM docs WHERE k % 19 <> 0
  UNION ALL SELECT k, 'customer.name', 'string', CASE WHEN k % 7 = 0 THEN upper(c_name) WHEN k % 17 = 0 THEN left(c_name, length(c_name) - 1) || 'X' ELSE c_name END FROM docs WHERE k % 19 <> 0
  UNION ALL SELECT k, 'customer.city', 'string', CASE WHEN k % 6 = 0 THEN '' ELSE n_name END FROM docs WHERE k % 19 <> 0
  UNION ALL SELECT k, 'customer.segment', CASE WHEN k % 10 = 0 THEN 'string' WHEN k % 5 = 0 THEN 'null' ELSE 'string' END,
         CASE WHEN k % 10 = 0 THEN 'INVENTED' WHEN k % 5 = 0 THEN NULL ELSE c_mktsegment END FROM docs WHERE k % 19 <> 0
  UNION ALL SELECT k, 'items[' || i || '].qty', CASE WHEN i % 2 = 1 THEN 'string' ELSE 'integer' END, qty FROM li WHERE k % 19 <> 0 AND NOT (k % 9 = 0 AND i = n - 1)
  UNION ALL SELECT k, 'items[' || i || '].part', 'string', p_name FROM li WHERE k % 19 <> 0 AND NOT (k % 9 = 0 AND i = n - 1)
)"""

#: Canonical kind and text of a leaf, as a DuckDB macro-free expression over (jt, v).
CANON_SQL = r"""
CASE WHEN {jt} IS NULL OR {jt} = 'null' THEN 'null|' WHEN {jt} = 'integer' THEN 'number|' || {v}
     WHEN regexp_full_match(lower(trim(regexp_replace({v}, '\s+', ' ', 'g'))), '-?(0|[1-9][0-9]*)(\.[0-9]+)?')
       THEN 'number|' || regexp_replace(lower(trim(regexp_replace({v}, '\s+', ' ', 'g'))), '\.0+$|(\.[0-9]*?)0+$', '\1')
     ELSE 'string|' || lower(trim(regexp_replace({v}, '\s+', ' ', 'g'))) END"""

PAIRS_SQL = f"""
WITH {DOCS_SQL}, j AS (
  SELECT coalesce(t.k, p.k) AS k, coalesce(t.path, p.path) AS path, t.jt AS t_type, t.v AS t_value, p.jt AS p_type, p.v AS p_value
  FROM t FULL OUTER JOIN p ON t.k = p.k AND t.path = p.path
), c AS (
  SELECT *, {CANON_SQL.format(jt="t_type", v="t_value")} AS tc, {CANON_SQL.format(jt="p_type", v="p_value")} AS pc,
         t_type IS NULL OR t_type = 'null' OR (t_type = 'string' AND trim(t_value) = '') AS te,
         p_type IS NULL OR p_type = 'null' OR (p_type = 'string' AND trim(p_value) = '') AS pe
  FROM j
), m AS (
  SELECT *, CASE WHEN te OR pe THEN 0.0 WHEN tc = pc OR split_part(tc, '|', 2) = split_part(pc, '|', 2) THEN 1.0
         ELSE 1 - levenshtein(split_part(tc, '|', 2), split_part(pc, '|', 2)) / greatest(length(split_part(tc, '|', 2)), length(split_part(pc, '|', 2)))::DOUBLE END AS sim
  FROM c
), o AS (
  SELECT k, path, t_type, t_value, p_type, p_value, tc, pc, te, pe, sim,
         CAST(NOT te AND NOT pe AND tc = pc AS BIGINT) AS tp,
         CAST(NOT pe AND NOT (NOT te AND NOT pe AND tc = pc) AS BIGINT) AS fp,
         CAST(t_type IS NOT NULL AND NOT te AND NOT (NOT te AND NOT pe AND tc = pc) AS BIGINT) AS fn,
         CASE WHEN t_type IS NOT NULL AND NOT te THEN sim ELSE 0.0 END AS similarity_sum,
         CAST(t_type IS NOT NULL AND NOT te AS BIGINT) AS similarity_support,
         CAST(t_type IS NOT NULL AND te AS BIGINT) AS empty_gt, CAST(t_type IS NOT NULL AND te AND pe AS BIGINT) AS empty_correct,
         CAST(te AND NOT pe AS BIGINT) AS hallucinated
  FROM m
)"""

SUMS_SQL = """CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, sum(similarity_sum) AS similarity_sum, CAST(sum(similarity_support) AS BIGINT) AS similarity_support,
         CAST(sum(empty_gt) AS BIGINT) AS empty_gt, CAST(sum(empty_correct) AS BIGINT) AS empty_correct, CAST(sum(hallucinated) AS BIGINT) AS hallucinated"""

RATIOS_SQL = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1.0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 1.0), 6) AS recall,
       round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1.0) * coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 1.0) / nullif(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 1.0) + coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 1.0), 0), 0.0), 6) AS f1,
       round(coalesce(similarity_sum / nullif(similarity_support, 0), 1.0), 6) AS similarity, tp + fn AS support"""


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of four tables in long form: sample_id, path, jtype, value."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")

    def melt(df: DataFrame, key: str, prefix: str, columns: dict[str, str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("path"), F.when(F.col(c).isNull(), "null").otherwise(t).alias("jtype"), F.col(c).cast("string").alias("value")) for c, t in columns.items()])
        return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("sample_id"), F.inline(cells))

    return (
        melt(docs, "doc_id", "doc", {"lang": "string", "source": "string", "n_chars": "integer"})
        .unionByName(melt(labels, "doc_id", "label", {"quality": "integer", "toxic": "integer"}))
        .unionByName(melt(customer, "c_custkey", "customer", {"c_mktsegment": "string", "c_nationkey": "integer"}))
        .unionByName(melt(part, "p_partkey", "part", {"p_brand": "string", "p_type": "string", "p_size": "integer"}))
    )


def _cells(prefix: str, key: str, source: str, columns: dict[str, str]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{prefix}:' || CAST({key} AS VARCHAR) AS sample_id, '{prefix}.{c}' AS path, CASE WHEN {c} IS NULL THEN 'null' ELSE '{t}' END AS jtype, CAST({c} AS VARCHAR) AS value FROM {source}" for c, t in columns.items()
    )


LEAVES_SQL = "leaves AS (\n  " + "\n  UNION ALL ".join([
    _cells("doc", "doc_id", "documents", {"lang": "string", "source": "string", "n_chars": "integer"}),
    _cells("label", "doc_id", "labels", {"quality": "integer", "toxic": "integer"}),
    _cells("customer", "c_custkey", "customer", {"c_mktsegment": "string", "c_nationkey": "integer"}),
    _cells("part", "p_partkey", "part", {"p_brand": "string", "p_type": "string", "p_size": "integer"}),
]) + ")"


