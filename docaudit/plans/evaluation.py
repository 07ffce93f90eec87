"""Evaluation of predictions against truth, and JSON shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import jsonx
from docaudit.functions import text as X
from docaudit.operators import compare as C
from docaudit.plans.documents import DOCS_SQL, ORDER, PAIRS_SQL, RATIOS_SQL, SUMS_SQL, order_leaves
from docaudit.plans.registry import query, table


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_outcomes(C.leaf_pairs(order_leaves(spark, sf_dir), ["k"]))


@query("eval_field_breakdown", f"""{PAIRS_SQL}, g AS (SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS field, {SUMS_SQL} FROM o GROUP BY 1)
SELECT field, tp, fp, fn, empty_gt, empty_correct, hallucinated, {RATIOS_SQL} FROM g""")
def eval_field_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _outcomes(spark, sf_dir).groupBy(X.index_free("path").alias("field")).agg(*C.counters())
    return sums.select("field", "tp", "fp", "fn", "empty_gt", "empty_correct", "hallucinated", *[c.alias(n) for n, c in C.ratios().items()])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each sample, with parsed and exact (type-strict equality of all leaves and item counts)."""
    docs = order_leaves(spark, sf_dir)
    pairs = C.with_outcomes(C.leaf_pairs(docs, ["k", "parsed"]))
    strict = (F.col("t_type").eqNullSafe(F.col("p_type"))) & F.col("t_value").eqNullSafe(F.col("p_value"))
    return pairs.groupBy("k").agg(*C.counters(), F.first("parsed").alias("parsed"), F.min(strict.cast("int")).alias("strict")).withColumn("exact", F.col("parsed") & (F.col("strict") == 1))


SAMPLES_SQL = f"""{PAIRS_SQL}, s AS (
  SELECT k, {SUMS_SQL}, k % 19 <> 0 AS parsed, k % 19 <> 0 AND bool_and(t_type IS NOT DISTINCT FROM p_type AND t_value IS NOT DISTINCT FROM p_value) AS exact FROM o GROUP BY k
)"""


@query("eval_summary", f"""{SAMPLES_SQL}, g AS (SELECT count(*) AS samples, avg(CAST(parsed AS DOUBLE)) AS parse_rate, avg(CAST(exact AS DOUBLE)) AS exact_rate, {SUMS_SQL} FROM s)
SELECT samples, round(parse_rate, 6) AS parse_rate, round(exact_rate, 6) AS exact_rate, tp, fp, fn, hallucinated, {RATIOS_SQL} FROM g""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    g = _samples(spark, sf_dir).agg(F.count(F.lit(1)).alias("samples"), rate("parsed").alias("parse_rate"), rate("exact").alias("exact_rate"), *C.counters())
    return g.select("samples", "parse_rate", "exact_rate", "tp", "fp", "fn", "hallucinated", *[c.alias(n) for n, c in C.ratios().items()])


@query("eval_per_sample", f"{SAMPLES_SQL} SELECT k, parsed, exact, tp, fp, fn, hallucinated, {RATIOS_SQL} FROM s")
def eval_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("k", "parsed", "exact", "tp", "fp", "fn", "hallucinated", *[c.alias(n) for n, c in C.ratios().items()])


@query("eval_training_metrics", f"""{SAMPLES_SQL}, g AS (SELECT avg(CAST(parsed AS DOUBLE)) AS parse_rate, avg(CAST(exact AS DOUBLE)) AS exact_rate, CAST(NULL AS DOUBLE) AS schema_valid_rate, {SUMS_SQL} FROM s),
r AS (SELECT round(parse_rate, 6) AS parse_rate, round(exact_rate, 6) AS exact_rate, schema_valid_rate, {RATIOS_SQL} FROM g)
SELECT 'json_' || metric AS metric, value FROM (UNPIVOT (SELECT parse_rate, exact_rate, schema_valid_rate, "precision", recall, f1, similarity FROM r) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def eval_training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = eval_summary(spark, sf_dir).withColumn("schema_valid_rate", F.lit(None).cast("double"))
    names = ["parse_rate", "exact_rate", "schema_valid_rate", "precision", "recall", "f1", "similarity"]
    return one.unpivot([], names, "name", "value").where("value IS NOT NULL").select(F.concat(F.lit("json_"), "name").alias("metric"), "value")


DIFF_SQL = f"""{PAIRS_SQL}, d AS (
  SELECT k, path, CASE WHEN te THEN 'prediction_only' WHEN pe THEN 'annotation_only' WHEN tc = pc THEN 'formatting_only' ELSE 'value_mismatch' END AS kind,
         CASE WHEN te OR pe THEN 0.0 WHEN tc = pc THEN 1.0 ELSE round(sim, 6) END AS similarity
  FROM o WHERE NOT (te AND pe) AND NOT coalesce(t_type = p_type AND t_value IS NOT DISTINCT FROM p_value, false)
)"""


@query("diff_review", f"{DIFF_SQL} SELECT k, path, kind, CAST(similarity AS DOUBLE) AS similarity FROM d")
def diff_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.differences(C.leaf_pairs(order_leaves(spark, sf_dir), ["k"]), ["k"])


@query("diff_review_queue", f"""{DIFF_SQL} SELECT docs.k, count(d.k) AS n_differences, count(d.k) FILTER (kind = 'value_mismatch') AS n_mismatches, count(d.k) = 0 AS exact FROM docs LEFT JOIN d USING (k) GROUP BY docs.k""")
def diff_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by number of differences, most first; unchanged ones count as exact."""
    pairs = C.leaf_pairs(order_leaves(spark, sf_dir), ["k"])
    found = C.with_outcomes(pairs)
    same = (F.col("t_type") == F.col("p_type")) & F.col("t_value").eqNullSafe(F.col("p_value"))
    differs = ~(F.col("t_empty") & F.col("p_empty")) & ~F.coalesce(same, F.lit(False))
    mismatch = differs & ~F.col("t_empty") & ~F.col("p_empty") & ~F.col("equal")
    g = found.groupBy("k").agg(F.count_if(differs).alias("n_differences"), F.count_if(mismatch).alias("n_mismatches"))
    return g.withColumn("exact", F.col("n_differences") == 0).orderBy(F.col("n_differences").desc(), "k")


@query("strict_exact_match", f"{SAMPLES_SQL} SELECT k, exact FROM s")
def strict_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("k", "exact")


@query("structural_diff", f"""WITH {DOCS_SQL}, j AS (
  SELECT coalesce(t.k, p.k) AS k, coalesce(t.path, p.path) AS path, t.jt AS tt, t.v AS tv, p.jt AS pt, p.v AS pv FROM t FULL OUTER JOIN p ON t.k = p.k AND t.path = p.path
), n AS (
  SELECT k, CASE WHEN pt IS NULL AND path LIKE 'items[%' THEN regexp_replace(path, '\\..*', '') ELSE path END AS path,
         CASE WHEN pt IS NULL THEN 'missing_in_prediction' WHEN tt IS NULL THEN 'unexpected_in_prediction' WHEN tt <> pt THEN 'type_mismatch' ELSE 'value_mismatch' END AS kind
  FROM j WHERE k % 19 <> 0 AND (tt IS DISTINCT FROM pt OR tv IS DISTINCT FROM pv)
)
SELECT DISTINCT k, path, kind FROM n UNION ALL SELECT k, '$' AS path, 'type_mismatch' AS kind FROM docs WHERE k % 19 = 0""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of structure: a missing item is one difference, not one for each of its leaves; a prediction that did
    not parse differs at the root and nowhere below."""
    docs = order_leaves(spark, sf_dir)
    leaves = C.leaf_pairs(docs.where("parsed"), ["k"])
    differs = ~(F.col("t_type").eqNullSafe(F.col("p_type")) & F.col("t_value").eqNullSafe(F.col("p_value")))
    whole_item = (F.col("p_type").isNull() | F.col("t_type").isNull()) & F.col("path").startswith("items[")
    kind = F.when(F.col("p_type").isNull(), "missing_in_prediction").when(F.col("t_type").isNull(), "unexpected_in_prediction").when(F.col("t_type") != F.col("p_type"), "type_mismatch").otherwise("value_mismatch")
    below = leaves.where(differs).select("k", F.when(whole_item, F.regexp_replace("path", r"\..*", "")).otherwise(F.col("path")).alias("path"), kind.alias("kind")).distinct()
    return below.unionByName(docs.where(~F.col("parsed")).select("k", F.lit("$").alias("path"), F.lit("type_mismatch").alias("kind")))


@query("flatten_leaves", f"WITH {DOCS_SQL} SELECT k, path, regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS canonical_path, jt AS jtype, v AS value FROM t")
def flatten_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = order_leaves(spark, sf_dir).select("k", F.explode(F.map_entries("truth")).alias("e"))
    return leaves.select("k", F.col("e.key").alias("path"), X.index_free("e.key").alias("canonical_path"), F.col("e.value.jtype").alias("jtype"), F.col("e.value.value").alias("value"))


@query("json_path_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing.deep') IS NULL AS absent FROM events")
def json_path_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(doc, "$.k", "bigint").alias("k"), F.try_variant_get(doc, "$.missing.deep", "variant").isNull().alias("absent"))


def _quoted(v: str) -> str:
    return f"""coalesce('"' || {v} || '"', 'null')"""


@query("template_fill", f"""WITH {DOCS_SQL}, it AS (
  SELECT k, string_agg('{{"qty":' || CASE WHEN i % 2 = 1 THEN '"' || qty || '"' ELSE qty END || ',"part":"' || p_name || '"}}', ',' ORDER BY i) AS items FROM li WHERE k % 19 <> 0 AND NOT (k % 9 = 0 AND i = n - 1) GROUP BY k
), w AS (SELECT k, max(v) FILTER (path = 'ref') AS ref, max(v) FILTER (path = 'customer.name') AS name, max(v) FILTER (path = 'customer.city') AS city, max(v) FILTER (path = 'customer.segment') AS segment FROM p GROUP BY k)
SELECT docs.k, '{{"ref":' || {_quoted('ref')} || ',"customer":{{"name":' || {_quoted('name')} || ',"city":' || {_quoted('city')} || ',"segment":' || {_quoted('segment')} || '}},"items":[' || coalesce(items, '') || ']}}' AS filled
FROM docs LEFT JOIN w USING (k) LEFT JOIN it USING (k)""")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_leaves(spark, sf_dir).select("k", jsonx.fill_template(F.col("p_doc"), ORDER).alias("filled"))


def _tok(key: str, v: str) -> str:
    return f"'<s_{key}>' || coalesce({v}, '<null/>') || '</s_{key}>'"


@query("token_serialise", f"""WITH {DOCS_SQL}, it AS (
  SELECT k, string_agg({_tok('qty', 'qty')} || {_tok('part', 'p_name')}, '<sep/>' ORDER BY i) AS items FROM li GROUP BY k
)
SELECT docs.k, {_tok('ref', 'CAST(docs.k AS VARCHAR)')} || '<s_customer>' || {_tok('name', 'c_name')} || {_tok('city', 'n_name')} || {_tok('segment', 'CASE WHEN docs.k % 5 = 0 THEN NULL ELSE c_mktsegment END')} || '</s_customer>'
       || '<s_items>' || coalesce(items, '') || '</s_items>' AS target_sequence FROM docs LEFT JOIN it USING (k)""")
def token_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_leaves(spark, sf_dir).select("k", jsonx.to_tokens(F.col("t_doc"), ORDER).alias("target_sequence"))


@query("schema_validate_errors", f"""WITH {DOCS_SQL}
SELECT k, '$' AS path, 'expected object' AS message FROM docs WHERE k % 19 = 0
UNION ALL SELECT k, path, 'expected string' FROM p WHERE path = 'ref' AND jt <> 'string'
UNION ALL SELECT k, path, 'expected integer' FROM p WHERE path LIKE '%.qty' AND jt <> 'integer'
UNION ALL SELECT k, path, 'not one of the allowed values' FROM p WHERE path = 'customer.segment' AND jt = 'string' AND v NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
UNION ALL SELECT k, path, 'shorter than 1' FROM p WHERE path = 'customer.city' AND v = ''""")
def schema_validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema compiled to one rule for each path, checked against the prediction's leaves."""
    docs = order_leaves(spark, sf_dir)
    leaf = docs.where("parsed").select("k", F.explode(F.map_entries("prediction")).alias("e"))
    leaf = leaf.select("k", F.col("e.key").alias("path"), X.index_free("e.key").alias("field"), F.col("e.value.jtype").alias("jtype"), F.col("e.value.value").alias("value"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    message = (
        F.when((F.col("field") == "ref") & (F.col("jtype") != "string"), "expected string")
        .when((F.col("field") == "items[].qty") & (F.col("jtype") != "integer"), "expected integer")
        .when((F.col("field") == "customer.segment") & (F.col("jtype") == "string") & ~F.col("value").isin(segments), "not one of the allowed values")
        .when((F.col("field") == "customer.city") & (F.col("value") == ""), "shorter than 1")
    )
    bad = leaf.select("k", "path", message.alias("message")).where("message IS NOT NULL")
    return bad.unionByName(docs.where(~F.col("parsed")).select("k", F.lit("$").alias("path"), F.lit("expected object").alias("message")))


@query("field_path_shape", f"""WITH {DOCS_SQL}, a AS (SELECT DISTINCT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path FROM t UNION SELECT 'remarks'), b AS (SELECT DISTINCT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path FROM p UNION SELECT 'items[].note')
SELECT path, 'missing' AS side FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT path, 'extra' FROM b WHERE path NOT IN (SELECT path FROM a) UNION ALL SELECT path, 'common' FROM a WHERE path IN (SELECT path FROM b)""")
def field_path_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field paths of an expected shape (truth and a remark) against those of the predictions (and a note)."""
    docs = order_leaves(spark, sf_dir)
    paths = lambda c, extra: docs.select(F.explode(F.map_keys(c)).alias("p")).select(X.index_free("p").alias("path")).distinct().unionByName(docs.sparkSession.createDataFrame([(extra,)], "path string"))
    a, b = paths("truth", "remarks").withColumn("in_a", F.lit(True)), paths("prediction", "items[].note").withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("common")
    return a.join(b, "path", "full").select("path", side.alias("side"))


@query("tag_vocabulary", f"""WITH {DOCS_SQL}, keys AS (SELECT DISTINCT unnest(string_split(regexp_replace(path, '\\[\\d+\\]', '', 'g'), '.')) AS key FROM t)
SELECT '<s_' || key || '>' AS token FROM keys UNION ALL SELECT '</s_' || key || '>' FROM keys UNION ALL SELECT '<sep/>' UNION ALL SELECT '<null/>'""")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = order_leaves(spark, sf_dir).select(F.explode(F.map_keys("truth")).alias("p")).select(F.explode(F.split(F.regexp_replace("p", r"\[\d+\]", ""), r"\.")).alias("key")).distinct()
    tags = keys.select(F.explode(F.array(F.concat(F.lit("<s_"), "key", F.lit(">")), F.concat(F.lit("</s_"), "key", F.lit(">")))).alias("token"))
    return tags.unionByName(spark.createDataFrame([("<sep/>",), ("<null/>",)], "token string"))


@query("unknown_shape_leaves", "SELECT event_id, 'k' AS path, 'integer' AS jtype, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def unknown_shape_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of JSON whose shape no contract describes (Arrow function)."""
    from docaudit.functions.exact import leaf_map

    found = table(spark, sf_dir, "events").select("event_id", F.explode(F.map_entries(leaf_map("props"))).alias("e"))
    return found.select("event_id", F.col("e.key").alias("path"), F.col("e.value.jtype").alias("jtype"), F.col("e.value.value").alias("value"))


