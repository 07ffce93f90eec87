"""Text functions, profiling and audit detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docaudit.functions import text as X
from docaudit.operators import profile as P
from docaudit.plans.documents import LEAVES_SQL, order_features
from docaudit.plans.registry import query, table


@query("text_normalise_key", r"SELECT doc_id, md5(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g')) AS key_md5 FROM documents")
def text_normalise_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.text_key("text")).alias("key_md5"))


@query("string_normalise", r"SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS text_md5 FROM documents")
def string_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normal_string("text")).alias("text_md5"))


@query("canonical_scalar", r"""WITH v AS (SELECT p_partkey AS id, 'number' AS jt, CAST(CAST(p_retailprice AS DECIMAL(18, 4)) AS VARCHAR) AS v FROM part
UNION ALL SELECT p_partkey, 'string', '00' || CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'string', ' ' || CAST(p_size AS VARCHAR) || '.50 ' FROM part UNION ALL SELECT p_partkey, 'boolean', 'true' FROM part),
n AS (SELECT *, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS s FROM v)
SELECT id, jt, v, CASE WHEN jt = 'boolean' THEN 'boolean' WHEN jt = 'number' OR regexp_full_match(s, '-?(0|[1-9][0-9]*)(\.[0-9]+)?') THEN 'number' ELSE 'string' END AS kind,
       CASE WHEN jt = 'number' OR (jt = 'string' AND regexp_full_match(s, '-?(0|[1-9][0-9]*)(\.[0-9]+)?')) THEN regexp_replace(s, '\.0+$|(\.[0-9]*?)0+$', '\1') ELSE s END AS text FROM n""")
def canonical_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    cells = F.array(
        F.struct(F.lit("number").alias("jt"), F.col("p_retailprice").cast("decimal(18,4)").cast("string").alias("v")),
        F.struct(F.lit("string").alias("jt"), F.concat(F.lit("00"), size).alias("v")),
        F.struct(F.lit("string").alias("jt"), F.concat(F.lit(" "), size, F.lit(".50 ")).alias("v")),
        F.struct(F.lit("boolean").alias("jt"), F.lit("true").alias("v")),
    )
    cell = part.select(F.col("p_partkey").alias("id"), F.inline(cells))
    return cell.select("id", "jt", "v", X.canonical(F.col("jt"), F.col("v")).alias("c")).select("id", "jt", "v", "c.kind", "c.text")


@query("edit_similarity", r"""WITH a AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)
SELECT p_partkey, CAST(levenshtein(a, b) AS BIGINT) AS distance, round(greatest(0.0, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE), 6) AS similarity FROM a""")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.lower("p_name"), F.lower("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).cast("long").alias("distance"), F.round(X.edit_similarity(a, b), 6).alias("similarity"))


@query("typed_value_inventory", f"""WITH {LEAVES_SQL}, v AS (SELECT path, jtype, value, count(*) AS occurrences FROM leaves GROUP BY ALL), s AS (SELECT *, occurrences / sum(occurrences) OVER (PARTITION BY path)::DOUBLE AS f FROM v)
SELECT path, jtype, value, occurrences, round(f, 6) AS frequency, CASE WHEN occurrences = 1 THEN 'singleton' WHEN f <= 0.01 THEN 'rare' WHEN f <= 0.05 THEN 'uncommon' ELSE 'common' END AS rarity FROM s""")
def typed_value_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_inventory(order_features(spark, sf_dir))


@query("field_statistics", f"""WITH {LEAVES_SQL}, v AS (SELECT path, jtype, value, count(*) AS n FROM leaves GROUP BY ALL)
SELECT path, CAST(sum(n) AS BIGINT) AS occurrences, CAST(coalesce(sum(n) FILTER (jtype = 'null'), 0) AS BIGINT) AS nulls, count(*) FILTER (jtype <> 'null') AS unique_values, count(*) FILTER (jtype <> 'null' AND n = 1) AS singletons, count(DISTINCT jtype) AS types,
       min(CASE WHEN jtype = 'integer' THEN CAST(value AS DOUBLE) END) AS least, max(CASE WHEN jtype = 'integer' THEN CAST(value AS DOUBLE) END) AS most, max(CASE WHEN jtype = 'string' THEN length(value) END) AS longest
FROM v GROUP BY path UNION ALL SELECT 'doc.never', 0, 0, 0, 0, 0, NULL, NULL, NULL""")
def field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.field_statistics(order_features(spark, sf_dir), ("doc.lang", "doc.never"))


@query("top_values_per_field", f"""WITH {LEAVES_SQL}, v AS (SELECT path, value, count(*) AS n, min(sample_id) AS first_seen FROM leaves WHERE jtype <> 'null' GROUP BY ALL)
SELECT path, value, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first_seen, value) AS nth FROM v) WHERE nth <= 5""")
def top_values_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = order_features(spark, sf_dir).where("jtype <> 'null'").groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_seen"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy(F.col("n").desc(), "first_seen", "value"))
    return v.withColumn("nth", nth.cast("long")).where("nth <= 5").select("path", "value", "n", "nth")


MIXED_SQL = """m AS (SELECT 'p' AS path, p_partkey AS id, CASE WHEN p_partkey % 997 = 0 THEN 'integer' WHEN p_partkey % 1499 = 0 THEN 'null' ELSE 'string' END AS jtype,
  CASE WHEN p_partkey % 997 = 0 THEN '12345' WHEN p_partkey % 1499 = 0 THEN NULL WHEN p_partkey % 991 = 0 THEN '12345' WHEN p_partkey % 983 = 0 THEN '--' ELSE p_brand END AS value FROM part)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 997 == 0, "integer").when(k % 1499 == 0, "null").otherwise("string")
    value = F.when(k % 997 == 0, "12345").when(k % 1499 == 0, F.lit(None)).when(k % 991 == 0, "12345").when(k % 983 == 0, "--").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.lit("p").alias("path"), k.alias("id"), kind.alias("jtype"), value.alias("value"))


def _minority_sql(source: str, cls: str) -> str:
    return f"""WITH {MIXED_SQL}, c AS (SELECT path, {cls} AS c, count(*) AS n FROM m WHERE {source} GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY path) AS total FROM c),
    x AS (SELECT *, first_value(c) OVER (PARTITION BY path ORDER BY n DESC, c DESC) AS top, first_value(n) OVER (PARTITION BY path ORDER BY n DESC, c DESC) AS top_n FROM w)
    SELECT path, c AS class, n, top AS dominant, round(top_n / total::DOUBLE, 6) AS confidence FROM x WHERE total >= 10 AND top_n / total::DOUBLE >= 0.9 AND n <= greatest(2, floor(total * 0.02)) AND c <> top"""


@query("dominant_type_minority", _minority_sql("jtype <> 'null'", "jtype"))
def dominant_type_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.minority(_mixed(spark, sf_dir).where("jtype <> 'null'").withColumnRenamed("jtype", "class"), "path", "class")


@query("character_class_minority", _minority_sql("jtype = 'string' AND trim(value) <> ''", r"CASE WHEN regexp_matches(value, '\p{L}') AND regexp_matches(value, '\p{Nd}') THEN 'alphanumeric' WHEN regexp_matches(value, '\p{L}') THEN 'alphabetic' WHEN regexp_matches(value, '\p{Nd}') THEN 'numeric' ELSE 'symbols' END"))
def character_class_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = _mixed(spark, sf_dir).where("jtype = 'string' AND trim(value) <> ''").withColumn("class", X.character_class("value"))
    return P.minority(strings, "path", "class")


@query("text_variant_groups", r"""WITH b AS (SELECT CASE WHEN p_partkey % 401 = 0 THEN upper(replace(p_brand, '#', '-')) ELSE p_brand END AS value FROM part),
v AS (SELECT value, count(*) AS n, regexp_replace(lower(value), '[^\p{L}\p{N}]', '', 'g') AS key FROM b GROUP BY value), w AS (SELECT *, first_value(value) OVER (PARTITION BY key ORDER BY n DESC, value DESC) AS usual, max(n) OVER (PARTITION BY key) AS usual_n FROM v)
SELECT 'part.p_brand' AS path, value, n, usual, usual_n FROM w WHERE usual_n >= 5 AND n <= 2 AND value <> usual""")
def text_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 401 == 0, F.upper(F.replace("p_brand", F.lit("#"), F.lit("-")))).otherwise(F.col("p_brand"))
    return P.variants(table(spark, sf_dir, "part").select(F.lit("part.p_brand").alias("path"), F.lit("string").alias("jtype"), brand.alias("value")))


@query("rare_values", """WITH l AS (SELECT 'event_type' AS path, CASE WHEN event_id % 4999 = 0 THEN 'odd' || CAST(event_id AS VARCHAR) ELSE event_type END AS value FROM events),
v AS (SELECT path, value, count(*) AS n FROM l GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY path) AS total, count(*) OVER (PARTITION BY path) AS kinds FROM v)
SELECT path, 'string' AS jtype, value, n FROM w WHERE total >= 20 AND kinds / total::DOUBLE <= 0.2 AND n <= 2 AND n / total::DOUBLE <= 0.02""")
def rare_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 4999 == 0, F.concat(F.lit("odd"), F.col("event_id").cast("string"))).otherwise(F.col("event_type"))
    return P.rare_values(table(spark, sf_dir, "events").select(F.lit("event_type").alias("path"), F.lit("string").alias("jtype"), kind.alias("value")))


TYPO_SQL = """l AS (SELECT CASE WHEN p_partkey % 499 = 0 THEN left(p_type, 3) || 'x' || substr(p_type, 5) ELSE p_type END AS value FROM part), v AS (SELECT value, lower(value) AS key, count(*) AS n FROM l GROUP BY value)"""


@query("typo_candidates", f"""WITH {TYPO_SQL}, j AS (SELECT a.value, a.n, b.value AS suggested, b.n AS bn, levenshtein(a.key, b.key) AS d, greatest(length(a.key), length(b.key)) AS size FROM v a JOIN v b ON a.n <= 2 AND b.n >= 5 AND b.n >= 5 * a.n AND length(a.key) >= 4 AND length(b.key) >= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY d, bn DESC, suggested) AS nth FROM j WHERE d <= CASE WHEN size < 8 THEN 1 WHEN size < 80 THEN 2 ELSE 3 END)
SELECT 'p_type' AS field, value, n, suggested, d AS distance FROM k WHERE nth = 1""")
def typo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 499 == 0, F.expr("concat(left(p_type, 3), 'x', substr(p_type, 5))")).otherwise(F.col("p_type"))
    values = table(spark, sf_dir, "part").select(F.lit("p_type").alias("field"), kind.alias("value")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return P.typo_candidates(values)


OUTLIER_SQL = """v AS (SELECT event_id AS id, event_type AS key, CASE WHEN event_id % 1009 = 0 THEN value * 1000 + 1e6 ELSE value END AS x FROM events),
s AS (SELECT key, median(x) AS med, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, count(x) AS n FROM v GROUP BY key), d AS (SELECT v.*, med, q1, q3, n, abs(x - med) AS away FROM v JOIN s USING (key)), m AS (SELECT key, median(away) AS mad FROM d GROUP BY key)"""


@query("numeric_outliers_mad", f"""WITH {OUTLIER_SQL} SELECT id, key, round(x, 6) AS x, round(0.6745 * away / nullif(mad, 0), 4) AS z FROM d JOIN m USING (key)
WHERE n >= 10 AND coalesce(0.6745 * away / nullif(mad, 0) > 7, q3 > q1 AND (x < q1 - 4 * (q3 - q1) OR x > q3 + 4 * (q3 - q1)))""")
def numeric_outliers_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 1009 == 0, F.col("value") * 1000 + 1e6).otherwise(F.col("value"))
    values = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), x.alias("x"))
    return P.outliers(values, "key", "x").select("id", "key", F.round("x", 6).alias("x"), F.round("score", 4).alias("z"))


@query("numeric_summary", """WITH s AS (SELECT l_returnflag AS stat_key, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
m AS (SELECT stat_key, median(abs(l_extendedprice - med)) AS mad FROM lineitem JOIN s ON l_returnflag = stat_key GROUP BY 1)
SELECT stat_key, n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, round(mad, 4) AS mad FROM s JOIN m USING (stat_key)""")
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.numeric_summary(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), "l_returnflag", "l_extendedprice")
    return s.select("stat_key", "n", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mad")])


SEMANTIC_SQL = r"""s AS (
  SELECT c_custkey AS id, 'sender.city' AS path, CASE WHEN c_custkey % 101 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 103 = 0 THEN '  ' ELSE 'Town' END AS v FROM customer
  UNION ALL SELECT c_custkey, 'sender.postcode', CASE WHEN c_custkey % 89 = 0 THEN 'ABC' WHEN c_custkey % 83 = 0 THEN '12345 67890 12345' ELSE '12345' END FROM customer
  UNION ALL SELECT c_custkey, 'sender.phone', CASE WHEN c_custkey % 79 = 0 THEN '12-3' ELSE '+49 123 456' END FROM customer
  UNION ALL SELECT c_custkey, 'document.date', CASE WHEN c_custkey % 73 = 0 THEN '31.02.2020' WHEN c_custkey % 71 = 0 THEN 'week 12' ELSE '28.02.2020' END FROM customer
  UNION ALL SELECT c_custkey, 'sender.name', CASE WHEN c_custkey % 67 = 0 THEN 'N/A' WHEN c_custkey % 61 = 0 THEN ' Name' ELSE c_name END FROM customer
)"""


@query("semantic_checks", rf"""WITH {SEMANTIC_SQL}
SELECT id, path, 'blank_string' AS code, 42 AS severity FROM s WHERE trim(v) = ''
UNION ALL SELECT id, path, 'null_literal', 55 FROM s WHERE lower(trim(v)) IN ('null', 'none', 'n/a', 'nan', 'unknown')
UNION ALL SELECT id, path, 'invalid_postcode', 68 FROM s WHERE path LIKE '%postcode%' AND NOT regexp_matches(v, '\d')
UNION ALL SELECT id, path, 'unusual_postcode_length', 52 FROM s WHERE path LIKE '%postcode%' AND length(v) > 14
UNION ALL SELECT id, path, 'invalid_city', 72 FROM s WHERE path LIKE '%city' AND trim(v) <> '' AND regexp_full_match(v, '[\d\W_]+')
UNION ALL SELECT id, path, 'invalid_phone', 50 FROM s WHERE path LIKE '%phone%' AND length(regexp_replace(v, '\D', '', 'g')) < 5
UNION ALL SELECT id, path, 'impossible_date', 76 FROM s WHERE path LIKE '%date%' AND v = '31.02.2020'
UNION ALL SELECT id, path, 'unusual_date_format', 28 FROM s WHERE path LIKE '%date%' AND v = 'week 12'
UNION ALL SELECT id, path, 'surrounding_whitespace', 32 FROM s WHERE trim(v) <> '' AND trim(v) <> v
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'line.quantity', 'negative_measurement', 80 FROM lineitem WHERE l_orderkey % 97 = 0 AND -l_quantity < 0
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'line.quantity', 'zero_package_quantity', 35 FROM lineitem WHERE l_orderkey % 96 = 0 AND l_orderkey % 97 <> 0""")
def semantic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.semantic import number_issues, string_issues

    k = F.col("c_custkey")
    cell = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("v"))
    cells = F.array(
        cell("sender.city", F.when(k % 101 == 0, k.cast("string")).when(k % 103 == 0, "  ").otherwise("Town")),
        cell("sender.postcode", F.when(k % 89 == 0, "ABC").when(k % 83 == 0, "12345 67890 12345").otherwise("12345")),
        cell("sender.phone", F.when(k % 79 == 0, "12-3").otherwise("+49 123 456")),
        cell("document.date", F.when(k % 73 == 0, "31.02.2020").when(k % 71 == 0, "week 12").otherwise("28.02.2020")),
        cell("sender.name", F.when(k % 67 == 0, "N/A").when(k % 61 == 0, " Name").otherwise(F.col("c_name"))),
    )
    strings = table(spark, sf_dir, "customer").select(k.alias("id"), F.inline(cells))
    q = F.when(F.col("l_orderkey") % 97 == 0, -F.col("l_quantity")).when(F.col("l_orderkey") % 96 == 0, F.lit(0.0)).otherwise(F.col("l_quantity"))
    numbers = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("line.quantity").alias("path"), q.alias("v"))
    return string_issues(strings, ["id"], "path", "v").unionByName(number_issues(numbers, ["id"], "path", "v"))


@query("date_validity", r"""WITH d AS (SELECT event_id, lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || '.' || CAST(2000 + event_id % 25 AS VARCHAR) AS s FROM events)
SELECT event_id, s, try_strptime(s, '%d.%m.%Y') IS NOT NULL AS possible FROM d""")
def date_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.concat(two(k % 33), F.lit("."), two(k % 14), F.lit("."), (2000 + k % 25).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s"), X.date_state(s).alias("possible"))


FD_SQL = """pairs AS (
  SELECT 'city->region' AS relation, n_name AS anchor, CASE WHEN c_custkey % 29 = 0 THEN 'ELSEWHERE' ELSE CAST(n_regionkey AS VARCHAR) END AS dependent, c_custkey AS ordinal FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'brand->maker', p_brand, CASE WHEN p_partkey % 37 = 0 THEN 'maker?' ELSE 'maker' || substr(p_brand, 7, 1) END, p_partkey FROM part
), c AS (SELECT relation, anchor, dependent, count(*) AS n, min(ordinal) AS f FROM pairs GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY relation, anchor) AS support, row_number() OVER (PARTITION BY relation, anchor ORDER BY n DESC, f) AS nth FROM c),
rules AS (SELECT relation, anchor, dependent, CAST(support AS BIGINT) AS support, round(n / support::DOUBLE, 6) AS confidence, CAST(support - n AS BIGINT) AS exceptions FROM w WHERE nth = 1 AND support >= 3 AND n / support::DOUBLE >= 0.8 AND n < support)"""


def _fd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    place = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a = place.select(F.lit("city->region").alias("relation"), F.col("n_name").alias("anchor"), F.when(F.col("c_custkey") % 29 == 0, "ELSEWHERE").otherwise(F.col("n_regionkey").cast("string")).alias("dependent"), F.col("c_custkey").alias("ordinal"))
    maker = F.when(F.col("p_partkey") % 37 == 0, "maker?").otherwise(F.concat(F.lit("maker"), F.substring("p_brand", 7, 1)))
    return a.unionByName(table(spark, sf_dir, "part").select(F.lit("brand->maker").alias("relation"), F.col("p_brand").alias("anchor"), maker.alias("dependent"), F.col("p_partkey").alias("ordinal")))


@query("fd_rules", f"WITH {FD_SQL} SELECT * FROM rules")
def fd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.learn_rules(_fd_pairs(spark, sf_dir)).orderBy(F.col("confidence").desc(), F.col("support").desc(), "relation", "anchor")


EXCEPTIONS_SQL = f"""{FD_SQL}, ex AS (SELECT p.relation, p.ordinal, p.anchor, p.dependent, r.dependent AS expected, CAST(least(72, round_even(38 + 22 * r.confidence + 4 * log2(r.support), 0)) AS INTEGER) AS severity FROM pairs p JOIN rules r ON p.relation = r.relation AND p.anchor = r.anchor AND p.dependent <> r.dependent)"""


@query("fd_rule_exceptions", f"WITH {EXCEPTIONS_SQL} SELECT * FROM ex")
def fd_rule_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _fd_pairs(spark, sf_dir)
    return P.rule_exceptions(pairs, P.learn_rules(pairs))


@query("intra_row_conflicts", r"""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS a, CASE WHEN o_orderkey % 41 = 0 THEN 'X-NONE' WHEN o_orderkey % 43 = 0 THEN upper(o_orderpriority) || ' ' WHEN o_orderkey % 47 = 0 THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS b FROM orders),
k AS (SELECT *, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') AS ka, regexp_replace(lower(b), '[^\p{L}\p{N}]', '', 'g') AS kb FROM o)
SELECT id, a, b FROM k WHERE ka <> '' AND kb <> '' AND ka <> kb AND NOT (least(length(ka), length(kb)) >= 3 AND (contains(ka, kb) OR contains(kb, ka)))""")
def intra_row_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = F.when(k % 41 == 0, "X-NONE").when(k % 43 == 0, F.concat(F.upper("o_orderpriority"), F.lit(" "))).when(k % 47 == 0, F.expr("substr(o_orderpriority, 3)")).otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("a"), b.alias("b"))
    ka, kb = X.text_key("a"), X.text_key("b")
    contained = (F.least(F.length(ka), F.length(kb)) >= 3) & (F.contains(ka, kb) | F.contains(kb, ka))
    return rows.where((ka != "") & (kb != "") & (ka != kb) & ~contained)


@query("intra_row_conflicts_ratio")
def intra_row_conflicts_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, after which a sequence ratio of 0.72 still counts as compatible (Arrow function on the survivors only)."""
    from docaudit.functions.exact import sequence_ratio

    rest = intra_row_conflicts(spark, sf_dir)
    return rest.withColumn("ratio", sequence_ratio(X.text_key("a"), X.text_key("b"))).where("ratio < 0.72")


@query("duplicate_text_groups", "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "doc_id")
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("duplicate_conflicts", """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash, CAST(quality AS VARCHAR) || '/' || CAST(toxic AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id)),
g AS (SELECT hash FROM d GROUP BY hash HAVING count(DISTINCT label) > 1) SELECT doc_id, hash, label, 96 AS severity FROM d WHERE hash IN (SELECT hash FROM g)""")
def duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts with different labels. The groups are found by a pre-aggregated count; members join back by hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))
    d = docs.join(labels, F.col("doc_id") == F.col("l_id")).select("doc_id", "hash", "label")
    split = d.groupBy(F.col("hash").alias("g")).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("g")
    return d.join(split, F.col("hash") == F.col("g"), "left_semi").withColumn("severity", F.lit(96))


PEER_SQL = """f AS (SELECT DISTINCT c_custkey AS id, 'nation:' || CAST(c_nationkey AS VARCHAR) AS feature, 1.0 AS w FROM customer UNION ALL SELECT DISTINCT c_custkey, 'segment:' || c_mktsegment, 2.0 FROM customer UNION ALL SELECT DISTINCT c_custkey, 'band:' || CAST(CAST(floor(c_acctbal / 500) AS BIGINT) AS VARCHAR), 3.0 FROM customer)"""


@query("nearest_peers", f"""WITH {PEER_SQL}, s AS (SELECT a.id, b.id AS peer, sum(a.w) AS shared FROM f a JOIN f b ON a.feature = b.feature AND a.id <> b.id GROUP BY ALL), r AS (SELECT id, peer, round(CAST(shared AS DOUBLE) / (12 - CAST(shared AS DOUBLE)), 6) AS score FROM s)
SELECT id AS sample_id, peer, score, nth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, peer) AS nth FROM r) WHERE nth <= 3""")
def nearest_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = lambda n, v, w: F.struct(F.concat(F.lit(f"{n}:"), v).alias("feature"), F.lit(w).alias("weight"))
    cells = F.array(feature("nation", F.col("c_nationkey").cast("string"), 1.0), feature("segment", F.col("c_mktsegment"), 2.0), feature("band", F.floor(F.col("c_acctbal") / 500).cast("string"), 3.0))
    return P.nearest_peers(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.inline(cells)))


ISSUES_SQL = f"""{EXCEPTIONS_SQL}, raw AS (
  SELECT ordinal AS sample_id, 'learned_consistency_exception' AS code, relation AS field, 'differs' AS message, severity, 1 AS emit_order FROM ex
  UNION ALL SELECT ordinal, 'learned_consistency_exception', relation, 'differs', 40, 2 FROM ex
  UNION ALL SELECT c_custkey, 'negative_balance', 'c_acctbal', 'below zero', 32, 3 FROM customer WHERE c_acctbal < 0
), dedup AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY sample_id, code, field, message ORDER BY severity DESC, emit_order) = 1),
ranked AS (SELECT sample_id, severity, row_number() OVER (PARTITION BY sample_id ORDER BY severity DESC) AS nth FROM dedup),
risk AS (SELECT sample_id, count(*) AS n_issues, CAST(least(100, round_even(max(severity) + 0.12 * coalesce(sum(severity) FILTER (nth BETWEEN 2 AND 5), 0), 0)) AS INTEGER) AS risk FROM ranked GROUP BY sample_id)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fd_rule_exceptions(spark, sf_dir).select(F.col("ordinal").alias("sample_id"), F.lit("learned_consistency_exception").alias("code"), F.col("relation").alias("field"), F.lit("differs").alias("message"), "severity")
    owed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("sample_id"), F.lit("negative_balance").alias("code"), F.lit("c_acctbal").alias("field"), F.lit("below zero").alias("message"), F.lit(32).alias("severity"))
    again = found.withColumn("severity", F.lit(40)).withColumn("emit_order", F.lit(2))
    return found.withColumn("emit_order", F.lit(1)).unionByName(again).unionByName(owed.withColumn("emit_order", F.lit(3)))


@query("issue_dedup_risk", f"WITH {ISSUES_SQL} SELECT * FROM risk")
def issue_dedup_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.risk(P.dedupe_issues(_issues(spark, sf_dir)))


@query("review_queue", f"WITH {ISSUES_SQL} SELECT sample_id, n_issues, risk, CASE WHEN risk >= 70 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS level FROM risk")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issue_dedup_risk(spark, sf_dir).withColumn("level", P.risk_level(F.col("risk"))).orderBy(F.col("risk").desc(), "sample_id")


@query("risk_histogram", f"WITH {ISSUES_SQL} SELECT CASE WHEN risk >= 70 THEN 'high' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS level, count(*) AS documents, CAST(sum(n_issues) AS BIGINT) AS issues FROM risk GROUP BY 1")
def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_issues").alias("issues"))
