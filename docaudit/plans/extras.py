"""Further catalogue queries: display forms, hashes, joins by position and name, schema work, compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docaudit.functions import jsonx
from docaudit.functions import schema as S
from docaudit.functions import text as X
from docaudit.plans.datasets import _places
from docaudit.plans.documents import DOCS_SQL, order_leaves, order_pairs
from docaudit.plans.registry import query, table
from docaudit.sources.layouts import sample_id

#: The order document's schema, as a JSON Schema with a shared definition.
ORDER_SCHEMA = {
    "type": "object", "required": ["ref", "customer", "items"], "additionalProperties": False, "$defs": {"text": {"type": ["string", "null"]}},
    "properties": {
        "ref": {"$ref": "#/$defs/text"},
        "customer": {"type": "object", "properties": {"name": {"$ref": "#/$defs/text"}, "city": {"$ref": "#/$defs/text"}, "segment": {"$ref": "#/$defs/text"}}},
        "items": {"type": "array", "items": {"type": "object", "required": ["qty"], "properties": {"qty": {"type": "integer"}, "part": {"$ref": "#/$defs/text"}}}},
    },
}


@query("schema_leaf_paths", "SELECT unnest(['customer.city', 'customer.name', 'customer.segment', 'items[].part', 'items[].qty', 'ref']) AS path")
def schema_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in S.leaf_paths(ORDER_SCHEMA)], "path string")


@query("schema_validate_any", f"""WITH {DOCS_SQL} SELECT k, '$.' || path || ': expected integer, got string' AS error FROM p WHERE path LIKE '%.qty' AND jt = 'string'""")
def schema_validate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general validator (Arrow batches), for schemas that no per-path rules can express."""
    return order_pairs(spark, sf_dir).select("k", F.explode(S.validate("prediction_json", ORDER_SCHEMA)).alias("error"))


@query("schema_repair", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a": null, "b": [{"n": 1}]}' ELSE '{"a": "x", "b": []}' END AS repaired FROM events""")
def schema_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"type": "object", "properties": {"a": {"type": ["string", "null"]}, "b": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}}}}}
    raw = F.when(F.col("event_id") % 3 == 0, '{"a": "null", "b": {"n": 1}}').otherwise('{"a": "x", "b": []}')
    return table(spark, sf_dir, "events").select("event_id", S.repair(raw, schema).alias("repaired"))


@query("canonical_content_hash", f"""WITH {DOCS_SQL} SELECT docs.k, sha256(coalesce((SELECT string_agg(path || chr(1) || jt || chr(1) || coalesce(v, ''), chr(2) ORDER BY path) FROM t WHERE t.k = docs.k), '')) AS hash FROM docs""")
def canonical_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a document's leaves in path order: equal for documents that differ in key order or white space only."""
    entry = F.transform(F.array_sort(F.map_entries("truth")), lambda e: F.concat(e["key"], F.lit("\x01"), e["value"]["jtype"], F.lit("\x01"), F.coalesce(e["value"]["value"], F.lit(""))))
    return order_leaves(spark, sf_dir).select("k", F.sha2(F.array_join(entry, "\x02"), 256).alias("hash"))


@query("json_types", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'boolean' WHEN 2 THEN 'integer' WHEN 3 THEN 'number' WHEN 4 THEN 'array' ELSE 'object' END AS kind,
CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '7' WHEN 3 THEN '1.5' WHEN 4 THEN '[1,2]' ELSE '{"a":1,"b":2}' END AS display FROM events""")
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("null", "true", "7", "1.5", "[1, 2]", '{"b": 2, "a": 1}')]), (F.col("event_id") % 6 + 1).cast("int"))
    v = F.parse_json(raw)
    return table(spark, sf_dir, "events").select("event_id", jsonx.json_type(v).alias("kind"), F.to_json(v).alias("display"))


@query("positional_join", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT i, doc_id, o_orderkey FROM a JOIN b USING (i)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables joined by their place in order. Places come from ranges of the key, counted first."""
    from docaudit.operators.datasets import with_ordinal

    a = with_ordinal(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    b = with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumnRenamed("ordinal", "i")
    return a.join(b, F.col("ordinal") == F.col("i")).select("i", "doc_id", "o_orderkey")


@query("prediction_metadata_join", """WITH meta AS (SELECT doc_id, source AS split, 'img' || CAST(doc_id % 900 AS VARCHAR) AS stem, row_number() OVER (PARTITION BY source, doc_id % 900 ORDER BY doc_id) AS nth FROM documents),
pred AS (SELECT doc_id AS p_id, source AS split, CASE WHEN doc_id % 5 = 0 THEN 'lost' ELSE 'img' END || CAST(doc_id % 700 AS VARCHAR) AS stem FROM documents)
SELECT p_id, split, stem, doc_id, CASE WHEN doc_id IS NULL THEN 'no metadata' END AS warning FROM pred LEFT JOIN (SELECT * FROM meta WHERE nth = 1) m USING (split, stem)""")
def prediction_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.operators.datasets import first_wins

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    stem = lambda n: F.concat(F.lit("img"), (F.col("doc_id") % n).cast("string")).alias("stem")
    meta = first_wins(docs.select(F.col("source").alias("split"), stem(900), "doc_id"), ["split", "stem"], ["doc_id"])
    lost = F.concat(F.when(F.col("doc_id") % 5 == 0, "lost").otherwise("img"), (F.col("doc_id") % 700).cast("string")).alias("stem")
    pred = docs.select(F.col("doc_id").alias("p_id"), F.col("source").alias("split"), lost)
    return pred.join(meta, ["split", "stem"], "left").select("p_id", "split", "stem", "doc_id", F.when(F.col("doc_id").isNull(), "no metadata").alias("warning"))


@query("clean_sequence", r"""SELECT conv_id, turn, trim(regexp_replace(replace(replace('<s_task>' || text || '</s><pad><pad>', '</s>', ''), '<pad>', ''), '<[^>]*>', '')) AS cleaned FROM conversations""")
def clean_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End and padding marks dropped, then the first tag only."""
    raw = F.concat(F.lit("<s_task>"), "text", F.lit("</s><pad><pad>"))
    bare = F.replace(F.replace(raw, F.lit("</s>"), F.lit("")), F.lit("<pad>"), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(bare, r"(?s)^([^<]*)<[^>]*>(.*)$", "$1$2")).alias("cleaned"))


@query("sample_ids", "SELECT doc_id, source || '__' || lang || '__' || CAST(doc_id AS VARCHAR) AS sample_id FROM documents")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/raw/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".tar.png"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(sample_id(path, "/data/raw"), r"\.tar$", "").alias("sample_id"))


@query("related_peers", """WITH i AS (SELECT o_custkey AS sample_id, o_orderkey % 50 AS peer, o_orderkey AS place FROM orders), d AS (SELECT sample_id, peer, min(place) AS first FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY first, peer) AS nth FROM d)
SELECT sample_id, string_agg(CAST(peer AS VARCHAR), ' | ' ORDER BY nth) AS peers FROM r WHERE nth <= 8 GROUP BY sample_id""")
def related_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight different peers of each sample, in the order of their first mention."""
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), (F.col("o_orderkey") % 50).alias("peer"), F.col("o_orderkey").alias("place"))
    first = i.groupBy("sample_id", "peer").agg(F.min("place").alias("first"))
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy("first", "peer"))
    top = first.withColumn("nth", nth).where("nth <= 8").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("nth", "peer"))).alias("p"))
    return top.select("sample_id", F.array_join(F.transform("p", lambda x: x["peer"].cast("string")), " | ").alias("peers"))


@query("values_compatible")
def values_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against types: native tests, then the sequence ratio for the rest."""
    from docaudit.functions.similarity import values_compatible as judge

    return judge(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


@query("country_equivalent")
def country_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docaudit.functions.similarity import country_equivalent as judge

    suffixes = _places(spark, sf_dir).select(X.location_parts("place")["suffix"].alias("a")).where("a IS NOT NULL").distinct()
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("b"))
    return judge(suffixes.crossJoin(F.broadcast(region)), "a", "b")  # region: a fixed list of continents


@query("exact_text_keys")
def exact_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-Unicode keys (Arrow) beside the native ones; they agree wherever text has no compatibility characters."""
    from docaudit.functions.exact import text_key_exact

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text_key_exact("text")).alias("exact_md5"), F.md5(X.text_key("text")).alias("native_md5"))
