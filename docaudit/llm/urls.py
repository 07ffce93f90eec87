"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

Each URL is expanded into those (host suffix, path prefix) expressions whose shape (number of host labels, length of
path) some rule has. Expressions meet rules by an equi-join on a short prefix of their SHA-256 digest; the full digest
then confirms, and the longest fitting rule wins (ties: longer host, then `block`, then the smaller rule string).

Defined results: null url or no `://`: host and path empty, no rule, the default verdict. Repeated rows: one result
each. Rules with null host or path count as empty strings in that place; a rule with an empty host fits nothing.
Extra columns stay unless their names are those of the results, which replace them. Empty tables: empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import broadcast_within, lower_ascii

#: (verdict, host, path)
PRODUCTION_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT_VERDICT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = PRODUCTION_RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _digests(rules: DataFrame, prefix_hex: int) -> DataFrame:
    host, path = lower_ascii(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    known = rules.select(F.col("verdict"), host.alias("host"), path.alias("path")).where("host <> ''")
    # one verdict for each expression: block before allow
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("r_verdict"))
    digest = F.sha2(F.concat("host", "path"), 256)
    return known.select(
        F.concat("host", "path").alias("r_rule"),
        "r_verdict",
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("r_path"),
        F.length("host").alias("r_host"),
        digest.alias("r_digest"),
        F.substring(digest, 1, prefix_hex).alias("r_prefix"),
    )


def match_urls(
    urls: DataFrame,
    rules: DataFrame,
    *,
    url_col: str = "url",
    default: str = DEFAULT_VERDICT,
    prefix_hex: int = 8,
    broadcast_rules: int = 200_000,
) -> DataFrame:
    """urls with host, path, rule (null if none fits) and verdict. No Python runs; hot hosts and URLs meet the rules once."""
    results = ("host", "path", "rule", "verdict")
    rest = [F.col(f"`{c}`") for c in urls.columns if c not in results]
    base = urls.select(*rest, host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    known = _digests(rules, prefix_hex)
    shapes = sorted(tuple(r) for r in known.select("labels", "r_path").distinct().collect())  # bounded by URL lengths
    if not shapes:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_labels = F.size(F.split("host", r"\."))
    expressions = F.array(*[
        F.when(
            (n_labels >= labels) & (F.length("path") >= length),
            F.sha2(F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length) if length else F.lit("")), 256),
        )
        for labels, length in shapes
    ])
    keys = base.where("host <> ''").select("host", "path").distinct()
    expanded = keys.select("host", "path", F.explode(F.array_distinct(F.array_compact(expressions))).alias("digest"))
    met = expanded.select("host", "path", "digest", F.substring("digest", 1, prefix_hex).alias("r_prefix")).join(
        broadcast_within(known, broadcast_rules), "r_prefix"
    )
    longest = F.struct(F.col("r_host") + F.col("r_path"), "r_host", "r_verdict", "r_rule")
    best = (
        met.where("digest = r_digest")
        .groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path"))
        .agg(F.max_by(F.struct("r_rule", "r_verdict"), longest).alias("won"))
    )
    out = base.join(best, (base["host"] == best["b_host"]) & (base["path"] == best["b_path"]), "left")
    return out.select(
        *rest, "host", "path", F.col("won.r_rule").alias("rule"), F.coalesce("won.r_verdict", F.lit(default)).alias("verdict")
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return match_urls(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT page_id, host, path,
       (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u
"""
