"""JSON Lines, JSON, CSV and file scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), raw of every line of the files under path. A file is split by its reader only whole, so that
    line numbers hold; give many files for parallelism."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def check_lines(lines: DataFrame, required: Sequence[str] = ("id", "image"), path_key: str = "image") -> DataFrame:
    """lines(line, raw) -> line, id, image, error: blank lines are skipped; a malformed line, a missing key, a path that
    leaves the root and a repeated id (the first wins) are errors of their row. Nothing fails."""
    doc = F.try_parse_json("raw")
    rows = lines.where(F.trim("raw") != "").select("line", doc.alias("doc"), *[F.try_variant_get(doc, f"$.{k}", "string").alias(k) for k in required])
    missing = F.lit(False)
    for k in required:
        missing = missing | F.col(k).isNull()
    p = F.col(path_key)
    error = F.when(F.col("doc").isNull(), "malformed").when(missing, "missing key").when(p.startswith("../") | p.startswith("/") | p.contains("/../"), "path escapes")
    rows = rows.withColumn("error", error)
    first = rows.where("error IS NULL").groupBy(F.col("id").alias("f_id")).agg(F.min("line").alias("first"))
    met = rows.join(first, F.col("id") == F.col("f_id"), "left")
    return met.select("line", *required, F.coalesce("error", F.when(F.col("line") != F.col("first"), "duplicate id")).alias("error"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines that must all parse; the first bad line fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, doc (VARIANT; null if the file is no JSON) of every .json file."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return text.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def list_files(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGES) -> DataFrame:
    """path, dir, stem, ext of the files with these extensions; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    stem, ext = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    out = found.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), stem.alias("stem"), ext.alias("ext"))
    return out.where(F.col("ext").isin(*[e.lower() for e in extensions]))


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; a byte-order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def relocate(listing: DataFrame, wanted: DataFrame, ignored: str = "annotation_audit") -> DataFrame:
    """wanted(path) that the listing lacks, with the one file of the same name elsewhere; null if there are several."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    unique = listing.where(~F.col("path").contains(f"/{ignored}/")).groupBy(name(F.col("path")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("found")).where("n = 1")
    missing = wanted.join(listing, "path", "left_anti").withColumn("w_name", name(F.col("path")))
    return missing.join(unique, F.col("w_name") == F.col("name"), "left").select("path", "found")
