"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without: it gets one
    temporary folder for its lifetime."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="docaudit-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return base


_LOCAL: dict[str, str | None] = {}
_OPEN: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docaudit/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, keep: Sequence[str] = ()) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, but for those whose name is in keep: what reads them
    must have run by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        written = _OPEN.pop()
        kept = [x for x in written if x.rsplit("/", 1)[1].rsplit("-", 1)[0] in keep]
        delete(spark, [x for x in written if x not in kept])
        if _OPEN:
            _OPEN[-1].extend(kept)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str = SPACE) -> Column:
    """Array of the runs of characters outside the class `separators`; null text: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators + "+"), lambda w: w != "")


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; looks at no more than one above."""
    return df.limit(rows + 1).count() <= rows


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only if the row count is checked to lie within the bound; beyond it a shuffle join follows."""
    return F.broadcast(df) if small(df, rows) else df
