"""Sinks. Spark writes folders of part files; the few single documents (summaries, pages) are small by construction and
go through the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.operators.datasets import first_wins

BOM = "﻿"


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """JSON Lines with null fields kept; a folder that is not empty is an error unless overwritten."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], *, overwrite: bool = False) -> None:
    """CSV with a fixed column order; the header of each part starts with a byte-order mark for spreadsheets."""
    out = df.select(*columns).withColumnRenamed(columns[0], BOM + columns[0])
    out.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_json(value: Any, path: str) -> None:
    """One pretty JSON document, written beside and moved into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_suffix(target.suffix + ".new")
    beside.write_text(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    beside.replace(target)


def embed_json(value: Any) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(value, ensure_ascii=False, default=str).replace("</", "<\\/")


def write_review_page(queue: DataFrame, path: str, *, title: str = "Review", most: int = 2000) -> int:
    """A static page with the first `most` rows of a ranked queue (a page for people; the full queue is a table)."""
    rows = [r.asDict(recursive=True) for r in queue.limit(most).collect()]
    body = f"<!doctype html><meta charset=utf-8><title>{title}</title><table id=t></table><script>const rows={embed_json(rows)};const t=document.getElementById('t');for(const r of rows){{const x=t.insertRow();for(const k in r)x.insertCell().textContent=JSON.stringify(r[k])}}</script>"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(body, encoding="utf-8")
    return len(rows)


def write_report(tables: dict[str, DataFrame], summary: dict[str, Any], path: str) -> None:
    """An audit's tables, each a Parquet folder, and its summary."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_json(summary | {"written": datetime.now(UTC).isoformat()}, f"{path}/summary.json")


def apply_changes(values: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """values(sample_id, field, value), changes(sample_id, field, old, new): a new version of the values at path. A change
    whose old value is not what stands there fails the job; nothing is changed in place."""
    c = changes.select(F.col("sample_id").alias("c_id"), F.col("field").alias("c_field"), "old", "new")
    met = values.join(c, (F.col("sample_id") == F.col("c_id")) & (F.col("field") == F.col("c_field")), "left")
    stale = F.col("c_id").isNotNull() & ~F.col("old").eqNullSafe(F.col("value"))
    new = F.when(stale, F.raise_error(F.concat(F.lit("stale value of "), F.col("sample_id").cast("string"))).cast("string")).when(F.col("c_id").isNotNull(), F.col("new")).otherwise(F.col("value"))
    met.select("sample_id", "field", new.alias("value")).write.mode("errorifexists").parquet(path)
    return values.sparkSession.read.parquet(path)


def merge_manifests(manifests: Sequence[DataFrame]) -> DataFrame:
    """Union of change manifests in order; of equal changes the first stays."""
    whole = None
    for n, m in enumerate(manifests):
        part = m.withColumns({"__file": F.lit(n), "__line": F.monotonically_increasing_id()})
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return first_wins(whole, ["sample_id", "field", "old", "new"], ["__file", "__line"]).drop("__file", "__line")


def copy_manifest(files: DataFrame, root: str, out: str) -> DataFrame:
    """files(path, split): source and destination of each file, the path below root kept."""
    below = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    return files.select("path", F.concat(F.lit(out.rstrip("/") + "/"), "split", F.lit("/"), below).alias("destination"))


class RunStatus:
    """The status document of a run: running, completed or failed, with the elapsed seconds at its end."""

    def __init__(self, path: str, name: str, **fields: Any) -> None:
        self.path, self.fields, self.began = path, {"name": name, **fields}, datetime.now(UTC)
        self.write("running")

    def write(self, status: str, **metrics: Any) -> dict[str, Any]:
        now = datetime.now(UTC)
        value = {**self.fields, "status": status, "started": self.began.isoformat(), "metrics": metrics}
        if status != "running":
            value |= {"finished": now.isoformat(), "elapsed_s": (now - self.began).total_seconds()}
        write_json(value, self.path)
        return value
