"""Dataset layouts: detection, row decoding, path resolution, checkpoints and experiment configurations."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALIDATION = ("validation", "val", "dev")
IMAGE_KEYS = ("images", "image_paths", "image_path", "image")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def detect(root: str) -> str:
    """project (a metadata.jsonl in each split), single (one at the root), conversational (train.jsonl) or flat."""
    r = Path(root)
    if (r / "train" / "metadata.jsonl").is_file():
        return "project"
    if (r / "metadata.jsonl").is_file():
        return "single"
    return "conversational" if (r / "train.jsonl").is_file() else "flat"


def validation_split(root: str, requested: str | None = None) -> str | None:
    """The requested split if it exists (an error if not), else the first usual one that does."""
    there = [s for s in ((requested,) if requested else VALIDATION) if (Path(root) / s).is_dir() or (Path(root) / f"{s}.jsonl").is_file()]
    if requested and not there:
        raise FileNotFoundError(f"no split {requested} in {root}")
    return there[0] if there else None


def image_list(doc: Column) -> Column:
    """array<string> of a row's images, under the first of the usual keys that it has; a lone string is one image."""
    many = [F.try_variant_get(doc, f"$.{k}", "array<string>") for k in IMAGE_KEYS]
    one = [F.when(F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")) == "STRING", F.array(F.try_variant_get(doc, f"$.{k}", "string"))) for k in IMAGE_KEYS]
    return F.coalesce(*[x for pair in zip(many, one, strict=True) for x in pair])


def target_of(doc: Column, key: str = "ground_truth", inner: str = "gt_parse") -> Column:
    """The target of a row whose truth is an object or JSON text of one (VARIANT; null if it has none)."""
    nested = F.try_parse_json(F.try_variant_get(doc, f"$.{key}", "string"))
    return F.coalesce(F.try_variant_get(nested, f"$.{inner}", "variant"), F.try_variant_get(doc, f"$.{key}.{inner}", "variant"))


def resolve_under(root: str, path: Column) -> Column:
    """Absolute path below root; null where the path leaves it."""
    escapes = path.startswith("/") | (path == "..") | path.startswith("../") | path.contains("/../") | path.endswith("/..")
    return F.when(~escapes, F.concat(F.lit(root.rstrip("/") + "/"), path))


def first_existing(rows: DataFrame, listing: DataFrame, path: str, bases: Sequence[str]) -> DataFrame:
    """rows with `found`: the first of base/path (or path itself, if absolute) that the listing(path) holds."""
    options = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(b.rstrip("/") + "/"), F.col(path)).alias("full")) for i, b in enumerate(bases)], F.struct(F.lit(len(bases)).alias("rank"), F.col(path).alias("full")))
    there = listing.select(F.col("path").alias("full")).distinct()
    best = rows.select(path).distinct().select(path, F.inline(options)).join(there, "full").groupBy(path).agg(F.min_by("full", "rank").alias("found"))
    return rows.join(best, path, "left")


def checkpoints(paths: DataFrame) -> DataFrame:
    """paths(path) -> path, step of the folders named checkpoint-<step>, in numeric order."""
    step = F.regexp_extract("path", r"(?:^|/)checkpoint-(\d+)$", 1)
    return paths.select("path", F.nullif(step, F.lit("")).cast("bigint").alias("step")).where("step IS NOT NULL").orderBy("step")


def trainer_state(states: DataFrame) -> DataFrame:
    """states(path, content): the state at the root if there is one, else that of the newest checkpoint that has one."""
    step = F.coalesce(F.nullif(F.regexp_extract("path", r"checkpoint-(\d+)/", 1), F.lit("")).cast("bigint"), F.lit((1 << 62)))
    return states.agg(F.max_by(F.struct("path", "content"), step).alias("s")).select("s.*").where("path IS NOT NULL")


def sample_id(path: Column, root: str) -> Column:
    """The path below root, without extension, its parts joined by two underscores."""
    below = F.regexp_replace(path, "^" + re.escape(root.rstrip("/") + "/"), "")
    return F.replace(F.regexp_replace(below, r"\.[^./]*$", ""), F.lit("/"), F.lit("__"))


def load_config(path: str, required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, Any]:
    """A versioned configuration with a closed set of keys and a plain name."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict) or value.get("format_version") != 1:
        raise ValueError(f"{path}: needs format_version 1")
    known = {"format_version", "name", *required, *optional}
    if wrong := [*(k for k in required if k not in value), *(k for k in value if k not in known)]:
        raise ValueError(f"{path}: missing or unknown keys {wrong}")
    if not _NAME.fullmatch(str(value.get("name", ""))):
        raise ValueError(f"{path}: bad name")
    return value


def queue_from(entries: Sequence[dict[str, Any]], start_at: str | None = None) -> list[str]:
    """Enabled configurations in order, from start_at on."""
    names = [e["config"] for e in entries if e.get("enabled", True)]
    if len(set(names)) != len(names):
        raise ValueError("a configuration is queued twice")
    if start_at is None:
        return names
    if start_at not in names:
        raise ValueError(f"{start_at} is not queued")
    return names[names.index(start_at) :]
