"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from docaudit.plans import catalog
from docaudit.session import local_session

HEADLINE = [
    "eval_field_breakdown", "eval_summary", "eval_per_sample", "diff_review", "structural_diff", "flatten_leaves", "template_fill", "token_serialise", "schema_validate_errors", "text_normalise_key", "typed_value_inventory", "field_statistics", "numeric_outliers_mad",
    "typo_candidates", "semantic_checks", "fd_rules", "fd_rule_exceptions", "duplicate_text_groups", "nearest_peers", "review_queue", "location_proposals", "image_annotation_pairing", "dataset_split", "sequence_length_stats", "asof_metric", "chat_normalise", "lenient_jsonl_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    known = catalog.queries()
    names = sys.argv[1:] or [n for n in HEADLINE if n in known]
    took = {}
    known[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers and the readers
    for name in names:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
