"""Time the headline queries and print one JSON line.

The tables are those of $BENCH_SF_DIR, the session has $BENCH_CPUS threads. Each query is
run to the end (all rows computed, none kept). ``load_deliveries`` is the whole load job:
four deliveries parsed, repaired, measured, digested and written; the queries over the
delivery table read what it wrote.
"""

from __future__ import annotations

import json
import os
import time

from tallymap.plans.queries import QUERIES, deliveries, wide
from tallymap.session import get_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

HEADLINE = (
    "fingerprint_md5", "repair_projection", "area_ha", "length_km", "delivery_stats", "point_census",
    "collection_signatures", "stats_pivot", "aggregate_by_project", "diff_area", "diff_length", "missing_in_b",
    "reconcile", "diff_area_by_communes", "diff_fingerprints", "drill_fingerprint", "same_geometry_pairs",
    "check_dependencies", "fd_conflict_pairs", "audit_validity", "bbox_overlap_join", "bbox_overlap_area",
    "extract_with_footprint", "extract_by_commune", "kpi_summary", "level_histogram", "read_feature_pages",
    "read_copy_dump", "bbox_filter", "rank_by_area", "limit_features", "generalise_gate", "emit_fragments",
    "export_map_features", "validate_schema", "compare_attribute_syntax",
)


def timed(job) -> float:
    start = time.time()
    job()
    return round(time.time() - start, 3)


def main() -> None:
    spark = get_session("bench")
    seconds = {
        "load_deliveries": timed(lambda: deliveries(spark, SF_DIR)),
        "load_wide": timed(lambda: wide(spark, SF_DIR)),
    }
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        )
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
