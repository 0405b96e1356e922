"""Wall time of the headline queries, as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs once to warm up and
once for its time, and its whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from listinglake.catalog import QUERIES  # noqa: E402
from listinglake.session import local_session  # noqa: E402

HEADLINE = [
    "current_gigs", "new_or_changed", "last_scraped", "effective_class", "class_status", "metal_gigs", "overridden",
    "seq_assign", "compact", "compact_verify", "chk_misshapen", "chk_unparsed", "chk_duplicate", "chk_crowded",
    "chk_shared_poster", "chk_shared_desc", "chk_contamination", "quality_report", "withheld", "crowded_bulk",
    "lookalikes", "replacements", "to_classify", "cost_report", "status_breakdown", "page_rows", "date_group_cards",
    "publish_delta", "year_rollover", "dedupe_first", "json_listing", "dom_shred", "dom_descend", "para_drop",
    "date_range", "poster_rows", "stream_latest", "extract_listing",
]


def seconds(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    times = {}
    for name in names:
        seconds(spark, sf_dir, name)
        times[name] = round(seconds(spark, sf_dir, name), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
