"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS
(default 1; the median counts) come from the environment; query names may be given as
arguments.  Each query first runs unmeasured on the smaller tables beside it.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crosscheck.queries import QUERIES  # noqa: E402
from reldrift.session import build_session  # noqa: E402

HEADLINE = [
    "scannable_files", "strip_comments", "url_tokens", "literal_tokens", "page_tokens", "url_classify",
    "string_entropy", "release_pairs", "new_urls", "findings", "evidence", "severity_score",
    "version_changes", "watched_versions", "registry_latest", "artifact_urls", "top_names",
    "recent_findings", "feed_items", "scan_stats", "archive_files", "stored_findings", "stream_version_changes",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, warm_dir if os.path.isdir(warm_dir) else sf_dir)
        timings[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline queries, total of medians",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
