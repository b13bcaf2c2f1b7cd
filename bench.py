"""Benchmark of the headline queries.

Runs each query over the whole tables in ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and executes it fully with
the ``noop`` sink (every row is produced, nothing is collected).  Prints one
JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "extract_outlines",
    "spans_to_lines",
    "block_features",
    "build_cell_dataset",
    "build_heading_dataset",
    "label_cells",
    "detect_language",
    "outline_metrics",
    "roc_auc",
    "threshold_sweep",
    "stratified_split",
    "random_oversample",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("PAGEWISE_SHUFFLE_PARTITIONS", str(max(4, int(cpus) * 2)))
    from pagewise.session import get_session
    spark = get_session(master=f"local[{cpus}]")
    from pagewise.queries import REGISTRY

    # warm-up: every query once on the smallest scale, so JIT and first-use
    # costs are not billed to whichever query happens to run first
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in names:
            REGISTRY[name](spark, warm).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
