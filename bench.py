"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

``BENCH_FLEET=1`` adds extraction throughput (lines/s) over log lines rendered from the events.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fleetlog.catalog import QUERIES
from fleetlog.catalog.base import Tables
from fleetlog.session import local_session

HEADLINE = [
    "line_numbers", "bucket_counts", "line_context", "time_slice_carry", "merge_sort", "section_interval", "sip_extract", "dns_extract", "net_perf_extract", "signal_asof", "usage_rollup", "binder_classify", "layer_classify",
    "ntn_dedupe", "sat_metrics", "ril_pairing", "ril_timeouts", "datacall_verdict", "session_duration", "radio_power_pairs", "registration_changes", "native_blocks", "crash_blocks", "anr_blocks", "cs_calls", "ims_sessions",
    "context_seconds", "rf_correlation", "oos_override", "stall_windows", "stall_causes", "health_kpi", "nitz_stability", "question_plan", "route_rules", "vector_topk", "hybrid_rank", "verdicts", "doc_build", "ingest_delta",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the JVM, the code generator and the Python workers before the clock runs
    QUERIES["time_shapes"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["encoded_documents"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries = {n: timed(lambda: QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()) for n in names}
    out = {"metric": "headline queries, wall clock", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus) if cpus.isdigit() else cpus}
    if os.environ.get("BENCH_FLEET"):
        from fleetlog.catalog.stall_q import stall_lines
        from fleetlog.plans.analysis import analyse
        from fleetlog.session import prepare, stage

        lines = stage(stall_lines(Tables(prepare(spark), sf_dir)))
        n = lines.count()
        sec = timed(lambda: analyse(lines)["stall_windows"].write.format("noop").mode("overwrite").save())
        out["fleet"] = {"lines": n, "sec": sec, "lines_per_sec": round(n / sec, 1)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
