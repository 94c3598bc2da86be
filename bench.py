"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from auditloom.catalog import REGISTRY
from auditloom.session import local_session

HEADLINE = (
    "plan_secret_exposure", "plan_scan_summary",
    "r1_line_rules", "r1_pack_code", "r2_pack_webconfig", "r5_pack_websec_functions", "r7_repo_absence_rules",
    "r9_taint_flow", "r11_secret_scan", "r21_repo_signals", "r22_threat_model",
    "w1_dedup_findings", "a1_severity_stats", "j4_accept", "j5_attack_chains", "a6_checklist", "f13_exploitability",
    "j3_vulnerable_packages", "j6_typosquats", "s6_read_lockfiles", "f24_commit_score", "a17_churn_hotspots",
    "w4_merge_runs", "j16_ledger_merge", "w14_trend", "i3_monotonic", "i6_reentrant_traces", "a23_conservation",
    "w13_allocate_credits", "g1_reachable", "g4_dominators", "st2_interval_violations",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/region.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
