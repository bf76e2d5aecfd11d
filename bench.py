"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "decision", "opinion_text", "checklist", "rule_eval", "material_keyword", "missing_materials", "registry_match",
    "certificate_checks", "licence_checks", "attachment_combine", "attachment_ordinals", "severity_combine",
    "confidence_distribution", "latest_state", "call_counts", "expired_inventory", "first_claims", "audit_chain_head",
    "engine_agreement", "stratified_sample", "mask_documents", "extract_dedupe", "page_text", "resume_pending",
    "registry_enrichment", "supplier_profiles",
]


def main() -> None:
    from gatehouse.plans import operator_queries
    from gatehouse.plans.driver_queries import QUERIES as FIRST
    from gatehouse.session import build_session

    QUERIES = {**FIRST, **operator_queries.QUERIES}

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "20g"),
        # the files are small: cut them so that every core reads a part
        "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "1m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    warm = {}
    for name in (seconds if os.environ.get("BENCH_WARM") else []):  # once more, with compiled code
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        warm[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    line = {"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
            "cpus": int(cpus), **({"warm": warm} if warm else {})}
    if "decision" in seconds:
        line["requests_decided_per_second"] = round(requests / seconds["decision"], 1)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
