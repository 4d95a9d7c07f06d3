"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each is run twice, the second counts."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lanternsift.plans import api
from lanternsift.plans.queries import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
HEADLINES = ["d_email_spans", "d_phone_spans", "d_card_spans", "d_ipv4_spans", "p_exact_dups", "p_leakage", "p_decontaminate", "g_masked_metrics", "g_threshold_sweep", "g_auc", "s_digest_split", "a_html_text"]


def seconds(run) -> float:
    t = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = queries(), {}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()

    def scan():
        spread = docs.select("doc_id", "text").repartition(2 * int(CPUS))
        return api.report(spread).select("doc_id", "label", "risk_score", F.size("entities").alias("n"))

    for name, run in [("scan_report", scan), *((n, lambda n=n: known[n](spark, SF_DIR)) for n in HEADLINES)]:
        seconds(run)
        took[name] = round(seconds(run), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    out = {"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}
    out["scan_mb_s"] = round(size[1] / 1e6 / took["scan_report"], 2)
    out["scan_docs_s"] = round(size[0] / took["scan_report"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
