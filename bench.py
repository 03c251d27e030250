"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from corpuscle.plans.queries import QUERIES

HEADLINE = (
    "vocab", "keyness_log_likelihood", "keyness_multi", "keyness_p_adjusted", "bootstrap_ci", "permutation_pvalues", "collocation_shift",
    "network_edges", "kwic", "ttr_mattr_hdd", "mtld", "cem_strata", "over_time", "burstiness", "causal_impact", "forecast", "knn_novelty", "sense_drift",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
