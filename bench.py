"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from wardloom.plans import registry

#: Python workers import the package too, wherever this is started from.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Each query with the rows that it works through, for rows a second.
HEADLINE = {
    "voter_search": "customer", "name_search": "customer", "batch_search": "documents", "phonetic_key": "documents", "apply_supplements": "orders", "households": "customer",
    "first_mark": "events", "ward_counts": "events", "latest_per_id": "events", "newer_than_state": "events", "consent_state": "events", "sms_encode": "events",
    "page_dedupe": "lineitem", "catalogue_build": "lineitem", "compare_entries": "customer", "percentiles": "orders", "segment_records": "conversations", "stream_latest": "events",
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    seconds, rates = {}, {}
    for name, table in HEADLINE.items():
        best = []
        for _ in range(2):
            start = time.perf_counter()
            found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        seconds[name] = round(min(best), 3)
        rates[name] = round(spark.read.parquet(f"{SF_DIR}/{table}.parquet").count() / min(best))
    asked = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").count()
    out = {"metric": "headline queries, seconds in all", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "rows_per_sec": rates, "searches_per_sec": round(asked / seconds["batch_search"], 1)}
    spark.stop()
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
