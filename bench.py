"""Times the headline queries; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from quern.plans import registry

NAMES = ["token_counts", "nonalpha_counts", "type_stats", "syllable_counts", "token_route", "mapped_route", "bpe_pair_counts", "bpe_learn", "flagship"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["distinct_types"](spark, sf).collect()  # warm-up
    times = {}
    for name in NAMES:
        t = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
