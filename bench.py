"""Wall time of the fixed queries over $BENCH_SF_DIR, as one line of JSON."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from strataline.plans import atlas, charts, climate, diagnostics, models, ocean, registry, usage  # noqa: F401 (these fill the registry)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.warehouse.dir", f"{home}/warehouse").config("spark.checkpoint.dir", f"{home}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().collect()  # the session's start isn't a query's time
    took = {}
    for name, query in registry.queries().items():
        began = time.time()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
