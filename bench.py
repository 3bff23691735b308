"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from reedmatch.operators import bm25
from reedmatch.plans import QUERIES, queries
from reedmatch.sources import staging

HEADLINE = ["tokenize_tf", "term_idf", "bm25_topk", "bm25_multi_profile", "match_pipeline", "html_to_text", "html_sections", "passages_hard_split", "passages_packed", "cache_antijoin", "merge_first_wins"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took, apart = {}, {}

    def timed(into: dict[str, float], name: str, work) -> None:
        began = time.time()
        work()
        into[name] = round(time.time() - began, 3)

    for name in HEADLINE:
        with staging.run(spark):
            timed(took, name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    with staging.run(spark) as folder:  # a ranking on a written index, apart from its building
        bag = queries.bag(spark, sf_dir)
        timed(apart, "index_build", lambda: bm25.write_index(queries.items(spark, sf_dir), f"{folder}/index"))
        for name in ("index_ranking_first", "index_ranking"):
            timed(apart, name, lambda: bm25.top(None, bag, queries.WIDTH, bm25.read_index(spark, f"{folder}/index")).collect())
        timed(apart, "index_ranking_by_bounds", lambda: bm25.top_by_bounds(bm25.read_index(spark, f"{folder}/index"), bag, 5)[0].collect())
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "apart": apart, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
