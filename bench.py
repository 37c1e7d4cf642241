"""Wall-clock seconds of the headline queries; one JSON line. Short queries run three times, and their median counts."""

import importlib.util
import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["flagship_ranking_eval", "lexical_ranks", "gain_ndcg", "rule_score", "select_topk_per_group", "dense_topk", "lexical_cosine_pairs", "history_text", "events_sessions", "dense_gain", "text_rewards"]
SHORT_S = 10


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries = entry.queries()
    took = {}
    for name in NAMES + [q for q in queries if q.startswith("op") or q == "pipeline"]:
        runs = []
        while not runs or (name in NAMES and len(runs) < 3 and runs[0] < SHORT_S):
            began = time.time()
            queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(FOLDER.rstrip("/"))}))


if __name__ == "__main__":
    main()
