"""Seconds per headline query. Prints one JSON line."""

import json
import os
import time

from ehrseq.plans import trial_run
from ehrseq.plans.catalog import QUERIES
from ehrseq.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Each of these starts from the given tables, without staged results of an earlier query.
FROM_SCRATCH = ["drug_to_ingredient", "link_by_date", "link_events", "labelled_sequences", "token_stream", "sequences"]
# These read the staged token stream.
ON_TOKENS = [
    "concept_vocabulary",
    "encode",
    "truncate_random",
    "model_inputs",
    "mask_one_per_visit",
    "next_token",
    "next_visit_set",
    "baseline_scores",
    "dense_visits",
]
OTHERS = ["metric_rows", "result_summary", "window_labels", "history_events", "cohort_statistics"]


def main():
    spark = local_session("bench", cores=CPUS, shuffle_partitions=int(CPUS), **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")

    def seconds(name):
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # Start the engine on a query that is not measured.
    seconds("cdm_scan")
    timings = {}
    for name in FROM_SCRATCH:
        trial_run.forget_runs()
        timings[name] = seconds(name)
    for name in ON_TOKENS + OTHERS:
        timings[name] = seconds(name)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
