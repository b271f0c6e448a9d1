"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores, ``BENCH_REPS`` the timed runs per query after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_labeled_csv", "mask_labels", "count_windows", "moments", "moments_prefix", "moments_wide", "accuracy_join",
    "ridge_fit", "ridge_predict", "per_group_ridge", "ridge_event_windows", "ridge_stream", "slog_fit", "slog_predict",
    "svm_gradient", "svm_fit", "svm_local_sgd", "sgd_ridge", "sgd_lasso",
    "gmm_match", "gmm_em_step", "gmm_predict", "gmm_fit",
    "tokens", "doc_term_counts", "vocab_by_df", "tfidf", "top_words", "lda_estep", "lda_update", "lda_fit",
    "sax_words", "sax_classify",
]
# A query whose first run is longer than this is timed by that run alone.
LONG = 30.0


def main() -> None:
    from tidelearn.catalog import QUERIES
    from tidelearn.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        first = run(name)
        times[name] = round(first if first > LONG else statistics.median([run(name) for _ in range(reps)]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
