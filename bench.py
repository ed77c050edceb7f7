"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "snv", "savgol_first_derivative", "msc", "chain_raw", "outliers_zscore", "outliers_t2_all_channels",
    "moment_table_per_fold", "mean_spectrum", "replicate_spectra_median", "metrics_per_split", "target_summary",
    "distinct_rows_keep_first", "uninformative_columns_dropped", "numeric_means_imputed", "random_split",
    "shuffled_folds", "stratified_split", "latest_run_metrics", "pca_scores", "pls_ten_components",
    "vip_ten_components", "cars_history", "genetic_channels", "grid_search", "elastic_net_all_channels",
    "support_vector_linear", "random_forest", "gradient_boosting", "flagship_metrics", "single_experiment",
    "streamed_predictions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from wavetable.queries import QUERIES
    from wavetable.session import get_spark

    spark = get_spark("bench", cpus)
    QUERIES["snv"](spark, folder).write.format("noop").mode("overwrite").save()  # start the workers
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
