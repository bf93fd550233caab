"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from hearthline.registered import catalog
from hearthline.session import local_session

HEADLINE = (
    "d9_cell_dispersion", "b4_quantile_trim", "b7_label_noise_flags", "c1_community_join_rate", "c4_reference_medians",
    "c5_group_mean_baseline", "c9_model_pairs", "d1_dataset_audit", "d4_regression_metrics", "d5_error_grouping_sets",
    "d7_descriptive_statistics", "d11_variance_decomposition", "d13_annotator_tables", "d19_spearman_matrix",
    "e1_keep_first", "e4_time_holdout", "e6_average_ranks", "e8_open_failures", "g1_keyword_labels", "g8_balance_scores",
    "g12_answer_parsing", "g14_page_text", "g20_distinct_facilities", "h3_stratified_sample", "h6_balanced_group_folds",
    "h8_bootstrap_interval", "i1_paired_t", "i2_wilcoxon_drop_zeros", "k5_latest_counters", "j3_ridge", "j5_random_forest", "j11_stacking",
)


#: Seconds after which no further query is started, so that the line of figures is always printed.
LIMIT = float(os.environ.get("BENCH_LIMIT", "1400"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_PARTITIONS", "8")), "bench")
    queries = catalog.queries()
    names = [n for n in HEADLINE if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds, left_out, begin = {}, [], time.perf_counter()
    for name in names:
        if time.perf_counter() - begin > LIMIT:
            left_out.append(name)
            continue
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": total, "unit": "sec", "queries": seconds, "not_started": left_out, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
