"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

import workload
from effnum.session import build_session

HEADLINE = (
    "ttr_by_lang",
    "distinct2_by_source",
    "self_bleu_by_conversation",
    "self_bleu_by_source",
    "hill_cosine_by_label",
    "hill_squared_cosine_by_label",
    "hill_squared_cosine_whole_table",
    "hill_mean_adjusted_by_label",
    "hill_exp_l2_by_label",
    "token_hill_by_conversation",
    "sequence_hill_orders_by_priority",
    "pos_shape_hill_by_conversation",
    "rhythmic_hill_by_conversation",
    "tree_hill_orders_by_priority",
    "rank_top5_by_centroid",
    "select_max_min_by_lang",
    "spearman_quality_by_lang",
    "universal_hierarchical_by_source",
    "window_profile_by_document",
    "nested_sample_ttr_by_lang",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the Python workers and compiles the common code.
    workload.QUERIES["hill_squared_cosine_by_label"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        workload.QUERIES[name](spark, folder).collect()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
