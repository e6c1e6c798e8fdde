"""Headline benchmark: run registered queries at ``$BENCH_SF_DIR`` on
``local[$BENCH_CPUS]`` and print one JSON line with per-query seconds.

Each query is executed in full with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "r05_sample_exact_lineitem",
    "r08_rebalance_target_lineitem_up",
    "r08_rebalance_target_lineitem_down",
    "r09_rebalance_binary_up",
    "r10_rebalance_continuous_up",
    "r10_rebalance_continuous_down",
    "r11_rebalance_categorical_up",
    "r16_distribution_stats",
    "s02_train_test_split",
    "f08_feature_prep",
    "e01_confusion_matrix",
    "e04_summary_metrics",
    "e05_roc_auc_macro",
    "r13_smote",
    "m07_quick_loop",
    "o04_early_exit",
    "o02_sweep_value_majority",
    "i06_primary_entry",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from shiftlab.plans.registry import queries
    from shiftlab.session import get_spark

    spark = get_spark("shiftlab-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    # Untimed warm-up: JVM start, codegen and the parquet reader path.
    spark.range(10_000).selectExpr("md5(cast(id as string)) AS h").groupBy("h").count() \
        .write.format("noop").mode("overwrite").save()
    out: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            out[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep going
            out[name] = None
            print(f"{name} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    total = round(sum(v for v in out.values() if v is not None), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_headline_sec", "value": total, "unit": "sec", "queries": out,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
