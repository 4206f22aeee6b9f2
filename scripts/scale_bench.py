"""Reports at the reference's data scale (~13.3 M transactions).

    python scripts/scale_bench.py [--sf-dir /root/testdata/sf0.1] [--copies 133] [--cpus 8]

The sf0.1 transactions (100,000) are repeated ``copies`` times with shifted ids
(a generator, not a join), staged once to Parquet under a fresh scratch folder,
and every transaction report is then timed on the staged table, read -> clean
-> features -> report, with the ``noop`` sink. With ``--stage-clean`` the cleaned
table with features is staged once more (Parquet by year) and the reports read
that copy instead. Prints one JSON line per report and a summary line.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from txnlens.operators import aggregates as agg  # noqa: E402
from txnlens.operators import quantiles, risk  # noqa: E402
from txnlens.operators.cleaning import clean_transactions  # noqa: E402
from txnlens.operators.features import txn_features  # noqa: E402
from txnlens.plans import catalog  # noqa: E402
from txnlens.sources import adapters  # noqa: E402
from txnlens.sources.staging import stage  # noqa: E402

REPORTS = {
    "txn_by_channel": agg.txn_by_channel,
    "txn_by_year": agg.txn_by_year,
    "busiest_hours": agg.busiest_hours,
    "top_states": agg.top_states,
    "top_cities": agg.top_cities,
    "customer_summary": agg.customer_summary,
    "top_spenders": agg.top_spenders,
    "error_types": agg.error_types,
    "amount_quantiles": lambda t: quantiles.quartiles(t, "amount"),
    "amount_high_outliers": lambda t: quantiles.outlier_shape(t, "amount", "high"),
    "overview": risk.overview,
    "revenue_growth": risk.revenue_growth,
    "error_rate_by_type": risk.error_rate_by_type,
    "high_risk_customers": risk.high_risk_customers,
    "channel_mix_by_year": risk.channel_mix_by_year,
    "customer_tiers": risk.customer_tiers,
    "geography": risk.geography,
    "refund_summary": risk.refund_summary,
    "refund_customers": risk.refund_customers,
    "error_rate_by_hour": risk.error_rate_by_hour,
}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--copies", type=int, default=133)
    ap.add_argument("--cpus", type=int, default=8)
    ap.add_argument("--stage-clean", action="store_true",
                    help="also stage the cleaned transactions (by year) and run the reports on that copy")
    args = ap.parse_args()

    scratch = tempfile.mkdtemp(prefix="txnlens-scale-")
    spark = (SparkSession.builder.master(f"local[{args.cpus}]")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", str(4 * args.cpus))
             .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoint"))
             .config("spark.local.dir", os.path.join(scratch, "local"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    # spread the 100k source rows first, so the copies are written as many files
    raw = adapters.txn_raw(spark, args.sf_dir).repartition(4 * args.cpus)
    span = 10 ** 9  # above any benchmark event id
    copy = F.explode(F.sequence(F.lit(0), F.lit(args.copies - 1))).alias("_copy")
    scaled = raw.select("*", copy).withColumn("id", F.col("id") + F.col("_copy").cast("bigint") * F.lit(span)).drop("_copy")
    t0 = time.perf_counter()
    staged_raw = stage(scaled, os.path.join(scratch, "transactions_raw"))
    n = staged_raw.count()
    t_stage = time.perf_counter() - t0
    txn = txn_features(clean_transactions(staged_raw))
    t_clean = None
    if args.stage_clean:
        t1 = time.perf_counter()
        txn = stage(txn, os.path.join(scratch, "transactions_clean"), ["year"], files_per_value=args.cpus)
        t_clean = round(time.perf_counter() - t1, 2)
    cards = catalog.cards(spark, args.sf_dir)

    results = {}
    jobs = dict(REPORTS)
    jobs["dark_web_cards"] = lambda t: risk.dark_web_cards(t, cards)
    for name, report in jobs.items():
        t1 = time.perf_counter()
        report(txn).write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t1
        results[name] = round(sec, 3)
        print(json.dumps({"report": name, "sec": round(sec, 3), "rows_per_sec": int(n / sec)}), flush=True)
    print(json.dumps({"transactions": n, "stage_sec": round(t_stage, 2), "clean_stage_sec": t_clean,
                      "cpus": args.cpus,
                      "total_report_sec": round(sum(results.values()), 2),
                      "median_report_sec": sorted(results.values())[len(results) // 2]}))
    spark.stop()


if __name__ == "__main__":
    main()
