"""Command line for scheduled runs (``spark-submit -m``-style or ``python -m``).

    python -m trafficscore refresh       # full RFM recompute  (NETWORK_LOG_DIR -> OUTPUT_FILE)
    python -m trafficscore incremental   # scores of new packet rows (LOG_DATA_PATH -> RFM_OUTPUT_DIR)
    python -m trafficscore decide LOGS RFM_TABLE OUT [--window S] [--limit N]

Settings come from the deployment's environment variables (``config.from_env``).
The session is whatever the submitter configured (``getOrCreate``).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv=None) -> int:
    from trafficscore.config import from_env
    from trafficscore.plans import jobs
    from trafficscore.session import ship_package

    p = argparse.ArgumentParser(prog="trafficscore")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("refresh")
    inc = sub.add_parser("incremental")
    inc.add_argument("--fmt-in", default="csv", choices=["csv", "parquet"])
    dec = sub.add_parser("decide")
    dec.add_argument("logs")
    dec.add_argument("rfm_table")
    dec.add_argument("out")
    dec.add_argument("--window", type=float, default=60)
    dec.add_argument("--limit", type=int, default=10)
    args = p.parse_args(argv)

    spark = SparkSession.builder.appName(f"trafficscore-{args.cmd}").getOrCreate()
    ship_package(spark)
    cfg = from_env()
    if args.cmd == "refresh":
        n = jobs.refresh_from_config(spark, cfg)
        print(f"RFM table saved ({n} rows)")
    elif args.cmd == "incremental":
        path = jobs.run_incremental(spark, cfg.log_data_path, cfg.rfm_output_dir, cfg.last_run_file,
                                    fmt_in=args.fmt_in)
        print(f"scores written to {path}" if path else "no new rows since the last run")
    else:
        n = jobs.decide_job(spark, args.logs, args.rfm_table, args.out, window_seconds=args.window,
                            limit=args.limit)
        print(f"decisions written to {args.out} ({n} challenged)")
    return 0


if __name__ == "__main__":
    sys.exit(main())
