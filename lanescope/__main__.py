"""Command line: load shipments, clean them, run the analyses, export CSV results.

    python -m lanescope report --staging 'landing/*.csv' --out outputs/
    python -m lanescope report --tpch /root/testdata/sf0.01 --out outputs/ --all
    python -m lanescope show worst_lanes --tpch /root/testdata/sf0.01

``report`` writes the three final outputs under their usual names (warehouse_scorecard,
carrier_scorecard, destination_scorecard) and, with ``--all``, every other analysis too; each as
a header CSV folder. Use the cluster's session settings (spark-submit) for large inputs.
"""

from __future__ import annotations

import argparse
import sys

FINAL_OUTPUTS = {"warehouse_scorecard": "warehouse_scorecard", "carrier_scorecard": "carrier_positioning",
                 "destination_scorecard": "worst_lanes"}


def _log_data(spark, args):
    from .plans.registry import log_data_for, log_data_from_csv
    if args.tpch:
        return log_data_for(spark, args.tpch)
    return log_data_from_csv(spark, args.staging, mode=args.mode, multi_line=args.multi_line, unique=args.unique,
                             date_format=args.date_format)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="lanescope")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("report", "show"):
        sp = sub.add_parser(name)
        src = sp.add_mutually_exclusive_group(required=True)
        src.add_argument("--staging", help="staging CSV path or glob (header, 11 text columns)")
        src.add_argument("--tpch", help="folder of the driver tables (adapter input)")
        sp.add_argument("--multi-line", action="store_true", help="line breaks inside quoted fields")
        sp.add_argument("--unique", action="store_true", help="enforce the key: repeated and missing ids are set aside")
        sp.add_argument("--date-format", help="pattern of the dates, such as dd.MM.yyyy (default: ISO dates)")
        sp.add_argument("--mode", default="quarantine", choices=["quarantine", "strict"])
        if name == "report":
            sp.add_argument("--out", required=True)
            sp.add_argument("--all", action="store_true", help="export every analysis")
        else:
            sp.add_argument("analysis")
            sp.add_argument("-n", type=int, default=20)
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from .plans.registry import REPORTS, edge
    from .session import BASE_CONF
    b = SparkSession.builder.appName("lanescope")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    log = _log_data(spark, args)

    if args.cmd == "show":
        edge(REPORTS[args.analysis](log)).show(args.n, truncate=False)
        return 0
    from .sources.files import export_csv
    todo = dict((out, REPORTS[a]) for out, a in FINAL_OUTPUTS.items())
    if args.all:
        todo.update(REPORTS)
    for out, fn in todo.items():
        export_csv(edge(fn(log)), f"{args.out.rstrip('/')}/{out}", single_file=True)
        print(f"wrote {args.out.rstrip('/')}/{out}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
