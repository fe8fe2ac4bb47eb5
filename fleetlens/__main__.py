"""Run registered reports from the command line.

    python -m fleetlens list
    python -m fleetlens run <name> [--sf-dir DIR] [--show N | --out PATH] [--explain]
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="fleetlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered reports")
    run = sub.add_parser("run", help="run one registered report")
    run.add_argument("name")
    run.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    run.add_argument("--landed", help="root folder of landed telemetry (one folder per table) instead of --sf-dir")
    run.add_argument("--start", help="with --landed: time of the capture a delta starts from")
    run.add_argument("--end", help="with --landed: time of the capture to report on (default: each server's newest)")
    run.add_argument("--show", type=int, default=20)
    run.add_argument("--out", help="write the result as parquet here instead of showing it")
    run.add_argument("--explain", action="store_true", help="print the formatted physical plan")
    args = ap.parse_args(argv)

    from .registry import load_all
    reg = load_all()
    if args.cmd == "list":
        for name, entry in sorted(reg.items()):
            print(f"{name:40s} {entry.doc.splitlines()[0] if entry.doc else ''}")
        return 0
    if args.name not in reg:
        print(f"unknown report {args.name!r}; see 'python -m fleetlens list'", file=sys.stderr)
        return 2
    from .session import get_session
    from .sources.telemetry import LandedTelemetry, Telemetry
    spark = get_session()
    source = LandedTelemetry(spark, args.landed, start=args.start, end=args.end) if args.landed else Telemetry(spark, args.sf_dir)
    df = reg[args.name].build(source)
    if args.explain:
        df.explain("formatted")
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
