"""Command line: `python -m strandline.cli <directory> [options]`, or through spark-submit."""

from __future__ import annotations

import argparse
import logging
import sys

from .logs import enable_logging
from .operators.catalog import HistoryCollection
from .plans.presets import preset
from .plans.stats import collection_stats, order_stats
from .session import build_session, ship

LOG = logging.getLogger("strandline")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description="Turn history files into per-variable time series.")
    # Names, short forms and defaults of the options.
    p.add_argument("hf_head_dir", help="directory of the history files")
    p.add_argument("-o", "--outputdir", help="directory of the series (default: the input directory)")
    p.add_argument("-v", "--verbose", action="store_true", help="log settings and figures")
    p.add_argument("-V", "--version", action="version", version="%(prog)s 1")
    p.add_argument("-d", "--dryrun", action="store_true", help="plan only; write nothing")
    p.add_argument("-w", "--overwrite", action="store_true", help="write series that are complete anew")
    p.add_argument("-sl", "--slice", type=int, default=10, help="years in one output")
    p.add_argument("--slice_start_year", type=int, default=None, help="first year of the first slice (default: that of the data)")
    p.add_argument("-hc", "--hfcores", type=int, default=64, help="tasks that read metadata")
    p.add_argument("-tc", "--tscores", type=int, default=8, help="tasks that write series")
    p.add_argument("-m", "--model", default=None, help="preset: CESM3, CESM2 or E3SM")
    p.add_argument("--exclude", action="append", default=[], help="glob of paths to leave out; may be given again")
    p.add_argument("--include", action="append", default=[], help="glob of paths to take; may be given again")
    p.add_argument("--append", action="store_true", help="add the globs to the preset's instead of replacing them")
    p.add_argument("--align_method", default="midpoint", help="midpoint, direct_time, start_bound or end_bound")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    enable_logging(args.verbose)
    conf = preset(args.model)
    for name in ("include", "exclude"):
        if given := getattr(args, name):
            setattr(conf, name, [*getattr(conf, name), *given] if args.append else given)
    LOG.info("settings: %s; %s", vars(args), conf)
    spark = build_session("strandline-cli", **{"spark.sql.files.minPartitionNum": str(args.hfcores)})
    ship(spark)
    files: HistoryCollection = conf.history(spark, args.hf_head_dir, args.slice, args.slice_start_year, args.align_method)
    orders = conf.orders(files, args.outputdir or args.hf_head_dir, overwrite=args.overwrite)
    orders = orders.add_attrs({"strandline_command": " ".join(sys.argv if argv is None else ["strandline", *argv])})
    LOG.info("%s", collection_stats(files.grouped()).first())
    LOG.info("%s", order_stats(orders.frame).first())
    if args.dryrun:
        for r in orders.frame.groupBy("group_id", "slice_start", "slice_end").count().orderBy("group_id", "slice_start").toLocalIterator():
            print(f"{r['group_id']} {r['slice_start']} to {r['slice_end']}: {r['count']} time series")
        return 0
    failed = [r for r in orders.execute(tasks=args.tscores).collect() if r["error"]]
    for r in failed:
        LOG.error("%s: %s", r["out_path"], r["error"])
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
