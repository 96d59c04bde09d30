"""``python -m sparkfringe.cli``: calibrate, config, backup, restore, summary and plot."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import preprocess, stats
from .plans import calibrate, config
from .sources import tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkfringe")
    jobs = top.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("calibrate", help="solve and apply")
    one.add_argument("options", nargs="+", help="YAML files, then section.option=value")
    one = jobs.add_parser("config", help="write a YAML file of all options")
    one.add_argument("path")
    one.add_argument("terms", nargs="*", default=["G"])
    one = jobs.add_parser("backup", help="copy a column")
    one.add_argument("table")
    one.add_argument("to")
    one.add_argument("--column", default="flag")
    one.add_argument("--label", default="backup")
    one.add_argument("--field", type=int, action="append", default=[])
    one.add_argument("--ddid", type=int, action="append", default=[])
    one = jobs.add_parser("restore", help="write a new version of a table with a copied column")
    one.add_argument("table")
    one.add_argument("copy")
    one.add_argument("to")
    one.add_argument("--column", default="flag")
    one = jobs.add_parser("summary", help="show what a table holds")
    one.add_argument("table")
    one = jobs.add_parser("plot", help="draw stored gains")
    one.add_argument("gains")
    one.add_argument("term")
    one.add_argument("to")
    one.add_argument("--transform", default="amplitude", choices=["raw", "amplitude", "phase", "real", "imag"])
    one.add_argument("--axis", default="gain_time", choices=["gain_time", "gain_freq"])
    one.add_argument("--corr", type=int, default=0)
    one.add_argument("--mean-over", nargs="*", choices=tables.GAIN_AXES, help="axes to average over; all others if not given")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.job == "config":
        with open(args.path, "w") as f:
            f.write(config.blank(tuple(args.terms)))
        return 0
    spark = spark or SparkSession.builder.appName("sparkfringe").getOrCreate()
    if args.job == "calibrate":
        files = [o for o in args.options if "=" not in o]
        calibrate.run(spark, config.load(*files, arguments=[o for o in args.options if "=" in o])).log()
    elif args.job == "backup":
        vis = preprocess.select_partitions(tables.read_main(spark, args.table), args.field, args.ddid)
        tables.backup(vis, args.column, args.to, args.label)
    elif args.job == "restore":
        vis = tables.restore(tables.read_main(spark, args.table), spark.read.parquet(args.copy), args.column)
        tables.write_main(vis, args.to)
    elif args.job == "summary":
        vis = tables.read_main(spark, args.table)
        shown = stats.sub_table_summaries(tables.read_sub_tables(spark, args.table))
        for name, df in {**shown, "DIMENSIONS": stats.dimension_summary(vis), "FLAGS": stats.flag_summary(vis)}.items():
            print(name)
            df.show(200, truncate=False)
    else:
        over = tables.GAIN_AXES if args.mean_over is None else args.mean_over
        data = tables.plot_data(tables.read_gains(spark, args.gains, args.term), args.transform, args.corr, args.axis, ("ant", "dir"), [x for x in over if x not in ("ant", "dir", args.axis)])
        tables.write_plots(data, args.to, ["ant", "dir"], args.axis)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
