"""Command line: to-sql, flashback, stats, repl."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from .options import OptionError, Options

COMMON = "binlog_dir start_file start_pos stop_file stop_pos start_datetime stop_datetime db table ignore_db ignore_table dml uri schema_file output_dir time_zone threads split_bytes max_event_bytes strict_parity"
SQL = "file_per_table add_extra_info no_db_prefix full_columns unique_key_first ignore_primary_key_for_insert strict_schema insert_batch"
#: Options of each mode.
MODES = {
    "to-sql": f"{COMMON} {SQL} schema_dump to_stdout on_error",
    "flashback": f"{COMMON} {SQL} schema_dump on_error keep_trx report_file dry_run",
    "stats": f"{COMMON} schema_dump print_interval big_trx_rows long_trx_seconds stats_json",
    "repl": f"{COMMON} {SQL} to_stdout server_id resume_file heartbeat_secs",
}


def parser() -> argparse.ArgumentParser:
    kinds = {f.name: f for f in dataclasses.fields(Options)}
    top = argparse.ArgumentParser(prog="rowtide", description="Change-log analytics on Spark")
    sub = top.add_subparsers(dest="work", required=True)
    for mode, names in MODES.items():
        p = sub.add_parser(mode)
        for name in names.split():
            flag, default = "--" + name.replace("_", "-"), kinds[name].default
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true", default=default)
            else:
                whole = isinstance(default, int) or name in ("stop_pos", "server_id")
                p.add_argument(flag, type=int if whole else str, default=default if default != () else "")
        if mode == "flashback":
            p.add_argument("--no-keep-trx", action="store_true")
    return top


def options(argv: list[str]) -> Options:
    args = vars(parser().parse_args(argv))
    if args.pop("no_keep_trx", False):
        if "--keep-trx" in argv:
            raise OptionError("--keep-trx and --no-keep-trx exclude each other")
        args["keep_trx"] = False
    return Options(**args)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: the run failed; 2: the options can't be carried out; 130: interrupted."""
    try:
        o = options(sys.argv[1:] if argv is None else argv)
    except OptionError as e:
        print(f"rowtide: {e}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rowtide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if o.work == "repl":
            from .sources.files import shared_folder
            from .streaming.jobs import start

            start(spark, o, f"{o.output_dir}/.checkpoint" if o.output_dir else shared_folder(spark, "repl"), resume_file=o.resume_file).awaitTermination()
        else:
            from .plans.modes import run_sql, run_stats

            print(run_stats(spark, o) if o.work == "stats" else run_sql(spark, o))
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"rowtide: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
