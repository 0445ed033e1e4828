"""Headline queries on one machine: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each query's result is counted in full, without
going through Python; log decoding and statements from a log are measured in MiB of log a second as well.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from pathlib import Path


#: The orders log is copied under following names until about so much is there.
LOG_MIB = 128


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    home = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{home}/shared").config("spark.sql.warehouse.dir", f"{home}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from rowtide.operators import render, stats
    from rowtide.options import Options
    from rowtide.plans import modes
    from rowtide.plans.feed import orders_feed, stats_feed, with_names
    from rowtide.plans.queries import orders_log

    took: dict[str, float] = {}

    def timed(name: str, df) -> None:  # noqa: ANN001
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)

    folder = Path(home)
    (folder / "logs").mkdir()
    catalog = orders_log(spark, sf, str(folder / "logs"))
    (folder / "schema.json").write_text(json.dumps(catalog))
    one = folder / "logs" / "mysql-bin.000001"
    copies = max(1, min(256, round(LOG_MIB * 2**20 / one.stat().st_size)))
    for k in range(2, copies + 1):
        shutil.copy(one, folder / "logs" / f"mysql-bin.{k:06d}")
    size = copies * one.stat().st_size / 2**20
    o = Options(binlog_dir=str(folder / "logs"), start_file="mysql-bin.000001", stop_file=f"mysql-bin.{copies:06d}", schema_file=str(folder / "schema.json"), split_bytes=4 << 20)
    feed = with_names(orders_feed(spark, sf))
    timed("warm_up", render.statements(feed, render.Style()))
    took.pop("warm_up")
    timed("log_decode", modes.changes(spark, o))
    timed("log_to_sql", modes.rendered(spark, o))
    timed("forward_statements", render.statements(feed, render.Style()))
    timed("undo_statements", render.statements(feed, render.Style(undo=True)).orderBy(F.desc("seq")))
    events = stats_feed(spark, sf)
    timed("window_statistics", stats.window_counts(events, 30))
    timed("big_long_transactions", stats.big_long(events, 7, 3))
    try:
        from rowtide.llm import queries as training

        for name, run in training.queries().items():
            if name in ("op1_simhash", "op8_warc_archive"):
                began = time.time()
                run(spark, sf).write.format("noop").mode("overwrite").save()
                took[name] = round(time.time() - began, 3)
    except ImportError:
        pass
    rates = {"log_mib": round(size, 3), "decode_mib_s": round(size / took["log_decode"], 2), "to_sql_mib_s": round(size / took["log_to_sql"], 2), "decode_mib_s_core": round(size / took["log_decode"] / int(cpus), 2), "to_sql_mib_s_core": round(size / took["log_to_sql"] / int(cpus), 2)}
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf"), "rates": rates}))
    spark.stop()
    shutil.rmtree(home, ignore_errors=True)


if __name__ == "__main__":
    main()
