"""Streaming queries over the log: continuous statements, and statistics kept in state."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.text import extra_info, out_file
from ..operators import render
from ..operators.maps import with_schema
from ..options import Options
from ..plans.modes import style, tables
from ..sources import sinks
from ..sources.binlog import register
from ..sources.catalog import frame_of
from ..sources.files import list_logs
from .relay import Transport, follow, where_to_start


def live(spark: SparkSession, o: Options, view: str = "changes", **more: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("binlog").options(**(o.reader() | {"view": view} | more)).load()


def live_statements(spark: SparkSession, o: Options, **more: str) -> DataFrame:
    known = tables(o)
    out = render.statements(with_schema(live(spark, o, **more).where("kind = 'rows'"), frame_of(spark, known), len(known)), style(o))
    out = out.withColumn("row_no", F.coalesce("row_no", F.lit(0)))
    return out.withColumnRenamed("trx", "trx_id").withColumn("file", out_file("to_sql", o.file_per_table)).withColumn("info", extra_info(o.offset))


def start(spark: SparkSession, o: Options, checkpoint: str, available_now: bool = False, resume_file: str | None = None, **more: str) -> StreamingQuery:
    """Appends each micro-batch to the SQL files of its logs, which are to the byte what one run over the whole log writes.

    Offsets lie between transactions, so no batch splits one. ``resume_file`` (by default beside Spark's checkpoint) is the
    checkpoint of the output: the last whole batch, its place in the log, the files and their lengths. A batch that is run
    again first cuts off what it had written. ``StreamingQuery.stop`` ends it between batches.
    """
    appender = sinks.Appender(o.output_dir, resume_file or f"{checkpoint.rstrip('/')}-output.json", o.add_extra_info) if o.output_dir else None
    if appender:
        os.makedirs(os.path.dirname(appender.checkpoint) or ".", exist_ok=True)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("sql is not null")
        if appender is None:
            sinks.write_sql(rows, None, info=o.add_extra_info)
        else:
            appender.append(rows, number)

    writer = live_statements(spark, o, **more).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replicate(spark: SparkSession, o: Options, transport: Transport, folder: str, available_now: bool = False, **more: str) -> str:
    """Follows a server: its frames become relay logs under ``folder``, and the SQL files follow these. How the server's stream ended.

    With a resume file the server is asked from the place of the output's checkpoint on, unless the relay logs already reach
    beyond it; then from their end on. Without one: from a time, a place, or now (see :func:`relay.where_to_start`).
    """
    logs, known = f"{folder}/relay", f"{folder}/checkpoint"
    os.makedirs(logs, exist_ok=True)
    resume_file = o.resume_file or f"{folder}/output.json"
    resume = sinks.Appender(o.output_dir, resume_file).last() if o.output_dir else None
    first = where_to_start(transport, resume, o) if not list_logs(logs, None) else ("", 4)
    own = replace(o, binlog_dir=logs, resume_file=None)
    run = lambda now: start(spark, own, known, now, resume_file, **more)
    if available_now:
        how = follow(transport, logs, first)
        run(True).awaitTermination()
        return how
    query, ended = None, []

    def relay() -> None:
        try:
            ended.append(follow(transport, logs, first, stop=lambda: bool(ended)))
        except Exception as e:  # noqa: BLE001 (told to the caller below)
            ended.append(e)

    thread = threading.Thread(target=relay, daemon=True)
    thread.start()
    try:
        while not ended and not list_logs(logs, None):
            time.sleep(0.05)
        query = run(False)
        while not ended and query.isActive:
            thread.join(0.2)
        if query.isActive:
            query.processAllAvailable()
    finally:
        ended.append("stopped")
        if query is not None:
            query.stop()
    if isinstance(ended[0], Exception):
        raise ended[0]
    return ended[0]


class Windows(StatefulProcessor):
    """Reporting windows of each binlog over an endless feed: a window's rows are emitted when an event closes it.

    State is the clock and the open window's tables; events of a group come in order of seq within each batch, and
    batches come in order of the log.
    """

    OUTPUT = "binlog string, start_ts long, stop_ts long, start_pos long, stop_pos long, inserts long, updates long, deletes long, db string, tb string"

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle) -> None:  # noqa: ANN001
        self.clock = handle.getValueState("clock", "at long")
        self.open = handle.getMapState("open", "db string, tb string", "ord long, start_ts long, stop_ts long, start_pos long, stop_pos long, inserts long, updates long, deletes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        events = pd.concat(list(rows)).sort_values("seq")
        clock = self.clock.get()[0] if self.clock.exists() else None
        tables = {k: list(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        out = []
        for e in events.itertuples():
            if clock is None:
                clock = e.ts + self.interval
            if e.kind == "row":
                t = tables.setdefault((e.db, e.tb), [len(tables), e.ts, e.ts, e.start_pos, e.end_pos, 0, 0, 0])
                t[2], t[4] = e.ts, e.end_pos
                t[5 + ("insert", "update", "delete").index(e.op)] += int(e.rows)
            if e.ts >= clock:
                out += [(key[0], *t[1:], *k) for k, t in sorted(tables.items(), key=lambda x: x[1][0])]
                tables, clock = {}, e.ts + self.interval
        self.clock.update((int(clock),))
        self.open.clear()
        for k, t in tables.items():
            self.open.updateValue(k, tuple(int(x) for x in t))
        yield pd.DataFrame(out, columns=["binlog", "start_ts", "stop_ts", "start_pos", "stop_pos", "inserts", "updates", "deletes", "db", "tb"])

    def close(self) -> None:
        pass


def live_windows(feed: DataFrame, interval: int) -> DataFrame:
    """Closed windows of a streaming feed with the columns of :mod:`operators.stats`."""
    return feed.groupBy("binlog").transformWithStateInPandas(Windows(interval), Windows.OUTPUT, "Append", "None")


def commit_watermark(feed: DataFrame, done: DataFrame) -> DataFrame:
    """The last commit before which every event's seq is in ``done``: (seq, end_pos, ts), no row if there is none.

    The least seq not done bounds it.
    """
    bound = feed.join(done, "seq", "left_anti").agg(F.min("seq")).first()[0]
    commits = feed.where("kind in ('commit', 'rollback')")
    if bound is not None:
        commits = commits.where(F.col("seq") < bound)
    return commits.agg(F.max_by(F.struct("seq", "end_pos", "ts"), "seq").alias("m")).where("m is not null").select("m.*")
