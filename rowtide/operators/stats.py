"""Statistics of a feed: rows changed by reporting window and table, and big or long transactions.

A feed has seq (a total order), segment (contiguous binlog), binlog, kind (row, begin, commit, rollback, tick), ts,
start_pos, end_pos, db, tb, op, rows. Begin marks carry their start as start_pos, ends their end as end_pos.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import big_long_line, moment, status_line


def closing(ts: np.ndarray, interval: int) -> np.ndarray:
    """Number of the reporting window of each event of a segment.

    The first event sets the clock to its time plus the interval; the first event at or past the clock still belongs
    to the window, closes it and sets the clock anew by its own time.
    """
    out, at, n, window = np.zeros(len(ts), dtype=np.int64), 0, len(ts), 0
    clock = int(ts[0]) + interval if n else 0
    step = 4096
    while at < n:
        end = n
        for s in range(at, n, step):
            late = np.flatnonzero(ts[s : s + step] >= clock)
            if len(late):
                end = s + int(late[0]) + 1
                break
        out[at:end] = window
        if end < n or (n and ts[end - 1] >= clock):
            clock, window = int(ts[end - 1]) + interval, window + 1
        at = end
    return out


def report_windows(feed: DataFrame, interval: int) -> DataFrame:
    """(seq, win) of each event. The chain of windows depends on the data, so a segment (at most a log file) is one group; only its order and times are moved."""

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf[["segment", "seq"]].assign(win=closing(pdf["ts"].to_numpy(), interval))

    return feed.select("segment", "seq", "ts").groupBy("segment").applyInPandas(chain, "segment long, seq long, win long")


def window_counts(feed: DataFrame, interval: int) -> DataFrame:
    """A row for each window and table: (segment, win, ord, binlog, start_ts, stop_ts, start_pos, stop_pos, inserts, updates, deletes, db, tb); ord puts tables in order of appearance."""
    rows = feed.where("kind = 'row'").join(report_windows(feed, interval), ["segment", "seq"])
    count = lambda op: F.sum(F.when(F.col("op") == op, F.col("rows")).otherwise(0)).cast("long").alias(op + "s")
    return rows.groupBy("segment", "win", "binlog", "db", "tb").agg(
        F.min("seq").alias("ord"), F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("stop_ts"),
        F.min_by("start_pos", "seq").alias("start_pos"), F.max_by("end_pos", "seq").alias("stop_pos"), count("insert"), count("update"), count("delete"),
    )


def runs(feed: DataFrame) -> DataFrame:
    """Adds run: how many BEGINs there are up to each event, if the feed doesn't have it."""
    if "run" in feed.columns:
        return feed
    from .trx import running

    return running(feed, F.when(F.col("kind") == "begin", 1).otherwise(0), "run", "segment", ("seq",))


def accumulated(feed: DataFrame) -> DataFrame:
    """Rows so far in the run, the time of its first row and where it began, at each event."""
    w = W.partitionBy("run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    row = F.col("kind") == "row"
    first = lambda c: F.first(c, ignorenulls=True).over(w)
    starts = F.col("kind").isin("begin", "row")
    return feed.withColumn("cum", F.coalesce(F.sum(F.when(row, F.col("rows"))).over(w), F.lit(0)).cast("long")).withColumn("first_ts", first(F.when(row, F.col("ts")))).withColumn("run_binlog", first(F.when(starts, F.col("binlog")))).withColumn("run_pos", first(F.when(starts, F.col("start_pos"))))


def big_long(feed: DataFrame, big: int, long: int) -> DataFrame:
    """A row for each commit or rollback of a run with rows that has ``big`` rows or lasted ``long`` seconds: (seq, run, binlog, start_ts, stop_ts, start_pos, stop_pos, rows, duration)."""
    marks = accumulated(runs(feed)).where("kind in ('commit', 'rollback') and first_ts is not null")
    marks = marks.withColumn("duration", F.greatest(F.col("ts") - F.col("first_ts"), F.lit(0)).cast("long"))
    hits = marks.where((F.col("cum") >= big) | (F.col("duration") >= long))
    return hits.select("seq", "run", F.col("run_binlog").alias("binlog"), F.col("first_ts").alias("start_ts"), F.col("ts").alias("stop_ts"), F.col("run_pos").alias("start_pos"), F.col("end_pos").alias("stop_pos"), F.col("cum").alias("rows"), "duration")


def details(feed: DataFrame, hits: DataFrame) -> DataFrame:
    """(seq, table, inserts, updates, deletes): what each hit's run had changed by then, by ``db.tb``."""
    rows = runs(feed).where("kind = 'row'").select("run", F.col("seq").alias("at"), F.concat_ws(".", "db", "tb").alias("table"), "op", "rows")
    count = lambda op: F.sum(F.when(F.col("op") == op, F.col("rows")).otherwise(0)).cast("long").alias(op + "s")
    # a row belongs to the next hit of its run: it is summed once, and the sums between hits are added up along them
    after = W.partitionBy("run").orderBy(F.desc("place"), F.desc("hit")).rowsBetween(W.unboundedPreceding, 0)
    marks = hits.select("run", F.col("seq").alias("place"), F.lit(1).alias("hit"), F.col("seq").alias("mark"))
    both = rows.withColumnRenamed("at", "place").withColumn("hit", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("seq", F.last("mark", ignorenulls=True).over(after)).where("hit = 0 and seq is not null")
    between = both.groupBy("run", "seq", "table").agg(count("insert"), count("update"), count("delete"))
    # tables of a run appear from their first hit on: a row for each of its hits from there, by the hits' own small windows
    upto = W.partitionBy("run", "table").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    n_hits = hits.groupBy("run").agg(F.array_sort(F.collect_list("seq")).alias("all")).where(F.size("all") > 1)
    single = between.join(n_hits.select("run"), "run", "left_anti")
    many = between.join(n_hits, "run")
    filled = many.groupBy("run", "table", "all").agg(F.min("seq").alias("first")).select("run", "table", F.explode(F.filter("all", lambda s: s >= F.col("first"))).alias("seq"))
    filled = filled.join(many.drop("all"), ["run", "table", "seq"], "left")
    total = lambda op: F.sum(F.coalesce(F.col(op + "s"), F.lit(0))).over(upto).cast("long").alias(op + "s")
    filled = filled.select("seq", "table", total("insert"), total("update"), total("delete"))
    return single.select("seq", "table", "inserts", "updates", "deletes").unionByName(filled)


def report_lines(counts: DataFrame, offset: int = 0) -> DataFrame:
    """(segment, ord, win, line) of the window report."""
    t = counts.withColumn("start_time", moment(F.col("start_ts"), offset)).withColumn("stop_time", moment(F.col("stop_ts"), offset)).withColumnRenamed("stop_pos", "stop_pos")
    return t.select("segment", "win", "ord", status_line().alias("line"), F.to_json(F.struct("binlog", F.col("start_time").alias("starttime"), F.col("stop_time").alias("stoptime"), F.col("start_pos").alias("startpos"), F.col("stop_pos").alias("stoppos"), "inserts", "updates", "deletes", F.col("db").alias("database"), F.col("tb").alias("table"))).alias("json"))


def big_long_lines(hits: DataFrame, tables: DataFrame, offset: int = 0) -> DataFrame:
    """(seq, line, json) of the report of big and long transactions."""
    one = F.format_string("%s(inserts=%d, updates=%d, deletes=%d)", "table", "inserts", "updates", "deletes")
    joined = tables.groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", one.alias("text")))), lambda x: x["text"]), " ").alias("tables"), F.array_sort(F.collect_list(F.struct("table", "inserts", "updates", "deletes"))).alias("list"))
    t = hits.join(joined, "seq").withColumn("start_time", moment(F.col("start_ts"), offset)).withColumn("stop_time", moment(F.col("stop_ts"), offset))
    return t.select("seq", big_long_line().alias("line"), F.to_json(F.struct("binlog", F.col("start_time").alias("starttime"), F.col("stop_time").alias("stoptime"), F.col("start_pos").alias("startpos"), F.col("stop_pos").alias("stoppos"), "rows", "duration", F.col("list").alias("tables"))).alias("json"))


def summary(rendered: DataFrame) -> DataFrame:
    """(events, statements, errors) of a run."""
    done = F.col("error").isNull() & F.col("sql").isNotNull()
    return rendered.agg(F.count_distinct(F.when(F.col("error").isNull(), F.struct("file_ord", "pos"))).alias("events"), F.count(F.when(done, 1)).alias("statements"), F.count_distinct(F.when(F.col("error").isNotNull(), F.struct("file_ord", "pos"))).alias("errors"))
