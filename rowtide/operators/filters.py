"""Windows and lists over a change feed (binlog, pos, end_pos, ts, kind, op, db, tb)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_base, name_number


def before(name: Column, pos: Column, limit: tuple[str, int]) -> Column:
    """(name, pos) < limit, names by base and number."""
    base, number = F.lit(limit[0]), F.lit(limit[0])
    a, n = name_base(name), name_number(name)
    b, m = name_base(base), name_number(number)
    return (a < b) | ((a == b) & ((n < m) | ((n == m) & (pos < F.lit(limit[1])))))


def from_start(feed: DataFrame, start: tuple[str, int] | None = None, start_ts: int | None = None) -> DataFrame:
    """A filter of single events: those whose end lies before the start, or whose time does, are left out."""
    if start is not None:
        feed = feed.where(~before(F.col("binlog"), F.col("end_pos"), start))
    return feed if start_ts is None else feed.where(F.col("ts") >= start_ts)


def until_stop(feed: DataFrame, stop: tuple[str, int] | None = None, stop_ts: int | None = None) -> DataFrame:
    """Take-while in each file: the first event at or past the stop ends it, whatever comes behind.

    The first such place of each file is one aggregate; no file is sorted and no window is formed.
    """
    hit = reduce(lambda a, b: a | b, [c for c in (~before(F.col("binlog"), F.col("end_pos"), stop) if stop else None, F.col("ts") >= stop_ts if stop_ts is not None else None) if c is not None], F.lit(False))
    ends = feed.where(hit).groupBy("binlog").agg(F.min("end_pos").alias("stop_at"))
    return feed.join(ends, "binlog", "left").where(F.col("stop_at").isNull() | (F.col("end_pos") < F.col("stop_at"))).drop("stop_at")


def named(entries: tuple[str, ...]) -> Column:
    """``db.table`` exactly (split at the first point), or a table of any database."""
    def one(e: str) -> Column:
        d, dot, t = e.partition(".")
        return (F.col("db") == d) & (F.col("tb") == t) if dot else F.col("tb") == e

    return reduce(lambda a, b: a | b, map(one, entries))


def listed(db: tuple[str, ...] = (), table: tuple[str, ...] = (), ignore_db: tuple[str, ...] = (), ignore_table: tuple[str, ...] = (), dml: tuple[str, ...] = ()) -> Column:
    """What the lists let through: denials win, names are exact."""
    out = F.lit(True)
    if db:
        out &= F.col("db").isin(*db)
    if table:
        out &= named(table)
    if ignore_db:
        out &= ~F.col("db").isin(*ignore_db)
    if ignore_table:
        out &= ~named(ignore_table)
    return out & F.col("op").isin(*dml) if dml else out


def accept(feed: DataFrame, **lists: tuple[str, ...]) -> DataFrame:
    """Lists hold for rows events alone, so that marks of transactions stay."""
    return feed.where((F.col("kind") != "rows") | listed(**lists))
