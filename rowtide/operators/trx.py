"""Transactions of an ordered feed: status of each event, running numbers, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import keyword


def status(kind: str = "kind", sql: str = "sql") -> Column:
    """begin, commit, rollback or process; another statement is a transaction of its own and commits."""
    word = keyword(F.col(sql))
    query = F.when(word == "begin", "begin").when(word.isin("commit", "rollback"), word).when(F.coalesce(word, F.lit("")) == "", "process").otherwise("commit")
    return F.when(F.col(kind) == "query", query).when(F.col(kind) == "xid", "commit").otherwise("process")


def begins(kind: str = "kind", sql: str = "sql") -> Column:
    """1 where the transaction number goes up: BEGIN, and any other statement but COMMIT and ROLLBACK."""
    word = F.coalesce(keyword(F.col(sql)), F.lit(""))
    return F.when((F.col(kind) == "query") & ~word.isin("", "commit", "rollback"), 1).otherwise(0)


def running(feed: DataFrame, step: Column, name: str, part: str = "file_ord", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``name``: the running sum of ``step`` over the whole feed, part after part.

    A sum within each part, and a table of the parts' totals (one row a part) for what came before: no task sees the
    whole feed in order.
    """
    feed = feed.withColumn("_step", step)
    totals = feed.groupBy(part).agg(F.sum("_step").alias("_n"))
    earlier = totals.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(part, "_before")
    own = F.sum("_step").over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return feed.withColumn("_own", own).join(earlier, part).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_step", "_own", "_before")


def number(feed: DataFrame, part: str = "file_ord", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Adds trx_id and status."""
    return running(feed, begins(), "trx_id", part, order).withColumn("status", status())


def segments(feed: DataFrame, part: str = "file_ord", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``segment``: number of the contiguous run of one binlog name, over the whole feed.

    Counted within each part; a part's first row is compared with the last row of the part before, in a table of one row a part.
    """
    within, parts, place = W.partitionBy(part).orderBy(*order), W.orderBy(part), F.struct(*order)
    same = (F.row_number().over(within) == 1) | F.lag("binlog").over(within).eqNullSafe(F.col("binlog"))
    totals = feed.withColumn("_step", F.when(same, 0).otherwise(1)).groupBy(part).agg(F.sum("_step").alias("_n"), F.min_by("binlog", place).alias("_first"), F.max_by("binlog", place).alias("_last"))
    goes_on = (F.row_number().over(parts) > 1) & F.lag("_last").over(parts).eqNullSafe(F.col("_first"))
    totals = totals.withColumn("_start", F.when(goes_on, 0).otherwise(1))
    before = F.coalesce(F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.sum("_start").over(parts.rowsBetween(W.unboundedPreceding, 0))
    earlier = totals.select(part, before.alias("_before"))
    own = F.sum("_step").over(within.rowsBetween(W.unboundedPreceding, 0))
    out = feed.withColumn("_step", F.when(same, 0).otherwise(1)).withColumn("_own", own).join(earlier, part)
    return out.withColumn("segment", (F.col("_own") + F.col("_before")).cast("long")).drop("_step", "_own", "_before")
