"""A change feed made of the orders table, for queries without a log at hand: the same rule in Spark and in plain SQL.

Keys are contiguous from 0. File 1 + key div 4000, 100 bytes an event, three events a second, seven a transaction
(every 11th rolled back, every 50th followed by a statement that isn't DML). By key mod 10: 0-5 insert, 6-8 update,
9 delete. An update adds 1.00 to the price, passes the status on and sets the priority NULL where key mod 4 is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
BASE = 1_700_000_000


def cell(tag: str, text: Column) -> Column:
    some = F.struct(F.lit(tag).alias("tag"), text.alias("txt"), F.lit(None).cast("binary").alias("bin"))
    return F.when(text.isNull(), F.struct(F.lit("null").alias("tag"), F.lit(None).cast("string").alias("txt"), F.lit(None).cast("binary").alias("bin"))).otherwise(some)


def orders_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows events: seq, file_ord, binlog, start_pos, end_pos, pos, ts, run, trx_id, kind, op, db, tb, n_log, before, after, row_no."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(15,2)")
    after_status = F.when(F.col("o_orderstatus") == "F", "O").when(F.col("o_orderstatus") == "O", "P").otherwise("F")
    op = F.when(k % 10 < 6, "insert").when(k % 10 < 9, "update").otherwise("delete")
    old = F.array(cell("int", k.cast("string")), cell("str", F.col("o_orderstatus")), cell("decimal", price.cast("string")), cell("str", F.col("o_orderpriority")))
    new = F.array(cell("int", k.cast("string")), cell("str", after_status), cell("decimal", (price + F.lit(1).cast("decimal(3,2)")).cast("decimal(16,2)").cast("string")), cell("str", F.when(k % 4 != 0, F.col("o_orderpriority"))))
    file = (F.floor(k / 4000) + 1).cast("int")
    return o.select(
        k.alias("seq"), file.alias("file_ord"), F.format_string("mysql-bin.%06d", file).alias("binlog"), (120 + k % 4000 * 100).alias("start_pos"), (220 + k % 4000 * 100).alias("end_pos"), (120 + k % 4000 * 100).alias("pos"),
        (F.floor(k / 3) + BASE).alias("ts"), F.floor(k / 7).alias("run"), (F.floor(k / 7) + 1).alias("trx_id"), F.lit("rows").alias("kind"), op.alias("op"), F.lit("shop").alias("db"), F.when(k % 5 == 0, "orders_b").otherwise("orders").alias("tb"), F.lit(4).alias("n_log"),
        F.when(op == "insert", None).otherwise(old).alias("before"), F.when(op == "insert", old).when(op == "update", new).alias("after"), F.lit(0).alias("row_no"),
    )


def with_names(feed: DataFrame, pk: tuple[int, ...] = (0,), uks: tuple[tuple[int, ...], ...] = ()) -> DataFrame:
    ints = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<int>")
    return feed.withColumn("names", F.array(*(F.lit(n) for n in NAMES))).withColumn("pk", ints(pk)).withColumn("uks", F.array(*(ints(u) for u in uks)).cast("array<array<int>>"))


def stats_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with its marks, as :mod:`operators.stats` takes it: seq is 10 * key, marks lie around it."""
    rows = orders_feed(spark, sf_dir)
    k = F.col("seq")
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).first()[0]
    row = rows.select((k * 10).alias("seq"), F.col("file_ord").cast("long").alias("segment"), "binlog", F.lit("row").alias("kind"), "ts", "start_pos", "end_pos", "db", "tb", "op", F.lit(1).cast("long").alias("rows"), (F.col("run") + 1).alias("run"))

    def marks(where: Column, shift: int, kind: Column, at: str) -> DataFrame:
        base = rows.where(where)
        place = F.col(at)
        return base.select((k * 10 + shift).alias("seq"), F.col("file_ord").cast("long").alias("segment"), "binlog", kind.alias("kind"), "ts", place.alias("start_pos"), place.alias("end_pos"), F.lit(None).cast("string").alias("db"), F.lit(None).cast("string").alias("tb"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("rows"), (F.col("run") + 1).alias("run"))

    final = (k % 7 == 6) | (k == last)
    begin = marks(k % 7 == 0, -1, F.lit("begin"), "start_pos")
    end = marks(final, 1, F.when(F.col("run") % 11 == 0, "rollback").otherwise("commit"), "end_pos")
    other = marks(final & (F.col("run") % 50 == 0), 2, F.lit("tick"), "end_pos")
    return row.unionByName(begin).unionByName(end).unionByName(other)


#: The feed as SQL that DuckDB runs; cells are their SQL literals' parts: tag and text in two lists.
FEED_SQL = """feed AS (
  SELECT o_orderkey AS seq, CAST(1 + o_orderkey // 4000 AS INTEGER) AS file_ord, format('mysql-bin.{:06d}', 1 + o_orderkey // 4000) AS binlog,
    120 + (o_orderkey % 4000) * 100 AS start_pos, 220 + (o_orderkey % 4000) * 100 AS end_pos, 1700000000 + o_orderkey // 3 AS ts,
    o_orderkey // 7 AS run, o_orderkey // 7 + 1 AS trx_id,
    CASE WHEN o_orderkey % 10 < 6 THEN 'insert' WHEN o_orderkey % 10 < 9 THEN 'update' ELSE 'delete' END AS op,
    'shop' AS db, CASE WHEN o_orderkey % 5 = 0 THEN 'orders_b' ELSE 'orders' END AS tb,
    CAST(o_orderkey AS VARCHAR) AS c0, o_orderstatus AS b1, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS b2, o_orderpriority AS b3,
    CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END AS a1,
    CAST(CAST(o_totalprice AS DECIMAL(15,2)) + CAST(1 AS DECIMAL(3,2)) AS VARCHAR) AS a2,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS a3
  FROM orders)"""
STATS_SQL = f"""{FEED_SQL},
ev AS (
  SELECT seq * 10 AS seq, CAST(file_ord AS BIGINT) AS segment, binlog, 'row' AS kind, ts, start_pos, end_pos, db, tb, op, 1 AS rows, run + 1 AS run FROM feed
  UNION ALL SELECT seq * 10 - 1, file_ord, binlog, 'begin', ts, start_pos, start_pos, NULL, NULL, NULL, NULL, run + 1 FROM feed WHERE seq % 7 = 0
  UNION ALL SELECT seq * 10 + 1, file_ord, binlog, CASE WHEN run % 11 = 0 THEN 'rollback' ELSE 'commit' END, ts, end_pos, end_pos, NULL, NULL, NULL, NULL, run + 1
    FROM feed WHERE seq % 7 = 6 OR seq = (SELECT max(o_orderkey) FROM orders)
  UNION ALL SELECT seq * 10 + 2, file_ord, binlog, 'tick', ts, end_pos, end_pos, NULL, NULL, NULL, NULL, run + 1
    FROM feed WHERE (seq % 7 = 6 OR seq = (SELECT max(o_orderkey) FROM orders)) AND run % 50 = 0)"""
