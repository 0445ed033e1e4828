"""Every operator over the driver's tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters, maps, render, stats, trx
from ..options import Options
from ..sources import catalog
from ..sources.files import put, shared_folder
from ..sources.writer import INT, Log, datetime2, decimal, i4, s1, varchar
from ..streaming.jobs import commit_watermark
from . import modes
from .feed import FEED_SQL, STATS_SQL, orders_feed, stats_feed, with_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- texts in SQL ----


def q_sql(x: str) -> str:
    """The literal of a text, as DuckDB writes it."""
    pairs = [("'\\'", "'\\\\'"), ("'\\\\%'", "'\\%'"), ("'\\\\_'", "'\\_'"), ("''''", "'\\'''"), ("'\"'", "'\\\"'"), ("chr(8)", "'\\b'"), ("chr(9)", "'\\t'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(26)", "'\\Z'")]
    return "'''' || " + reduce(lambda s, p: f"replace({s}, {p[0]}, {p[1]})", pairs, x) + " || ''''"


def lit_sql(i: int, image: str) -> str:
    """The i-th column of an image: b (before), a (after) or o (the only image, with the before's values)."""
    c = "c0" if i == 0 else f"{'a' if image == 'a' else 'b'}{i}"
    return c if i in (0, 2) else f"CASE WHEN {c} IS NULL THEN 'NULL' ELSE {q_sql(c)} END"


NAMES = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
TARGET = "'`' || db || '`.`' || tb || '`'"


def insert_sql(cols: tuple[int, ...] = (0, 1, 2, 3)) -> str:
    names = ",".join(f"`{NAMES[i]}`" for i in cols)
    values = " || ',' || ".join(lit_sql(i, "o") for i in cols)
    return f"'INSERT INTO ' || {TARGET} || ' ({names}) VALUES (' || {values} || ');'"


def where_sql(image: str, cols: tuple[int, ...] = (0,)) -> str:
    c = lambda i: "c0" if i == 0 else f"{'a' if image == 'a' else 'b'}{i}"
    return " || ' AND ' || ".join(f"CASE WHEN {c(i)} IS NULL THEN '`{NAMES[i]}` IS NULL' ELSE '`{NAMES[i]}`=' || {lit_sql(i, image)} END" for i in cols)


def delete_sql(cols: tuple[int, ...] = (0,)) -> str:
    return f"'DELETE FROM ' || {TARGET} || ' WHERE ' || {where_sql('o', cols)} || ';'"


def update_sql(undo: bool = False) -> str:
    wrote, found = ("b", "a") if undo else ("a", "b")
    sets = ", ".join(f"CASE WHEN a{i} IS DISTINCT FROM b{i} THEN '`{NAMES[i]}`=' || {lit_sql(i, wrote)} END" for i in (1, 2, 3))
    return f"'UPDATE ' || {TARGET} || ' SET ' || concat_ws(',', {sets}) || ' WHERE ' || {where_sql(found)} || ';'"


def statement_query(name: str, op: str, style: render.Style, sql: str) -> None:
    @query(f"WITH {FEED_SQL} SELECT seq, {sql} AS sql FROM feed WHERE op = '{op}'", name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return render.statements(with_names(orders_feed(spark, sf)).where(F.col("op") == op), style).select("seq", "sql")


statement_query("x24_insert", "insert", render.Style(), insert_sql())
statement_query("x24_update", "update", render.Style(), update_sql())
statement_query("x24_delete", "delete", render.Style(), delete_sql())
statement_query("x25_undo_insert", "delete", render.Style(undo=True), insert_sql())
statement_query("x25_undo_update", "update", render.Style(undo=True), update_sql(undo=True))
statement_query("x25_undo_delete", "insert", render.Style(undo=True), delete_sql())
statement_query("p2_where_all_columns", "delete", render.Style(full_columns=True), delete_sql((0, 1, 2, 3)))
statement_query("p4_insert_without_pk", "insert", render.Style(ignore_pk=True), insert_sql((1, 2, 3)))


@query(f"WITH {FEED_SQL} SELECT seq, {delete_sql((1, 2))} AS sql FROM feed WHERE op = 'delete'")
def p2_where_key(spark: SparkSession, sf: str) -> DataFrame:
    """A unique key before the primary key."""
    return render.statements(with_names(orders_feed(spark, sf), uks=((1, 2),)).where("op = 'delete'"), render.Style(unique_first=True)).select("seq", "sql")


@query(f"WITH {FEED_SQL} SELECT seq, concat_ws(',', CASE WHEN a1 IS DISTINCT FROM b1 THEN '1' END, CASE WHEN a2 IS DISTINCT FROM b2 THEN '2' END, CASE WHEN a3 IS DISTINCT FROM b3 THEN '3' END) AS changed FROM feed WHERE op = 'update'")
def p3_changed_columns(spark: SparkSession, sf: str) -> DataFrame:
    feed = with_names(orders_feed(spark, sf)).where("op = 'update'")
    return feed.select("seq", F.array_join(render.set_ordinals(render.Style()).cast("array<string>"), ",").alias("changed"))


@query(f"WITH {FEED_SQL} SELECT seq, CASE WHEN seq % 2 = 0 THEN {update_sql()} END AS sql FROM feed WHERE op = 'update'")
def p5_noop_update_dropped(spark: SparkSession, sf: str) -> DataFrame:
    feed = with_names(orders_feed(spark, sf)).where("op = 'update'").withColumn("after", F.when(F.col("seq") % 2 == 0, F.col("after")).otherwise(F.col("before")))
    return render.statements(feed, render.Style()).select("seq", "sql")


@query(f"WITH {FEED_SQL} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'missing_column: the row image is not full' END AS error FROM feed WHERE op = 'delete'")
def p6_incomplete_image(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.struct(F.lit("missing").alias("tag"), F.lit(None).cast("string").alias("txt"), F.lit(None).cast("binary").alias("bin"))
    feed = with_names(orders_feed(spark, sf)).where("op = 'delete'")
    feed = feed.withColumn("before", F.transform("before", lambda c, i: F.when((i == 3) & (F.col("seq") % 3 == 0), gone).otherwise(c)))
    return render.statements(feed, render.Style(undo=True)).select("seq", "error")


@query(
    f"WITH {FEED_SQL}, g AS (SELECT seq // 4 AS ev, min(seq) AS seq, string_agg('(' || {' || \',\' || '.join(lit_sql(i, 'o') for i in range(4))} || ')', ',' ORDER BY seq) AS t, min(db) AS db, min(tb) AS tb FROM feed WHERE op = 'insert' GROUP BY seq // 4) "
    f"SELECT seq, 'INSERT INTO `shop`.`orders` ({','.join(f'`{n}`' for n in NAMES)}) VALUES ' || t || ';' AS sql FROM g"
)
def o4_insert_batch(spark: SparkSession, sf: str) -> DataFrame:
    feed = with_names(orders_feed(spark, sf)).where("op = 'insert'").withColumn("tb", F.lit("orders"))
    feed = feed.withColumn("event", F.floor(F.col("seq") / 4)).withColumn("row_no", (F.col("seq") % 4).cast("int"))
    return render.batched_inserts(feed, render.Style(insert_batch=4), event=("event",)).select("seq", "sql")


@query(f"WITH {FEED_SQL} SELECT file_ord, seq, CAST(row_number() OVER (PARTITION BY file_ord ORDER BY seq DESC) AS INTEGER) AS place FROM feed")
def o2_reverse_order(spark: SparkSession, sf: str) -> DataFrame:
    feed = orders_feed(spark, sf)
    return feed.select("file_ord", "seq", F.row_number().over(W.partitionBy("file_ord").orderBy(F.desc("seq"))).alias("place"))


@query(f"WITH {FEED_SQL} SELECT seq, lag(trx_id, 1, 0) OVER (PARTITION BY file_ord ORDER BY seq DESC) <> trx_id AS new_trx FROM feed")
def o3_scaffold(spark: SparkSession, sf: str) -> DataFrame:
    return render.undo_order(orders_feed(spark, sf), "file_ord").select("seq", "new_trx")


# ---- filters ----


def filter_query(name: str, where: str, run: Callable[[DataFrame], DataFrame]) -> None:
    @query(f"WITH {FEED_SQL} SELECT seq, ts, op, tb FROM feed WHERE {where}", name)
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return run(orders_feed(spark, sf)).select("seq", "ts", "op", "tb")


filter_query("f1_db_lists", "db IN ('shop', 'x') AND db NOT IN ('y')", lambda d: d.where(filters.listed(db=("shop", "x"), ignore_db=("y",))))
filter_query("f2_table_lists", "(tb = 'orders_b' OR (db = 'shop' AND tb = 'orders')) AND NOT (tb = 'orders_b')", lambda d: d.where(filters.listed(table=("orders_b", "shop.orders"), ignore_table=("orders_b",))))
filter_query("f3_dml", "op IN ('update', 'delete')", lambda d: d.where(filters.listed(dml=("update", "delete"))))
filter_query("f4_start_pos", "NOT (file_ord < 2 OR (file_ord = 2 AND end_pos < 5020))", lambda d: filters.from_start(d, ("mysql-bin.000002", 5020)))
filter_query("f5_stop_takewhile", "file_ord < 3 AND NOT (file_ord = 2 AND end_pos >= 100020)", lambda d: filters.until_stop(d, ("mysql-bin.000002", 100020)))
filter_query("f6_start_time", "ts >= 1700001000", lambda d: filters.from_start(d, start_ts=1_700_001_000))
filter_query("f7_stop_time_takewhile", "seq < (SELECT coalesce(min(o_orderkey), 9999999999) FROM orders o WHERE o.o_orderkey // 4000 = feed.seq // 4000 AND 1700000000 + o.o_orderkey // 3 + CASE WHEN o.o_orderkey % 1000 = 500 THEN 600 ELSE 0 END >= 1700001500)", lambda d: filters.until_stop(d.withColumn("late", F.col("ts")).withColumn("ts", F.col("ts") + F.when(F.col("seq") % 1000 == 500, 600).otherwise(0)), stop_ts=1_700_001_500).withColumn("ts", F.col("late")))


@query(f"WITH {STATS_SQL} SELECT seq, kind FROM ev WHERE kind <> 'row' OR (op = 'insert' AND tb <> 'orders_b')")
def f8_accept_keeps_marks(spark: SparkSession, sf: str) -> DataFrame:
    feed = stats_feed(spark, sf).withColumn("kind", F.when(F.col("kind") == "row", "rows").otherwise(F.col("kind")))
    return filters.accept(feed, dml=("insert",), ignore_table=("orders_b",)).select("seq", F.when(F.col("kind") == "rows", "row").otherwise(F.col("kind")).alias("kind"))


# ---- transactions, windows, statistics ----


@query(f"WITH {STATS_SQL} SELECT seq, CAST(sum(CASE WHEN kind = 'begin' OR kind = 'tick' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS trx_id, CASE kind WHEN 'begin' THEN 'begin' WHEN 'rollback' THEN 'rollback' WHEN 'row' THEN 'process' ELSE 'commit' END AS status FROM ev")
def w1_trx_number(spark: SparkSession, sf: str) -> DataFrame:
    feed = stats_feed(spark, sf)
    sql = F.when(F.col("kind") == "begin", " Begin; ").when(F.col("kind") == "tick", "ALTER TABLE t").when(F.col("kind") == "rollback", "rollback")
    kind = F.when(F.col("kind") == "row", "rows").when(F.col("kind") == "commit", "xid").otherwise("query")
    return trx.number(feed.withColumn("sql", sql).withColumn("kind", kind), "segment", ("seq",)).select("seq", "trx_id", "status")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'begin' WHEN event_type = 'error' THEN 'rollback' WHEN event_type = 'purchase' THEN 'commit' WHEN event_type = 'signup' THEN 'commit' ELSE 'process' END AS status FROM events")
def w2_trx_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "xid").when(F.col("event_type") == "view", "rows").otherwise("query")
    sql = F.when(F.col("event_type") == "click", "begin").when(F.col("event_type") == "error", "ROLLBACK;").otherwise("create table t (a int)")
    return read(spark, sf, "events").select("event_id", kind.alias("kind"), sql.alias("sql")).select("event_id", trx.status().alias("status"))


@query(f"WITH {STATS_SQL} SELECT run, CAST(count(*) AS BIGINT) AS marks FROM ev GROUP BY run")
def w3_runs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.runs(stats_feed(spark, sf).drop("run")).groupBy("run").agg(F.count("*").alias("marks"))


@query(f"WITH {STATS_SQL} SELECT seq, first_value(CASE WHEN kind = 'row' THEN ts END IGNORE NULLS) OVER w AS first_ts, CAST(coalesce(sum(rows) OVER w, 0) AS BIGINT) AS cum FROM ev WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)", "a3_trx_accumulators")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return stats.accumulated(stats_feed(spark, sf)).select("seq", "first_ts", "cum")


#: The chain of reporting windows of each segment: a window ends with the first event at or past its clock.
CHAIN_SQL = f"""WITH RECURSIVE {STATS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY seq) AS i FROM ev),
late AS (SELECT a.segment, a.i, (SELECT min(b.i) FROM n b WHERE b.segment = a.segment AND b.i > a.i AND b.ts >= a.ts + 30) AS nxt FROM n a),
ends(segment, i, win) AS (
  SELECT segment, nxt, 0 FROM late WHERE i = 1
  UNION ALL SELECT e.segment, l.nxt, e.win + 1 FROM ends e JOIN late l ON l.segment = e.segment AND l.i = e.i WHERE e.i IS NOT NULL),
w AS (SELECT n.*, (SELECT CAST(count(*) AS BIGINT) FROM ends e WHERE e.segment = n.segment AND e.i < n.i) AS win FROM n)"""


@query(f"{CHAIN_SQL} SELECT seq, win FROM w")
def w5_report_windows(spark: SparkSession, sf: str) -> DataFrame:
    return stats.report_windows(stats_feed(spark, sf), 30).select("seq", "win")


@query(
    f"{CHAIN_SQL} SELECT segment, win, binlog, db, tb, min(seq) AS ord, arg_min(ts, seq) AS start_ts, arg_max(ts, seq) AS stop_ts, arg_min(start_pos, seq) AS start_pos, arg_max(end_pos, seq) AS stop_pos, "
    "CAST(sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS inserts, CAST(sum(CASE WHEN op = 'update' THEN 1 ELSE 0 END) AS BIGINT) AS updates, CAST(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) AS BIGINT) AS deletes "
    "FROM w WHERE kind = 'row' GROUP BY segment, win, binlog, db, tb"
)
def a1_window_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.window_counts(stats_feed(spark, sf), 30).select("segment", "win", "binlog", "db", "tb", "ord", "start_ts", "stop_ts", "start_pos", "stop_pos", "inserts", "updates", "deletes")


HITS_SQL = f"""WITH {STATS_SQL},
c AS (SELECT *, sum(rows) OVER w AS cum, first_value(CASE WHEN kind = 'row' THEN ts END IGNORE NULLS) OVER w AS fts,
  first_value(binlog) OVER w AS rb, first_value(start_pos) OVER w AS rp FROM ev WINDOW w AS (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING)),
hits AS (SELECT seq, run, rb AS binlog, fts AS start_ts, ts AS stop_ts, rp AS start_pos, end_pos AS stop_pos, CAST(cum AS BIGINT) AS rows, greatest(ts - fts, 0) AS duration
  FROM c WHERE kind IN ('commit', 'rollback') AND fts IS NOT NULL AND (cum >= 7 OR ts - fts >= 3))"""


@query(f"{HITS_SQL} SELECT * FROM hits")
def a4_big_long_trx(spark: SparkSession, sf: str) -> DataFrame:
    return stats.big_long(stats_feed(spark, sf), 7, 3)


@query(
    f"{HITS_SQL} SELECT h.seq, e.db || '.' || e.tb AS \"table\", CAST(sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) AS BIGINT) AS inserts, CAST(sum(CASE WHEN op = 'update' THEN 1 ELSE 0 END) AS BIGINT) AS updates, CAST(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) AS BIGINT) AS deletes "
    "FROM hits h JOIN ev e ON e.run = h.run AND e.kind = 'row' AND e.seq < h.seq GROUP BY h.seq, e.db, e.tb"
)
def a5_trx_detail(spark: SparkSession, sf: str) -> DataFrame:
    feed = stats_feed(spark, sf)
    return stats.details(feed, stats.big_long(feed, 7, 3))


@query(f"WITH {STATS_SQL} SELECT seq, CAST(sum(CASE WHEN p IS DISTINCT FROM tag THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS segment FROM (SELECT seq, tag, lag(tag) OVER (ORDER BY seq) AS p FROM (SELECT seq, CASE WHEN (seq + 1) // 1000 % 3 = 0 THEN 'a' ELSE 'b' END AS tag FROM ev))")
def w6_segments(spark: SparkSession, sf: str) -> DataFrame:
    feed = stats_feed(spark, sf).withColumn("binlog", F.when(F.floor((F.col("seq") + 1) / 1000) % 3 == 0, "a").otherwise("b"))
    return trx.segments(feed.withColumnRenamed("segment", "log"), "log", ("seq",)).select("seq", "segment")


@query(f"WITH {FEED_SQL} SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS statements, CAST(0 AS BIGINT) AS errors FROM feed")
def k11_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(render.statements(with_names(orders_feed(spark, sf)), render.Style()))


@query("SELECT event_type AS type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def a8_census(spark: SparkSession, sf: str) -> DataFrame:
    return maps.census(read(spark, sf, "events").withColumnRenamed("event_type", "type"))


@query(
    "WITH r AS (SELECT n_regionkey AS t, n_nationkey AS o, CASE WHEN n_nationkey % 3 = 0 THEN 'PRIMARY' ELSE 'k' || (n_nationkey % 2) END AS k, 'c' || (n_nationkey % 4) AS c, CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END AS nu FROM nation), "
    "d AS (SELECT t, k, c, min(o) AS o FROM r WHERE nu = 0 GROUP BY t, k, c), g AS (SELECT t, k, min(o) AS o, string_agg(c, ',' ORDER BY o) AS cols FROM d GROUP BY t, k) "
    "SELECT t AS tb, coalesce(max(CASE WHEN k = 'PRIMARY' THEN cols END), '') AS pk, coalesce(string_agg(CASE WHEN k <> 'PRIMARY' THEN cols END, ';' ORDER BY o), '') AS uks FROM g GROUP BY t"
)
def a7_index_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = read(spark, sf, "nation").select(F.lit("d").alias("db"), F.col("n_regionkey").alias("tb"), k.alias("ord"), F.when(k % 3 == 0, "PRIMARY").otherwise(F.concat(F.lit("k"), (k % 2).cast("string"))).alias("key_name"), k.alias("seq"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("column_name"), F.when(k % 7 == 0, 1).otherwise(0).alias("non_unique"))
    return catalog.index_keys(rows).select("tb", F.array_join("pk", ",").alias("pk"), F.array_join(F.transform("uks", lambda u: F.array_join(u, ",")), ";").alias("uks"))


# ---- joins ----


@query(
    "WITH e AS (SELECT event_id, user_id % 5 AS file_ord, user_id % 7 AS table_id, event_type = 'signup' AS m FROM events) "
    "SELECT event_id, map FROM (SELECT event_id, m, last_value(CASE WHEN m THEN event_id END IGNORE NULLS) OVER (PARTITION BY file_ord, table_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS map FROM e) WHERE NOT m"
)
def j1_asof_table_map(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("file_ord"), (F.col("user_id") % 7).alias("table_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "signup", "table_map").otherwise("rows").alias("kind"), F.col("event_id").alias("map"))
    return maps.latest_map(e).select("event_id", "map")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(F.lit("d").alias("db"), F.col("n_nationkey").cast("long").alias("tb"), F.col("n_name").alias("name"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", F.lit("d").alias("db"), F.col("c_nationkey").cast("long").alias("tb"))


@query("SELECT c_custkey, n_name AS name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 <> 0")
def j2_schema_join(spark: SparkSession, sf: str) -> DataFrame:
    return maps.with_schema(customers(spark, sf), nations(spark, sf), 25).select("c_custkey", "name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0)")
def j3_schema_missing(spark: SparkSession, sf: str) -> DataFrame:
    return maps.without_schema(customers(spark, sf), nations(spark, sf)).select("c_custkey")


@query("SELECT p_name AS name, 'missing' AS problem FROM part WHERE p_size < 10 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0) UNION ALL SELECT p_name, 'extra' FROM part WHERE p_partkey % 2 = 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size < 10)")
def j6_manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").withColumnRenamed("p_name", "name")
    return maps.manifest_check(p.where("p_size < 10").select("name"), p.where("p_partkey % 2 = 0").select("name"))


@query(
    "WITH a AS (SELECT l_orderkey AS k, l_returnflag AS s, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 5 = 0 THEN l_linestatus ELSE l_returnflag END AS s, count(*) AS n FROM lineitem WHERE l_linenumber <> 4 GROUP BY ALL), "
    "f AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) - coalesce(b.n, 0) AS d FROM a FULL JOIN b ON a.k = b.k AND a.s = b.s) "
    "SELECT k, CAST(sum(greatest(d, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(-d, 0)) AS BIGINT) AS only_b FROM f GROUP BY k HAVING sum(abs(d)) > 0"
)
def j7_compare(spark: SparkSession, sf: str) -> DataFrame:
    l = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")  # noqa: E741
    a = l.select("k", F.col("l_returnflag").alias("sql"))
    b = l.where("l_linenumber <> 4").select("k", F.when(F.col("k") % 5 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("sql"))
    return maps.compare(a, b, keys=("k",))


# ---- texts ----


def text_query(name: str, sql: str, table: str, run: Callable[[DataFrame], DataFrame]) -> None:
    @query(sql, name)
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return run(read(spark, sf, table))


text_query("x1_ident", "SELECT p_partkey, '`' || replace('p`' || p_name || '`', '`', '``') || '`' AS name FROM part", "part", lambda d: d.select("p_partkey", X.ident(F.concat(F.lit("p`"), F.col("p_name"), F.lit("`"))).alias("name")))
text_query("x2_literal", f"SELECT doc_id, {q_sql('text')} AS sql FROM documents", "documents", lambda d: d.select("doc_id", X.quoted(F.col("text")).alias("sql")))
text_query("x2_literal_pages", f"SELECT page_id, {q_sql('html')} AS sql FROM pages", "pages", lambda d: d.select("page_id", X.quoted(F.col("html")).alias("sql")))
text_query("x3_hex", "SELECT doc_id, '0x' || hex(text) AS sql FROM documents", "documents", lambda d: d.select("doc_id", X.hex_literal(F.col("text").cast("binary")).alias("sql")))

def tagged() -> Column:
    return F.struct(F.when(F.col("doc_id") % 4 == 0, "null").when(F.col("doc_id") % 4 == 1, "int").when(F.col("doc_id") % 4 == 2, "str").otherwise("bytes").alias("tag"), F.when(F.col("doc_id") % 4 == 1, F.col("n_chars").cast("string")).when(F.col("doc_id") % 4 == 2, F.col("text")).alias("txt"), F.when(F.col("doc_id") % 4 == 3, F.col("source").cast("binary")).alias("bin"))


X4 = f"CASE doc_id % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN {q_sql('text')} ELSE '0x' || hex(source) END"
text_query("x4_encode", f"SELECT doc_id, {X4} AS sql FROM documents", "documents", lambda d: d.select("doc_id", X.literal(tagged()).alias("sql")))
text_query("x5_null_predicate", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '`c` IS NULL' ELSE '`c`=' || {X4} END AS sql FROM documents", "documents", lambda d: d.select("doc_id", X.condition(X.ident(F.lit("c")), tagged()).alias("sql")))
text_query("x7_datetime", "SELECT event_id, strftime(make_timestamp((1600000000 + event_id * 86413 + 19800) * 1000000), '%Y-%m-%d_%H:%M:%S') AS at FROM events", "events", lambda d: d.select("event_id", X.moment(F.lit(1_600_000_000).cast("long") + F.col("event_id") * 86413, 19800).alias("at")))
TYPES = "CASE p_partkey % 5 WHEN 0 THEN ' BIGINT(20) UNSIGNED ' WHEN 1 THEN 'Varchar(' || p_size || ')' WHEN 2 THEN 'double unsigned zerofill' WHEN 3 THEN 'TEXT' ELSE 'int signed' END"
text_query("x17_norm_type", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar' WHEN 2 THEN 'double' WHEN 3 THEN 'text' ELSE 'int' END AS type FROM part", "part", lambda d: d.selectExpr("p_partkey", f"{TYPES} AS raw").select("p_partkey", catalog.norm_type_column(F.col("raw")).alias("type")))
text_query("x20_keyword", "SELECT event_id, event_type AS word FROM events", "events", lambda d: d.select("event_id", X.keyword(F.concat(F.lit("  "), F.upper("event_type"), F.when(F.col("event_id") % 2 == 0, ";; ").otherwise(" "))).alias("word")))
RAW_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'mysql-bin.' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 1 THEN 'x' WHEN 2 THEN 'b.c.' || p_partkey ELSE 'x.' || p_name END"
# a server writes six digits at least; lpad alone cuts longer numbers
SERVER_NAME = RAW_NAME.replace("AS VARCHAR", "AS STRING").replace(", 6, '0')", ", greatest(6, length(CAST(p_partkey AS STRING))), '0')")
text_query("x21_file_number", f"SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_partkey ELSE coalesce(try_cast(regexp_extract({RAW_NAME}, '\\.([0-9]+)$', 1) AS BIGINT), 0) END AS number FROM part", "part", lambda d: d.selectExpr("p_partkey", f"{SERVER_NAME} AS raw").select("p_partkey", X.file_number(F.col("raw")).alias("number")))
text_query("s15_name_order", "WITH n AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END || '.' || (o_orderkey % 37) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS base, o_orderkey % 37 AS number FROM orders) SELECT name, CAST(row_number() OVER (ORDER BY base, number) AS INTEGER) AS place FROM n", "orders", lambda d: d.selectExpr("concat(CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END, '.', o_orderkey % 37) AS name").distinct().select("name", F.row_number().over(W.orderBy(X.name_base(F.col("name")), X.name_number(F.col("name")))).alias("place")))
PATHS = "CASE p_partkey % 3 WHEN 0 THEN '..' WHEN 1 THEN '../' || p_name ELSE p_name || '\\x' END"
text_query("k4_sanitize", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '?' WHEN 1 THEN '..?' || replace(replace(p_name, '/', '?'), '\\', '?') ELSE replace(replace(p_name, '/', '?'), '\\', '?') || '?x' END AS path FROM part", "part", lambda d: d.select("p_partkey", X.path_safe(F.when(F.col("p_partkey") % 3 == 0, "..").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("../"), "p_name")).otherwise(F.concat("p_name", F.lit("\\x")))).alias("path")))
text_query("x27_single_file_name", "SELECT p_partkey, p_partkey % 3 = 2 AND NOT regexp_matches(p_name, '[/\\\\]') AS ok FROM part", "part", lambda d: d.select("p_partkey", X.single_file_name(F.when(F.col("p_partkey") % 3 == 0, "..").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("../"), "p_name")).otherwise(F.col("p_name"))).alias("ok")))


@query(f"WITH {FEED_SQL} SELECT seq, '# datetime=' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d_%H:%M:%S') || ' database=' || db || ' table=' || tb || ' binlog=' || binlog || ' startpos=' || start_pos || ' stoppos=' || end_pos AS info FROM feed")
def k3_extra_info(spark: SparkSession, sf: str) -> DataFrame:
    return orders_feed(spark, sf).select("seq", X.extra_info().alias("info"))


@query(
    f"{CHAIN_SQL}, c AS (SELECT segment, win, binlog, db, tb, min(seq) AS ord, arg_min(ts, seq) AS t1, arg_max(ts, seq) AS t2, arg_min(start_pos, seq) AS p1, arg_max(end_pos, seq) AS p2, sum(CASE WHEN op = 'insert' THEN 1 ELSE 0 END) AS i, sum(CASE WHEN op = 'update' THEN 1 ELSE 0 END) AS u, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) AS d FROM w WHERE kind = 'row' GROUP BY segment, win, binlog, db, tb) "
    "SELECT ord, printf('%-17s %-19s %-19s %-10d %-10d %-8d %-8d %-8d %-15s %-20s', binlog, strftime(make_timestamp(t1 * 1000000), '%Y-%m-%d_%H:%M:%S'), strftime(make_timestamp(t2 * 1000000), '%Y-%m-%d_%H:%M:%S'), p1, p2, CAST(i AS BIGINT), CAST(u AS BIGINT), CAST(d AS BIGINT), db, tb) AS line FROM c"
)
def x23_report_line(spark: SparkSession, sf: str) -> DataFrame:
    return stats.report_lines(stats.window_counts(stats_feed(spark, sf), 30)).select("ord", "line")


@query("SELECT event_id, event_id % 5 = 1 AS skipped FROM events WHERE event_id % 5 IN (0, 1, 2, 3, 4)")
def e5_ddl_excluded(spark: SparkSession, sf: str) -> DataFrame:
    sql = F.when(F.col("event_id") % 5 == 0, "BEGIN").when(F.col("event_id") % 5 == 1, "drop table t;").when(F.col("event_id") % 5 == 2, " Commit ").when(F.col("event_id") % 5 == 3, "").otherwise("rollback;")
    return read(spark, sf, "events").select("event_id", (~X.keyword(sql).isin("", "begin", "commit", "rollback")).alias("skipped"))


@query(f"WITH {STATS_SQL}, b AS (SELECT min(seq) AS bound FROM ev WHERE seq >= 9000 AND seq % 5 = 0) SELECT seq, end_pos, ts FROM ev, b WHERE kind IN ('commit', 'rollback') AND seq < bound ORDER BY seq DESC LIMIT 1")
def t5_commit_watermark(spark: SparkSession, sf: str) -> DataFrame:
    feed = stats_feed(spark, sf)
    return commit_watermark(feed, feed.where("not (seq >= 9000 and seq % 5 = 0)").select("seq"))


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 >= 6")
def roundtrip_undo(spark: SparkSession, sf: str) -> DataFrame:
    """Rows there before the feed, from the state behind it and the undone changes."""
    feed = orders_feed(spark, sf)
    at = lambda image, i: F.get(F.col(image), i)["txt"]
    state = feed.where("after is not null").select(at("after", 0).alias("k"), at("after", 1).alias("s"))
    undo = feed.select(F.coalesce(at("before", 0), at("after", 0)).alias("k"), at("before", 1).alias("old"), F.col("before").isNotNull().alias("kept"))
    back = state.join(undo, "k", "full_outer").where("kept")
    return back.select(F.col("k").cast("long").alias("k"), F.col("old").alias("s"))


# ---- a log on disk ----


def orders_log(spark: SparkSession, sf: str, folder: str, crc: bool = True) -> dict:
    """Writes the orders table as logs of inserts, 50 rows an event and 400,000 keys a file, and gives its schema. A task writes a file."""
    columns = [(8, b""), varchar(20), (246, bytes([15, 2])), (18, b"\0"), INT]
    rows = read(spark, sf, "orders").selectExpr("o_orderkey k", "o_orderstatus s", "cast(cast(o_totalprice as decimal(15,2)) as string) p", "date_format(o_orderdate, 'yyyyMMddHHmmss') d", "o_custkey c", "cast(o_orderkey div 400000 as int) + 1 file")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        log, every = Log(crc=crc), list(pdf.sort_values("k").itertuples(index=False))
        for i in range(0, len(every), 50):
            ts = 1_700_000_000 + i
            log.begin(ts)
            log.map(7, "shop", "orders", columns, ts)
            moment = lambda d: datetime2(int(d[:4]), *(int(d[x : x + 2]) for x in range(4, 14, 2)))
            log.rows(30, 7, [[int(r.k).to_bytes(8, "little", signed=True), s1(r.s), decimal(r.p, 15, 2), moment(r.d), i4(int(r.c))] for r in every[i : i + 50]], ts)
            log.xid(ts)
        put(f"{folder}/mysql-bin.{int(key[0]):06d}", bytes(log.data))
        return pdf.head(1)[["k"]]

    rows.groupBy("file").applyInPandas(write, "k long").count()
    names = [("o_orderkey", "bigint"), ("o_orderstatus", "varchar"), ("o_totalprice", "decimal"), ("o_orderdate", "datetime"), ("o_custkey", "int")]
    return {"version": 1, "tables": [{"db": "shop", "table": "orders", "cols": [{"name": n, "type_name": t, "unsigned": False} for n, t in names], "pk": ["o_orderkey"], "uks": []}]}


def log_options(spark: SparkSession, sf: str, **more: object) -> Options:
    import json

    folder = shared_folder(spark, "orders-log")
    put(f"{folder}/schema.json", json.dumps(orders_log(spark, sf, folder)).encode())
    return Options(binlog_dir=folder, start_file="mysql-bin.000001", schema_file=f"{folder}/schema.json", **more)


@query("SELECT o_orderkey AS k, o_orderstatus AS s, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_custkey AS c FROM orders")
def s1_log_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as logs, read back and decoded."""
    rows = modes.changes(spark, log_options(spark, sf, split_bytes=100_000))
    at = lambda i: F.get("after", i)["txt"]
    return rows.select(at(0).cast("long").alias("k"), at(1).alias("s"), at(2).alias("price"), at(3).alias("at"), at(4).cast("long").alias("c"))


@query("SELECT o_orderkey AS k, CAST(1 + o_orderkey // 50 AS BIGINT) AS trx_id, 'INSERT INTO `shop`.`orders` (`o_orderkey`,`o_orderstatus`,`o_totalprice`,`o_orderdate`,`o_custkey`) VALUES (' || o_orderkey || ',''' || o_orderstatus || ''',' || CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) || ',''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''',' || o_custkey || ');' AS sql FROM orders")
def to_sql_of_log(spark: SparkSession, sf: str) -> DataFrame:
    out = modes.rendered(spark, log_options(spark, sf, split_bytes=100_000))
    return out.select(F.regexp_extract("sql", r"VALUES \((\d+),", 1).cast("long").alias("k"), "trx_id", "sql")


from . import log_queries  # noqa: E402, F401 (adds its queries)
