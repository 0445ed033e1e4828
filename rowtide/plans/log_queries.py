"""Queries over logs that executors write from the driver's tables, and the same results as SQL for DuckDB.

The log of ``part``: file 1 + key div 500, a transaction for each ten keys, one second apart. The shared folder holds logs and schemas.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import render
from ..options import Options
from ..sources import catalog as catalogs
from ..sources import writer as B
from ..sources.binlog import register
from ..sources.cells import civil
from ..sources.files import put, shared_folder, system
from ..sources.sinks import HEADER
from . import modes
from .queries import query, read

BASE = 1_700_000_000
#: Rows that a log is built of at once; files of ``parts`` have fewer.
AT_ONCE = 10_000
#: Column kinds by name: type code and metadata as a table map has them, type name and sign as a catalog has them.
KINDS: dict[str, tuple[int, bytes, str, bool]] = {
    "k": (8, b"", "bigint", False), "tiny": (1, b"", "tinyint", False), "small": (2, b"", "smallint", True), "medium": (9, b"", "mediumint", False), "big": (8, b"", "bigint", False), "huge": (8, b"", "bigint", True),
    "year": (13, b"", "year", False), "bit": (16, bytes([4, 1]), "bit", False), "enum": (254, bytes([0xF7, 1]), "enum", False), "set": (254, bytes([0xF8, 2]), "set", False),
    "float": (4, b"\4", "float", False), "double": (5, b"\x08", "double", False),
    "d5": (246, bytes([5, 0]), "decimal", False), "d20": (246, bytes([20, 6]), "decimal", False), "d4": (246, bytes([4, 4]), "decimal", False),
    "date": (10, b"", "date", False), "time": (19, b"\0", "time", False), "moment": (18, b"\3", "datetime", False), "stamp": (17, b"\0", "timestamp", False),
    "later": (18, b"\0", "datetime", False), "clock": (253, struct.pack("<H", 80), "varchar", False), "calendar": (253, struct.pack("<H", 80), "varchar", False),
    "json": (245, b"\4", "json", False), "name": (15, struct.pack("<H", 40), "varchar", False), "long": (253, struct.pack("<H", 3000), "varchar", False), "blob": (252, b"\2", "blob", False), "text": (252, b"\2", "text", False), "char": (254, bytes([254, 40]), "char", False),
}


def moment_of(k: int) -> int:
    return 10**9 + 86399 * k


def fitting(kind: str, keys: list[int]) -> str:
    """The kind of column that holds these keys' values: beyond the range of TIME, TIMESTAMP and DATETIME, what a table is altered to then."""
    if kind == "time" and max(abs((k - 1000) * 997) for k in keys) >= 839 * 3600:
        return "clock"
    if kind == "stamp" and moment_of(max(keys)) >= 1 << 32:
        return "later" if moment_of(max(keys)) < 253_402_300_800 else "calendar"  # the year 10000
    return kind


def value(kind: str, k: int, name: str) -> bytes | None:
    """What the column holds for a key, as SQL below has it."""
    match kind:
        case "k" | "big":
            return B.whole(k if kind == "k" else (2**63 - 1 - k if k % 2 == 0 else -(2**63) + k), 8)
        case "tiny":
            return B.whole(k % 256 - 128, 1)
        case "small":
            return B.whole(k * 31 % 65536, 2)
        case "medium":
            return B.whole(k * 7919 % 16777216 - 8388608, 3)
        case "huge":
            return B.whole(2**64 - 1 - k, 8)
        case "year":
            return bytes([k % 256])
        case "bit":
            return (k % 4096).to_bytes(2, "big")
        case "enum":
            return bytes([k % 5 + 1])
        case "set":
            return B.whole(k % 1024, 2)
        case "float":
            return struct.pack("<f", k % 1000 / 8 - 50)
        case "double":
            return struct.pack("<d", k * 1048576.5)
        case "d5":
            return B.decimal(str(k * 37 % 99999 - 50000), 5, 0)
        case "d20":
            v = (k - 1000) * 1000001
            return B.decimal(f"{'-' if v < 0 else ''}{abs(v) // 10**6}.{abs(v) % 10**6:06d}", 20, 6)
        case "d4":
            return B.decimal(f"0.{k % 10000:04d}", 4, 4)
        case "date":
            return b"\0\0\0" if k % 50 == 0 else B.date3(1990 + k % 40, 1 + k % 12, 1 + k % 28)
        case "time":
            return B.time2((k - 1000) * 997)
        case "moment":
            return B.datetime2(2000 + k % 30, 1 + k % 12, 1 + k % 28, k % 24, k % 60, k * 7 % 60) + (k % 1000 * 10).to_bytes(2, "big")
        case "stamp":
            return moment_of(k).to_bytes(4, "big")
        case "later":
            at = civil(moment_of(k))
            return B.datetime2(*(int(x) for x in re.split("[- :]", at)))
        case "clock":
            s = abs((k - 1000) * 997)
            return B.counted(f"{'-' * (k < 1000)}{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}".encode(), 1)
        case "calendar":
            return B.counted(civil(moment_of(k)).encode(), 1)
        case "json":
            kind, raw = B.json2({"k": k, "yes": k % 2 == 0, "no": None, "q": k / 4, "wide": k * 5_000_000_000, "in": {"name": name, "list": [k % 7, -k, 'a"é\n']}})
            return B.counted(bytes([kind]) + raw, 4)
        case "name":
            return None if k % 7 == 0 else B.counted(name.encode() + b"\xff" * (k % 3 == 0), 1)
        case "long" | "text":
            return B.counted(f"{name}'s \\ {k}".encode(), 2)
        case "blob":
            return B.counted(bytes([k % 256, 255, 0]) if k % 5 else b"", 2)
        case "char":
            return B.counted(name.encode(), 1)
    raise ValueError(kind)


def written(spark: SparkSession, rows: DataFrame, build: Callable[[B.Log, list[Any], int], None], crc: bool = True) -> str:
    """A folder with a log for each ``file`` of the rows, in order of ``k``; a task writes a file at a time, and holds ``AT_ONCE`` rows of it."""
    folder = shared_folder(spark, "logs")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = (r for pdf in batches for r in pdf.itertuples(index=False))
        for file, rows in itertools.groupby(every, lambda r: int(r.file)):
            log, n = B.Log(crc=crc), 0
            fs, path = system(f"{folder}/mysql-bin.{file:06d}")
            with fs.open_output_stream(path) as out:
                while some := list(itertools.islice(rows, AT_ONCE)):
                    build(log, some, file)
                    out.write(log.take())
                    n += len(some)
            yield pd.DataFrame({"n": [n]})

    rows.repartition("file").sortWithinPartitions("file", "k").mapInPandas(write, "n long").agg(F.sum("n")).first()
    return folder


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), (F.floor(F.col("p_partkey") / 500) + 1).cast("int").alias("file"))


def layout(kinds: list[str]) -> list[tuple[int, bytes]]:
    return [KINDS[c][:2] for c in kinds]


def schema(kinds: list[str], tb: str = "zoo") -> dict:
    return B.table("shop", tb, [B.column(c, *KINDS[c][2:]) for c in kinds], ("k",))


def saved(folder: str, *tables: dict) -> str:
    put(f"{folder}/schema.json", json.dumps({"version": 1, "tables": list(tables)}).encode())
    return f"{folder}/schema.json"


def options(folder: str, schema_file: str, **more: object) -> Options:
    return Options(binlog_dir=folder, start_file="mysql-bin.000001", schema_file=schema_file, **({"split_bytes": 20_000} | more))


def inserts(kinds: list[str], kind: int = 30) -> Callable[[B.Log, list[Any], int], None]:
    def build(log: B.Log, rows: list[Any], file: int) -> None:
        for i in range(0, len(rows), 10):
            ts, ten = BASE + rows[i].k // 10, rows[i : i + 10]
            held = [fitting(c, [r.k for r in ten]) for c in kinds]
            log.begin(ts, "shop")
            log.map(70, "shop", "zoo", layout(held), ts)
            log.rows(kind, 70, [[value(c, r.k, r.name) for c in held] for r in ten], ts)
            log.xid(ts)

    return build


def zoo(spark: SparkSession, sf: str, *kinds: str, event: int = 30, crc: bool = True, **more: object) -> DataFrame:
    """Changes of a log with these columns beside the key, decoded."""
    every = ["k", *kinds]
    folder = written(spark, parts(spark, sf), inserts(every, event), crc)
    return modes.changes(spark, options(folder, saved(folder, schema(every)), **more))


def txt(i: int, image: str = "after") -> Column:
    return F.get(F.col(image), F.lit(i))["txt"]


def texts(df: DataFrame, *names: str, image: str = "after") -> DataFrame:
    return df.select(txt(0, image).cast("long").alias("k"), *(txt(i + 1, image).alias(f"v_{n}") for i, n in enumerate(names)))


K = "p_partkey"


@query(
    f"SELECT {K} AS k, CAST({K} % 256 - 128 AS VARCHAR) AS v_tiny, CAST({K} * 31 % 65536 AS VARCHAR) AS v_small, CAST({K} * 7919 % 16777216 - 8388608 AS VARCHAR) AS v_medium, CAST(CASE WHEN {K} % 2 = 0 THEN 9223372036854775807 - {K} ELSE -9223372036854775807 - 1 + {K} END AS VARCHAR) AS v_big, "
    f"CAST(CAST(18446744073709551615 AS HUGEINT) - {K} AS VARCHAR) AS v_huge, CAST(CASE WHEN {K} % 256 = 0 THEN 0 ELSE 1900 + {K} % 256 END AS VARCHAR) AS v_year, CAST({K} % 4096 AS VARCHAR) AS v_bit, CAST({K} % 5 + 1 AS VARCHAR) AS v_enum, CAST({K} % 1024 AS VARCHAR) AS v_set FROM part"
)
def x9_integers_of_log(spark: SparkSession, sf: str) -> DataFrame:
    names = ("tiny", "small", "medium", "big", "huge", "year", "bit", "enum", "set")
    return texts(zoo(spark, sf, *names), *names)


@query(f"SELECT {K} AS k, regexp_replace(CAST(CAST({K} % 1000 / 8.0 - 50 AS FLOAT) AS VARCHAR), '\\.0$', '') AS v_float, regexp_replace(CAST(CAST({K} * 1048576.5 AS DOUBLE) AS VARCHAR), '\\.0$', '') AS v_double FROM part")
def x10_floats_of_log(spark: SparkSession, sf: str) -> DataFrame:
    return texts(zoo(spark, sf, "float", "double"), "float", "double")


@query(
    f"WITH v AS (SELECT {K} AS k, ({K} - 1000) * 1000001 AS v FROM part) SELECT k, CAST(k * 37 % 99999 - 50000 AS VARCHAR) AS v_d5, CASE WHEN v < 0 THEN '-' ELSE '' END || (abs(v) // 1000000) || '.' || lpad(CAST(abs(v) % 1000000 AS VARCHAR), 6, '0') AS v_d20, '0.' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS v_d4 FROM v"
)
def x11_decimals_of_log(spark: SparkSession, sf: str) -> DataFrame:
    return texts(zoo(spark, sf, "d5", "d20", "d4"), "d5", "d20", "d4")


@query(
    f"WITH v AS (SELECT {K} AS k, abs(({K} - 1000) * 997) AS s FROM part) SELECT k, CASE WHEN k % 50 = 0 THEN '0000-00-00' ELSE printf('%04d-%02d-%02d', 1990 + k % 40, 1 + k % 12, 1 + k % 28) END AS v_date, CASE WHEN k < 1000 THEN '-' ELSE '' END || printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS v_time, "
    "printf('%04d-%02d-%02d %02d:%02d:%02d.%03d', 2000 + k % 30, 1 + k % 12, 1 + k % 28, k % 24, k % 60, k * 7 % 60, k % 1000) AS v_moment, strftime(make_timestamp((1000000000 + 86399 * k) * 1000000), '%Y-%m-%d %H:%M:%S') AS v_stamp FROM v"
)
def x12_times_of_log(spark: SparkSession, sf: str) -> DataFrame:
    return texts(zoo(spark, sf, "date", "time", "moment", "stamp"), "date", "time", "moment", "stamp")


@query(
    f"SELECT {K} AS k, '{{\"k\":' || {K} || ',\"yes\":' || CASE WHEN {K} % 2 = 0 THEN 'true' ELSE 'false' END || ',\"no\":null,\"q\":' || CAST({K} / 4.0 AS DOUBLE) || ',\"wide\":' || CAST({K} * 5000000000 AS BIGINT) || ',\"in\":{{\"name\":\"' || p_name || '\",\"list\":[' || ({K} % 7) || ',' || (0 - {K}) || ',\"a\\\"é\\n\"]}}}}' AS v_json FROM part"
)
def x13_json_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """Objects, arrays, integers of three widths, doubles and escapes."""
    return texts(zoo(spark, sf, "json"), "json")


@query(
    f"SELECT {K} AS k, CASE WHEN {K} % 7 = 0 THEN 'null' WHEN {K} % 3 = 0 THEN 'bytes' ELSE 'str' END AS t_name, CASE WHEN {K} % 7 = 0 OR {K} % 3 = 0 THEN NULL ELSE p_name END AS v_name, CASE WHEN {K} % 7 <> 0 AND {K} % 3 = 0 THEN hex(encode(p_name)) || 'FF' END AS b_name, "
    f"p_name || '''s \\ ' || {K} AS v_long, CASE WHEN {K} % 5 = 0 THEN '' ELSE hex(CAST({K} % 256 AS UTINYINT)::INTEGER) END AS b_blob, p_name || '''s \\ ' || {K} AS v_text, p_name AS v_char FROM part"
)
def x6_strings_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """Strings, strings that aren't UTF-8, nulls, blobs and texts."""
    df = zoo(spark, sf, "name", "long", "blob", "text", "char")
    at = lambda i: F.get("after", F.lit(i))
    first = F.hex(F.substring(at(3)["bin"], 1, 1))
    return df.select(txt(0).cast("long").alias("k"), at(1)["tag"].alias("t_name"), txt(1).alias("v_name"), F.hex(at(1)["bin"]).alias("b_name"), txt(2).alias("v_long"), F.regexp_replace(first, "^0(.)$", "$1").alias("b_blob"), txt(4).alias("v_text"), txt(5).alias("v_char"))


def updates(log: B.Log, rows: list[Any], file: int) -> None:
    """Of each three keys an event: whole images, images that leave columns out, and a deletion."""
    kinds = ["k", "tiny", "char", "small"]
    for i in range(0, len(rows), 10):
        ts = BASE + rows[i].k // 10
        log.begin(ts, "shop")
        for r in rows[i : i + 10]:
            log.map(70, "shop", "zoo", layout(kinds), ts)
            old, new = ([value(c, r.k + d, r.name) for c in kinds] for d in (0, 1))
            if r.k % 3 == 0:
                log.rows(31, 70, [old, new, new, old], ts)
            elif r.k % 3 == 1:
                log.rows(31, 70, [[old[0]], [new[1], new[3]]], ts, present=[0], after=[1, 3])
            else:
                log.rows(32, 70, [old], ts)
        log.xid(ts)


def changed(spark: SparkSession, sf: str) -> tuple[str, str]:
    folder = written(spark, parts(spark, sf), updates)
    return folder, saved(folder, schema(["k", "tiny", "char", "small"]))


TINY = "CAST({0} % 256 - 128 AS VARCHAR)"


@query(
    f"WITH e AS (SELECT {K} AS k, p_name AS name, unnest(CASE WHEN {K} % 3 = 0 THEN [0, 1] ELSE [0] END) AS row_no FROM part), i AS (SELECT *, k + row_no AS b, CASE WHEN k % 3 = 0 THEN k + 1 - row_no ELSE k + 1 END AS a FROM e) "
    f"SELECT k, CAST(row_no AS INTEGER) AS row_no, CASE WHEN k % 3 = 2 THEN 'delete' ELSE 'update' END AS op, CAST(b AS VARCHAR) AS before_k, CASE WHEN k % 3 = 1 THEN 'missing' ELSE 'int' END AS before_tag, CASE WHEN k % 3 <> 1 THEN {TINY.format('b')} END AS before_tiny, CASE WHEN k % 3 = 0 THEN CAST(a AS VARCHAR) END AS after_k, CASE k % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'missing' END AS after_tag, CASE WHEN k % 3 <> 2 THEN {TINY.format('a')} END AS after_tiny FROM i"
)
def x18_images_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """Before and after images in pairs, several rows an event, columns that are left out."""
    df = modes.changes(spark, options(*changed(spark, sf)))
    event = F.when(F.col("op") != "delete", F.when(F.col("row_no") == 1, txt(0, "after")).otherwise(txt(0, "before"))).otherwise(txt(0, "before"))
    tag = lambda image, i: F.get(F.col(image), F.lit(i))["tag"]
    return df.select(event.cast("long").alias("k"), "row_no", "op", txt(0, "before").alias("before_k"), tag("before", 1).alias("before_tag"), txt(1, "before").alias("before_tiny"), txt(0, "after").alias("after_k"), tag("after", 0).alias("after_tag"), txt(1, "after").alias("after_tiny"))


@query(f"SELECT CAST({K} // 10 + 1 AS BIGINT) AS trx_id, CASE WHEN {K} % 3 = 2 THEN 'delete' ELSE 'update' END AS op, CAST(count(*) AS BIGINT) AS events, CAST(sum(CASE WHEN {K} % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS rows FROM part GROUP BY ALL")
def a2_update_rows_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of events in transactions numbered over files and stretches; a pair of images is one row."""
    facts = modes.read(spark, options(*changed(spark, sf)), "facts").where("kind = 'rows'")
    return facts.groupBy("trx_id", "op").agg(F.count("*").alias("events"), F.sum("rows").alias("rows"))


LINE = "'DELETE FROM `shop`.`zoo` WHERE `k`=' || CAST(k AS VARCHAR) || ';'"


@query(
    f"WITH r AS (SELECT {K} AS k, {K} // 10 AS trx FROM part), lines AS (SELECT -1 AS t, 0 AS p, 0 AS s, 'SET NAMES utf8mb4;' AS line UNION ALL SELECT (SELECT max(trx) FROM r) - trx, 1, 0, 'commit;' FROM r GROUP BY trx UNION ALL SELECT (SELECT max(trx) FROM r) - trx, 2, 0, 'begin;' FROM r GROUP BY trx "
    f"UNION ALL SELECT (SELECT max(trx) FROM r) - trx, 3, 0 - k, {LINE} FROM r UNION ALL SELECT (SELECT max(trx) + 1 FROM r), 0, 0, 'commit;') SELECT CAST(row_number() OVER (ORDER BY t, p, s) AS BIGINT) AS place, line FROM lines"
)
def o2_undo_file_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """The undo file to the line: last change first, each transaction within its own."""
    every = ["k", "small"]
    folder = written(spark, parts(spark, sf).withColumn("file", F.lit(1)), inserts(every))
    return lines_of(spark, options(folder, saved(folder, schema(every)), work="flashback", output_dir=f"{folder}/out"), "flashback")


@query(
    f"WITH r AS (SELECT {K} AS k, CASE WHEN {K} % 3 = 2 THEN 'DELETE FROM `shop`.`zoo` WHERE `k`=' || {K} || ';' END AS line FROM part WHERE {K} % 3 = 2), l AS (SELECT -1 AS k, 'SET NAMES utf8mb4;' AS line UNION ALL SELECT k, line FROM r) SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS place, line FROM l"
)
def k1_file_of_log(spark: SparkSession, sf: str) -> DataFrame:
    """The file of deletions, which the source is asked for alone, in the order of the logs."""
    folder, schema_file = changed(spark, sf)
    return lines_of(spark, options(folder, schema_file, dml=("delete",), output_dir=f"{folder}/out"), "to_sql")


@query(
    f"WITH r AS (SELECT {K} AS k, {K} // 500 + 1 AS f, CAST(length('DELETE FROM `shop`.`zoo` WHERE `k`=' || {K} || ';') + 1 AS BIGINT) AS length FROM part WHERE {K} % 3 = 2) SELECT 'to_sql.' || f || '.sql' AS file, CAST(k // 10 + 1 AS BIGINT) AS trx_id, CAST(19 + coalesce(sum(length) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", length FROM r"
)
def k6_block_index(spark: SparkSession, sf: str) -> DataFrame:
    """Where each event's statements lie in the SQL files."""
    folder, schema_file = changed(spark, sf)
    rows = modes.rendered(spark, options(folder, schema_file, dml=("delete",)))
    return render.block_index(rows, HEADER).select("file", "trx_id", "offset", "length")


def lines_of(spark: SparkSession, o: Options, prefix: str) -> DataFrame:
    """The lines of all files of one kind that a run writes, in their order."""
    modes.run_sql(spark, o)
    # within a block that one task reads, numbers go up by one; what stands before it, a table of one row a block tells
    at = [F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    every = spark.read.option("lineSep", "\n").option("pathGlobFilter", f"{prefix}.*").text(str(o.output_dir)).select(*at, F.col("value").alias("line"))
    blocks = every.groupBy("name", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    order = W.orderBy(F.split("name", "[.]")[1].cast("long"), "block")
    header = F.when((F.col("block") == 0) & (F.row_number().over(order) > 1), 1).otherwise(0)  # one header is enough
    blocks = blocks.withColumn("header", header)
    before = F.coalesce(F.sum(F.col("n") - F.col("header")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.col("id") - F.col("first") - F.col("header") + 1
    return every.join(blocks.withColumn("before", before), ["name", "block"]).where(F.col("id") >= F.col("first") + F.col("header")).select(place.cast("long").alias("place"), "line")


def events_build(log: B.Log, rows: list[Any], file: int) -> None:
    for r in rows:
        ts = BASE + r.k
        if r.k % 4 == 0:
            log.query("shop", f"ALTER TABLE t{r.k} COMMENT 'x'", ts)
        elif r.k % 4 == 1:
            log.event(33, ts, bytes(25))
        elif r.k % 4 == 2:
            log.xid(ts)
        else:
            log.event(29, ts, b"\4note")
    log.rotate(f"mysql-bin.{file + 1:06d}", BASE)


def events_of(spark: SparkSession, sf: str, crc: bool) -> DataFrame:
    register(spark)
    return spark.read.format("binlog").option("path", written(spark, parts(spark, sf), events_build, crc)).load()


#: Bytes of an event of events_build by key, with a checksum of four bytes or without.
SIZE = "CASE k % 4 WHEN 0 THEN 19 + 13 + 4 + 1 + 25 + length(CAST(k AS VARCHAR)) WHEN 1 THEN 44 WHEN 2 THEN 27 ELSE 24 END"


@query(
    f"WITH e AS (SELECT {K} AS k, {K} // 500 AS f, {SIZE.replace('k %', K + ' %').replace('CAST(k', f'CAST({K}')} + 4 AS size FROM part), p AS (SELECT *, CAST(124 + sum(size) OVER (PARTITION BY f ORDER BY k) AS BIGINT) AS end_pos FROM e) "
    "SELECT k + 1700000000 AS ts, CAST(f AS INTEGER) AS file_ord, 'mysql-bin.' || lpad(CAST(f + 1 AS VARCHAR), 6, '0') AS binlog, end_pos - size AS pos, end_pos, CASE k % 4 WHEN 0 THEN 'query' WHEN 1 THEN 'gtid' WHEN 2 THEN 'xid' ELSE 'other' END AS kind, CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 33 WHEN 2 THEN 16 ELSE 29 END AS INTEGER) AS type, CASE WHEN k % 4 = 0 THEN 'ALTER TABLE t' || k || ' COMMENT ''x''' END AS sql FROM p"
)
def s2_events_of_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Headers, places, kinds and statements of several files with checksums."""
    return events_of(spark, sf, True).where("kind != 'rotate'").select("ts", "file_ord", "binlog", "pos", "end_pos", "kind", "type", "sql")


@query("SELECT f AS file_ord, 'mysql-bin.' || lpad(CAST(f + 2 AS VARCHAR), 6, '0') AS name FROM (SELECT DISTINCT CAST(p_partkey // 500 AS INTEGER) AS f FROM part)")
def s8_rotations_of_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The names that rotations tell, from files without checksums."""
    return events_of(spark, sf, False).where("kind = 'rotate'").select("file_ord", F.col("sql").alias("name"))


@query(f"SELECT {K} AS k, CAST({K} // 10 + 1 AS BIGINT) AS trx_id, CAST(2 AS INTEGER) AS n_log, CAST(23 AS INTEGER) AS type FROM part")
def s22_old_rows_events(spark: SparkSession, sf: str) -> DataFrame:
    """Rows events of the older version, without checksums, several stretches a file."""
    return zoo(spark, sf, "small", event=23, crc=False, split_bytes=5000).select(txt(0).cast("long").alias("k"), "trx_id", "n_log", "type")


def damaged_build(log: B.Log, rows: list[Any], file: int) -> None:
    inserts(["k", "small"])(log, rows, file)
    last = [len(log.data)]
    ts = BASE + rows[-1].k
    if file % 3 == 1:  # a checksum that is wrong, and what stands behind it
        at = log.query("shop", "DROP TABLE gone", ts)
        log.data = log.data[: at[1] - 1] + bytes([log.data[at[1] - 1] ^ 1])
        log.xid(ts)
    elif file % 3 == 2:  # the file ends within an event
        log.query("shop", "DROP TABLE gone", ts)
        log.data = log.data[:-7]
    else:  # a size that no event has
        log.data += struct.pack("<IBIIIH", ts, 2, 1, 7, last[0] + 7, 0)


@query(
    f"WITH f AS (SELECT {K} // 500 AS f, count(*) AS rows FROM part GROUP BY 1) SELECT CAST(f AS INTEGER) AS file_ord, CASE (f + 1) % 3 WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'too_short' ELSE 'invalid_data' END AS error, CAST(rows AS BIGINT) AS rows FROM f"
)
def s13_damaged_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged files give what stands before the damage and one error each; other files aren't touched."""
    folder = written(spark, parts(spark, sf), damaged_build)
    df = modes.changes(spark, options(folder, saved(folder, schema(["k", "small"])), split_bytes=0))
    return df.groupBy("file_ord").agg(F.max(F.regexp_extract("error", "^([a-z_]+):", 1)).alias("error"), F.count("after").alias("rows"))


@query(f"SELECT {K} AS k, {K} % 2 = 0 AS known FROM part")
def j3_tables_without_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables that the catalog lacks give an error instead of rows."""

    def build(log: B.Log, rows: list[Any], file: int) -> None:
        for r in rows:
            log.map(70 + r.k % 2, "shop", "zoo" if r.k % 2 == 0 else "gone", layout(["k"]), BASE + r.k)
            log.rows(30, 70 + r.k % 2, [[value("k", r.k, "")]], BASE + r.k)

    folder = written(spark, parts(spark, sf), build)
    df = modes.changes(spark, options(folder, saved(folder, schema(["k"]))))
    return df.select((F.col("ts") - BASE).alias("k"), (F.col("error").isNull() & (txt(0).cast("long") == F.col("ts") - BASE)).alias("known"))


@query(f"SELECT {K} AS k, '{{\"k\":' || {K} || '}}' IS NOT NULL AS ok FROM part WHERE {K} >= 700 AND {K} < 1300 AND {K} % 10 <> 3")
def f4_windows_of_logs(spark: SparkSession, sf: str) -> DataFrame:
    """A window by time over several files, and a table left out, applied while reading."""

    def build(log: B.Log, rows: list[Any], file: int) -> None:
        for r in rows:
            log.map(70, "shop", "zoo" if r.k % 10 != 3 else "side", layout(["k"]), BASE + r.k)
            log.rows(30, 70, [[value("k", r.k, "")]], BASE + r.k)

    folder = written(spark, parts(spark, sf), build)
    import datetime

    at = lambda k: datetime.datetime.fromtimestamp(BASE + k, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    o = options(folder, saved(folder, schema(["k"]), schema(["k"], "side")), start_datetime=at(700), stop_datetime=at(1300), ignore_table=("shop.side",))
    return modes.changes(spark, o).select(txt(0).cast("long").alias("k"), F.lit(True).alias("ok"))


@query("SELECT 't' || CAST(n_regionkey AS VARCHAR) AS tb, array_to_string(list(n_name ORDER BY n_nationkey DESC)[1:2], ',') AS names, '0' AS pk FROM nation GROUP BY n_regionkey")
def s18_catalog_file(spark: SparkSession, sf: str) -> DataFrame:
    """A schema file with several entries a table: the last counts."""
    rows = read(spark, sf, "nation").orderBy("n_nationkey").collect()  # a table of 25 rows
    earlier: dict[int, str] = {}
    tables = []
    for r in rows:
        names = [r["n_name"], *([earlier[r["n_regionkey"]]] if r["n_regionkey"] in earlier else [])]
        tables.append(B.table("d", f"t{r['n_regionkey']}", [B.column(n, "int") for n in names], (r["n_name"],)))
        earlier[r["n_regionkey"]] = r["n_name"]
    path = saved(shared_folder(spark, "catalog"), *tables)
    return catalogs.frame_of(spark, catalogs.tables_of(catalogs.read_catalog(path))).select("tb", F.array_join("names", ",").alias("names"), F.array_join(F.col("pk").cast("array<string>"), ",").alias("pk"))
