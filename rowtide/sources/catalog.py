"""Table schemas from outside the log: a JSON file, or rows of the server's SHOW statements."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_log, system

VERSION = 1
TABLES = "db string, table string, cols array<struct<name:string,type_name:string,unsigned:boolean>>, pk array<string>, uks array<array<string>>"


def read_catalog(path: str) -> dict:
    with open_log(path) as f:
        return json.loads(f.read())


def tables_of(catalog: dict) -> list[dict]:
    """Of tables named twice the last counts; sorted by ``db.table``."""
    if catalog.get("version") != VERSION:
        raise ValueError(f"schema file version {catalog.get('version')} is not {VERSION}")
    last = {(t["db"], t["table"]): t for t in catalog["tables"]}
    return [last[k] for k in sorted(last, key=lambda k: f"{k[0]}.{k[1]}")]


def columns_of(catalog: dict) -> dict[tuple[str, str], list[tuple[str, bool]]]:
    return {(t["db"], t["table"]): [(c["type_name"], bool(c.get("unsigned"))) for c in t["cols"]] for t in tables_of(catalog)}


def catalog_frame(spark: SparkSession, path: str) -> DataFrame:
    """The schema file as a table, read by Spark: one row a db and table, of repeated ones the last."""
    raw = spark.read.schema(f"version int, tables array<struct<db:string,table:string,cols:array<struct<name:string,type_name:string,unsigned:boolean>>,pk:array<string>,uks:array<array<string>>>>").json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("schema file version is not "), F.lit(str(VERSION))))
    raw = raw.withColumn("tables", F.when(F.col("version") == VERSION, F.col("tables")).otherwise(wrong))
    rows = raw.select(F.posexplode("tables").alias("at", "t")).select("at", "t.*")
    last = rows.groupBy("db", "table").agg(F.max_by(F.struct("cols", "pk", "uks"), "at").alias("t"))
    return with_ordinals(last.select("db", F.col("table").alias("tb"), "t.*"))


def frame_of(spark: SparkSession, tables: list[dict]) -> DataFrame:
    rows = [(t["db"], t["table"], [(c["name"], c["type_name"], bool(c.get("unsigned"))) for c in t["cols"]], list(t.get("pk") or []), [list(u) for u in t.get("uks") or []]) for t in tables]
    return with_ordinals(spark.createDataFrame(rows, TABLES).withColumnRenamed("table", "tb"))


def with_ordinals(tables: DataFrame) -> DataFrame:
    """(db, tb, names, pk, uks): keys as column ordinals; a key with a column that the table lacks is dropped whole."""
    names = F.transform("cols", lambda c: c["name"])

    def ordinals(key: Column) -> Column:
        return F.transform(key, lambda k: (F.array_position(F.col("names"), k) - 1).cast("int"))

    out = tables.withColumn("names", names).withColumn("pk", ordinals(F.coalesce("pk", F.array().cast("array<string>"))))
    out = out.withColumn("uks", F.transform(F.coalesce("uks", F.array().cast("array<array<string>>")), ordinals))
    known = lambda key: ~F.exists(key, lambda i: i < 0)
    return out.select("db", "tb", "names", F.when(known(F.col("pk")), F.col("pk")).otherwise(F.array().cast("array<int>")).alias("pk"), F.filter("uks", lambda k: known(k) & (F.size(k) > 0)).alias("uks"))


def dump(tables: list[dict], path: str) -> None:
    """Writes the catalog, sorted, as one JSON document."""
    text = json.dumps({"version": VERSION, "tables": tables_of({"version": VERSION, "tables": tables})}, ensure_ascii=False, indent=2)
    fs, p = system(path)
    with fs.open_output_stream(p) as f:
        f.write(text.encode())


def norm_type(name: str) -> tuple[str, bool]:
    """(type in lower case without length or sign, unsigned)."""
    low = name.strip().lower()
    return re.sub(r"\s+(unsigned|signed|zerofill)\b", "", low.partition("(")[0].strip() if "(" in low else low).strip(), "unsigned" in low


def norm_type_column(name: Column) -> Column:
    base = F.trim(F.substring_index(F.lower(F.trim(name)), "(", 1))
    return F.trim(F.regexp_replace(base, r"\s+(unsigned|signed|zerofill)\b", ""))


def index_keys(index_rows: DataFrame) -> DataFrame:
    """(db, tb, pk, uks) of SHOW INDEX rows (db, tb, ord, key_name, seq, column_name, non_unique).

    Unique keys only, columns in order and once each; a key whose name has "primary" in it is the primary key (the last
    such), the others are listed as they come.
    """
    unique = index_rows.where("non_unique = 0")
    columns = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("column_name", F.lit("")).alias("c")))), lambda x: x["c"]))
    keys = unique.groupBy("db", "tb", "key_name").agg(F.min("ord").alias("ord"), columns.alias("cols"))
    primary = F.lower("key_name").contains("primary")
    others = F.transform(F.sort_array(F.collect_list(F.when(~primary, F.struct("ord", "cols")))), lambda x: x["cols"])
    out = keys.groupBy("db", "tb").agg(F.max_by("cols", F.when(primary, F.col("ord"))).alias("pk"), others.alias("uks"))
    return out.withColumn("pk", F.coalesce("pk", F.array().cast("array<string>")))


def online_catalog(spark: SparkSession, url: str, databases: list[str], **properties: str) -> DataFrame:
    """The same table from a server's information_schema over JDBC (the driver's jar must be on the class path)."""
    names = ", ".join("'" + d.replace("'", "''") + "'" for d in databases)

    def query(sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=sql, **properties).load()

    columns = query(f"select table_schema db, table_name tb, ordinal_position ord, column_name name, column_type type from information_schema.columns where table_schema in ({names})")
    index = query(f"select table_schema db, table_name tb, seq_in_index seq, column_name, index_name key_name, non_unique, 0 ord from information_schema.statistics where table_schema in ({names})")
    cols = F.transform(F.sort_array(F.collect_list(F.struct("ord", "name", norm_type_column(F.col("type")).alias("type_name"), F.lower("type").contains("unsigned").alias("unsigned")))), lambda c: F.struct(c["name"].alias("name"), c["type_name"].alias("type_name"), c["unsigned"].alias("unsigned")))
    tables = columns.groupBy("db", "tb").agg(cols.alias("cols"))
    return with_ordinals(tables.join(index_keys(index), ["db", "tb"], "left"))


def server_logs(spark: SparkSession, url: str, **properties: str) -> DataFrame:
    """The server's logs and their sizes over JDBC, the current one last."""
    return spark.read.format("jdbc").options(url=url, query="SHOW BINARY LOGS", **properties).load()
