"""Functions for users' SQL, and typed views."""

import json

from rowtide.functions import udfs
from rowtide.functions.text import literal, quoted
from rowtide.operators.typed import typed
from rowtide.sources.writer import INT, Log, column, i4, s1, table, varchar

from pyspark.sql import functions as F

T0 = 1_700_000_000


def test_sql_functions(spark, sf_dir):
    udfs.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(-1, "a'\"\\%\\_\\x\n\r\t\b\x1a\0"), (-2, None)], "doc_id long, text string"), allowMissingColumns=True)
    same = docs.select(F.expr("sql_literal(text)").eqNullSafe(quoted(F.col("text"))).alias("same")).where("not same")
    assert same.count() == 0
    row = spark.sql("SELECT sql_ident('a`b'), sql_hex(X'00ff'), mysql_double(1e20D), mysql_double(0.5D), mysql_double(12D)").first()
    assert tuple(row) == ("`a``b`", "0x00FF", "100000000000000000000", "0.5", "12")
    assert docs.where("doc_id = -1").select(quoted(F.col("text"))).first()[0] == "'a\\'\\\"\\%\\_\\\\x\\n\\r\\t\\b\\Z\\0'"


def test_table_function_and_typed_view(spark, tmp_path):
    log = Log()
    log.begin(T0)
    log.map(1, "d", "t", [INT, varchar(30), varchar(30)], T0)
    log.rows(31, 1, [[i4(-5), s1("2023-11-14"), None], [i4(7), s1("0000-00-00"), s1("x")]], T0)
    log.rows(32, 1, [[i4(1), s1("2020-01-01"), s1("y")]], T0)
    log.xid(T0)
    folder = log.save(tmp_path)
    entry = table("d", "t", [column("id"), column("day", "date"), column("s", "varchar")])
    schema = json.dumps({"version": 1, "tables": [entry]})
    udfs.register(spark)
    rows = spark.sql(f"SELECT op, before, after FROM binlog_rows('{folder}/mysql-bin.000001', '{schema}') ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [("update", '["-5", "2023-11-14", null]', '["7", "0000-00-00", "x"]'), ("delete", '["1", "2020-01-01", "y"]', None)]
    changes = spark.read.format("binlog").options(path=folder, view="changes", schemaJson=schema).load().where("kind = 'rows'")
    got = typed(changes, entry).orderBy("pos").collect()
    assert (got[0]["old"]["id"], str(got[0]["old"]["day"]), got[0]["new"]["day"], got[0]["new"]["s"], got[1]["new"]) == (-5, "2023-11-14", None, "x", None)


def test_cells_as_literals(spark):
    rows = [("null", None, None), ("int", "-1", None), ("str", "a'b", None), ("bytes", None, b"\x01\xab"), ("json", '{"a":"\\n"}', None), ("missing", None, None), ("decimal", "1.50", None)]
    df = spark.createDataFrame([(r,) for r in rows], "c struct<tag:string,txt:string,bin:binary>")
    assert [r[0] for r in df.select(literal(F.col("c"))).collect()] == ["NULL", "-1", "'a\\'b'", "0x01AB", "'{\\\"a\\\":\\\"\\\\n\\\"}'", None, "1.50"]
