"""Functions for users' own SQL: literals and identifiers as SQL functions, number text, and a table function over a log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..sources.cells import plain
from ..sources.events import Bounds, Images, read_log
from ..sources.files import open_log


def sql_replace(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {old}, {new})"
    return x


#: Replacements of a literal, in order, as SQL texts (raw strings, so that backslashes stand for themselves).
LITERAL = [
    ("r'\\'", "r'\\\\'"), ("r'\\\\%'", "r'\\%'"), ("r'\\\\_'", "r'\\_'"), ("chr(0)", "r'\\0'"), ('"\'"', 'r"\\\'"'), ("'\"'", "r'\\\"'"),
    ("chr(8)", "r'\\b'"), ("chr(9)", "r'\\t'"), ("chr(10)", "r'\\n'"), ("chr(13)", "r'\\r'"), ("chr(26)", "r'\\Z'"),
]


def mysql_double(x: pd.Series) -> pd.Series:
    """Shortest digits, no exponent, no point behind a whole number."""
    return x.map(lambda v: None if v is None or pd.isna(v) else plain(float(v)))


ROWS = "binlog string, pos long, ts long, op string, db string, tb string, row_no int, before string, after string, error string"


class BinlogRows:
    """Row changes of one log file: ``SELECT * FROM binlog_rows('/logs/mysql-bin.000001', '<schema JSON>')``; images are JSON lists of texts."""

    def eval(self, path: str, schema: str) -> Iterator[tuple]:
        from ..sources.catalog import columns_of

        images = Images(columns_of(json.loads(schema)))
        text = lambda image: None if image is None else json.dumps([c[1] if c[2] is None else "0x" + c[2].hex().upper() for c in image], ensure_ascii=False)
        with open_log(path) as f:
            for e in read_log(f, path.rpartition("/")[2], 0, Bounds()):
                if e.kind == "error":
                    yield (e.binlog, e.pos, e.ts, None, None, None, None, None, None, e.error)
                elif e.kind == "rows":
                    rows, error = images.rows(e)
                    if error:
                        yield (e.binlog, e.pos, e.ts, e.op, e.db, e.tb, None, None, None, error)
                    for i, (before, after) in enumerate(rows):
                        yield (e.binlog, e.pos, e.ts, e.op, e.db, e.tb, i, text(before), text(after), None)


def register(spark: SparkSession) -> None:
    """sql_ident, sql_literal and sql_hex run inside the JVM; mysql_double over Arrow; binlog_rows is a table function."""
    from ..sources.binlog import register as register_source

    register_source(spark)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sql_ident(x STRING) RETURNS STRING RETURN concat('`', replace(x, '`', '``'), '`')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sql_literal(x STRING) RETURNS STRING RETURN concat(\"'\", {sql_replace('x', LITERAL)}, \"'\")")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sql_hex(x BINARY) RETURNS STRING RETURN concat('0x', hex(x))")
    spark.udf.register("mysql_double", pandas_udf(mysql_double, "string"))
    spark.udtf.register("binlog_rows", udtf(BinlogRows, returnType=ROWS))


__all__ = ["BinlogRows", "mysql_double", "register"]
