"""Cells of one table as columns of Spark's types, as far as these can hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark type by server type and sign; others stay text. Unsigned numbers take the next wider type.
TYPES = {
    "tinyint": ("tinyint", "smallint"), "smallint": ("smallint", "int"), "mediumint": ("int", "int"), "int": ("int", "bigint"), "bigint": ("bigint", "decimal(20,0)"),
    "year": ("smallint", "smallint"), "bit": ("decimal(20,0)", "decimal(20,0)"), "float": ("float", "float"), "double": ("double", "double"),
    "date": ("date", "date"), "datetime": ("timestamp_ntz", "timestamp_ntz"), "timestamp": ("timestamp_ntz", "timestamp_ntz"), "enum": ("int", "int"), "set": ("decimal(20,0)", "decimal(20,0)"),
}
BINARY = ("blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary", "geometry")


def value(cell: Column, type_name: str, unsigned: bool, precision: str | None = None) -> Column:
    """Null for NULL, for a missing column and for what the type can't hold (a zero date, say); the cell itself has the text."""
    if type_name in BINARY:
        return F.coalesce(cell["bin"], cell["txt"].cast("binary"))
    if type_name == "decimal" and precision:
        return cell["txt"].try_cast(f"decimal({precision})")
    kind = TYPES.get(type_name)
    text = F.coalesce(cell["txt"], F.hex(cell["bin"]))
    return text if kind is None else cell["txt"].try_cast(kind[unsigned])


def typed(changes: DataFrame, table: dict, keep: tuple[str, ...] = ("binlog", "pos", "row_no", "op", "ts")) -> DataFrame:
    """Changes of ``table`` (an entry of the catalog) with structs ``old`` and ``new`` of its columns, null where there is no such image."""
    own = changes.where((F.col("db") == table["db"]) & (F.col("tb") == table["table"]))

    def image(name: str) -> Column:
        fields = [value(F.get(name, i), c["type_name"], bool(c.get("unsigned")), c.get("precision")).alias(c["name"]) for i, c in enumerate(table["cols"])]
        return F.when(F.col(name).isNotNull(), F.struct(*fields))

    return own.select(*keep, image("before").alias("old"), image("after").alias("new"))
