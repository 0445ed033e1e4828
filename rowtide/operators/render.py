"""SQL statements of row changes, as expressions over cells: no Python runs per row.

Input: op, db, tb, n_log, before, after (arrays of cells) and the table's names, pk, uks (ordinals).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import condition, ident, literal


@dataclass(frozen=True)
class Style:
    undo: bool = False
    full_columns: bool = False
    unique_first: bool = False
    ignore_pk: bool = False
    db_prefix: bool = True
    strict: bool = False
    insert_batch: int = 1
    #: The table's rows carry what :func:`prepare` adds.
    prepared: bool = False


def prepare(catalog: DataFrame, style: Style) -> DataFrame:
    """Adds to each table what every statement of it repeats: its quoted names, and the head of an INSERT of all of its columns."""
    whole = catalog.withColumn("idents", F.transform("names", ident)).withColumn("n_log", F.size("names"))
    return whole.withColumn("head", insert_head(replace(style, prepared=False))).drop("n_log")


def ident_at(i: Column, style: Style) -> Column:
    return F.get("idents", i) if style.prepared else ident(F.get("names", i))


def width() -> Column:
    """Columns that have both a name and a place in the log."""
    return F.least(F.size("names"), F.col("n_log"))


def key_ordinals(style: Style) -> Column:
    """Columns of WHERE: of a unique key (if they come first), the primary key, a unique key, else all."""
    every = F.sequence(F.lit(0), width() - 1)
    if style.full_columns:
        return every
    within = lambda key: F.forall(key, lambda i: i < F.col("n_log"))
    uks, pk = F.filter("uks", within), F.when(within(F.col("pk")), F.col("pk")).otherwise(F.array().cast("array<int>"))
    choice = F.when(F.size(pk) > 0, pk).when(F.size(uks) > 0, F.get(uks, 0)).otherwise(every)
    return F.when(F.size(uks) > 0, F.get(uks, 0)).otherwise(choice) if style.unique_first else choice


def target(style: Style) -> Column:
    return F.concat(ident(F.col("db")), F.lit("."), ident(F.col("tb"))) if style.db_prefix else ident(F.col("tb"))


def where_clause(image: Column, style: Style) -> Column:
    return F.array_join(F.transform(key_ordinals(style), lambda i: condition(ident_at(i, style), F.get(image, i))), " AND ")


def insert_ordinals(style: Style) -> Column:
    every = F.sequence(F.lit(0), width() - 1)
    return F.filter(every, lambda i: ~F.array_contains("pk", i)) if style.ignore_pk else every


def insert_head(style: Style) -> Column:
    names = F.array_join(F.transform(insert_ordinals(style), lambda i: ident_at(i, style)), ",")
    head = F.concat(F.lit("INSERT INTO "), target(style), F.lit(" ("), names, F.lit(") VALUES "))
    return F.when(F.col("n_log") >= F.size("names"), F.col("head")).otherwise(head) if style.prepared else head


def insert_tuple(image: Column, style: Style) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(insert_ordinals(style), lambda i: literal(F.get(image, i))), ","), F.lit(")"))


def set_ordinals(style: Style) -> Column:
    every = F.sequence(F.lit(0), width() - 1)
    return every if style.full_columns else F.filter(every, lambda i: ~F.get("before", i).eqNullSafe(F.get("after", i)))


def set_clause(image: Column, style: Style) -> Column:
    return F.array_join(F.transform(set_ordinals(style), lambda i: F.concat(ident_at(i, style), F.lit("="), literal(F.get(image, i)))), ",")


def lacks(image: Column, ordinals: Column) -> Column:
    return F.array_contains(image["tag"], "missing") & F.exists(ordinals, lambda i: F.get(image, i)["tag"] == "missing")


def dml(style: Style) -> tuple[Column, Column, Column]:
    """(verb, the image that is written or found, the image of WHERE), undone or not."""
    op = F.col("op")
    verb = F.when(op == "update", "update").when(op == ("delete" if style.undo else "insert"), "insert").otherwise("delete")
    only = F.coalesce("before", "after")
    wrote, found = ("before", "after") if style.undo else ("after", "before")
    return verb, F.when(op == "update", F.col(wrote)).otherwise(only), F.when(op == "update", F.col(found)).otherwise(only)


def problem(style: Style) -> Column:
    """Why a change has no statement; null if it has one (or is an update that changes nothing)."""
    verb, image, where = dml(style)
    every = F.sequence(F.lit(0), width() - 1)
    used = F.when(verb == "insert", lacks(image, insert_ordinals(style))).when(verb == "delete", lacks(where, key_ordinals(style))).otherwise(lacks(image, set_ordinals(style)) | lacks(where, key_ordinals(style)))
    out = F.when(F.col("names").isNull(), F.concat(F.lit("no_schema: no schema for `"), "db", F.lit("`.`"), "tb", F.lit("`")))
    if style.strict:
        out = out.when(F.size("names") != F.col("n_log"), F.format_string("column_count: %d columns in the log, %d in the schema", F.col("n_log"), F.size("names")))
    out = out.when(width() < 1, "no_columns: no column has a name")
    if style.undo:
        out = out.when(F.col("n_log") > F.size("names"), "dropped_columns: old images are not whole")
        used = F.when(verb == "update", lacks(F.col("before"), every) | lacks(F.col("after"), every)).otherwise(lacks(image, every))
    out = out.when(used, "missing_column: the row image is not full")
    return out.when((verb == "insert") & (F.size(insert_ordinals(style)) == 0), "no_columns: every column is of the primary key") if style.ignore_pk else out


def statements(changes: DataFrame, style: Style) -> DataFrame:
    """``sql`` of each change, null where ``error`` says why, or where an update changes nothing."""
    verb, image, where = dml(style)
    update = F.concat(F.lit("UPDATE "), target(style), F.lit(" SET "), set_clause(image, style), F.lit(" WHERE "), where_clause(where, style), F.lit(";"))
    delete = F.concat(F.lit("DELETE FROM "), target(style), F.lit(" WHERE "), where_clause(where, style), F.lit(";"))
    insert = F.concat(insert_head(style), insert_tuple(image, style), F.lit(";"))
    error = problem(style)
    changes = changes.withColumn("error", F.coalesce("error", error) if "error" in changes.columns else error)
    sql = F.when(verb == "insert", insert).when(verb == "delete", delete).when(F.size(set_ordinals(style)) > 0, update)
    return changes.withColumn("sql", F.when(F.col("error").isNull(), sql))


def batched_inserts(changes: DataFrame, style: Style, event: tuple[str, ...] = ("file_ord", "pos"), order: str = "row_no") -> DataFrame:
    """Statements of which an INSERT takes up to ``insert_batch`` rows of its event; other columns are those of its first row."""
    verb, image, _ = dml(style)
    one = statements(changes, style)
    if style.insert_batch <= 1:
        return one
    some = one.withColumn("_insert", verb == "insert")
    tuples = some.where("_insert and error is null").withColumn("_head", insert_head(style)).withColumn("_tuple", insert_tuple(image, style))
    tuples = tuples.withColumn("_batch", F.floor(F.col(order) / style.insert_batch))
    keep = [c for c in one.columns if c not in (*event, "sql")]
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_tuple"))), lambda x: x["_tuple"]), ",")
    joined = tuples.groupBy(*event, "_batch").agg(listed.alias("_all"), F.min_by(F.struct(*keep, "_head"), order).alias("_first"))
    sql = F.concat("_first._head", "_all", F.lit(";")).alias("sql")
    merged = joined.select(*event, *(F.col(f"_first.`{c}`").alias(c) for c in keep), sql)
    return some.where("not _insert or error is not null").select(one.columns).unionByName(merged.select(one.columns))


def undo_order(rendered: DataFrame, part: str, seq: tuple[str, ...] = ("file_ord", "pos", "row_no")) -> DataFrame:
    """Undone in reverse within each ``part`` (an output file), with ``new_trx`` where another transaction begins."""
    w = W.partitionBy(part).orderBy(*(F.col(c).desc() for c in seq))
    return rendered.withColumn("new_trx", F.lag("trx_id", 1, 0).over(w) != F.col("trx_id"))


def block_index(rendered: DataFrame, header: str, info: bool = False) -> DataFrame:
    """(file, file_ord, pos, trx_id, offset, length): the bytes that each event's statements take in its SQL file, one file a log."""
    text = F.octet_length("sql") + 1
    blocks = rendered.where("sql is not null").groupBy("file", "file_ord", "pos", "trx_id").agg((F.sum(text) + (F.max(F.octet_length("info") + 1) if info else F.lit(0))).cast("long").alias("length"))
    w = W.partitionBy("file").orderBy("file_ord", "pos").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(w), F.lit(0)) + F.lit(len(header.encode()) + 1)
    return blocks.select("file", "file_ord", "pos", "trx_id", before.cast("long").alias("offset"), "length")
