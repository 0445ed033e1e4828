"""Column functions that write SQL text, file names and report lines, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = "`"
#: Characters of a literal and what stands for them, besides the backslash.
ESCAPES = (("\0", "\\0"), ("'", "\\'"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\x1a", "\\Z"))
SPECIAL = "[\\\\\u0000'\"\b\t\n\r\u001a]"


def lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def ident(name: Column) -> Column:
    return F.concat(F.lit(TICK), lit_replace(name, TICK, TICK * 2), F.lit(TICK))


def quoted(text: Column) -> Column:
    """A string literal; a backslash isn't doubled before % or _. Most texts have nothing to escape, which one look tells."""
    special = F.rlike(text, F.lit(SPECIAL))
    return F.concat(F.lit("'"), F.when(special, escaped(text)).otherwise(text), F.lit("'"))


def escaped(text: Column) -> Column:
    out = lit_replace(text, "\\", "\\\\")
    for wild in "%_":
        out = lit_replace(out, "\\\\" + wild, "\\" + wild)
    for old, new in ESCAPES:
        out = lit_replace(out, old, new)
    return out


def hex_literal(raw: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(raw))


def literal(cell: Column) -> Column:
    """SQL text of a cell; null for a missing one, and for a null array element."""
    tag, txt = cell["tag"], cell["txt"]
    text = F.when(F.is_valid_utf8(txt), quoted(txt)).otherwise(hex_literal(txt.cast("binary")))
    return (
        F.when(tag.isin("int", "decimal", "uint", "double"), txt).when(tag.isin("str", "json"), text)
        .when(tag == "null", "NULL").when(tag == "bytes", hex_literal(cell["bin"]))
    )


def condition(name: Column, cell: Column) -> Column:
    """``name`` as it stands in a statement."""
    return F.when(cell["tag"] == "null", F.concat(name, F.lit(" IS NULL"))).otherwise(F.concat(name, F.lit("="), literal(cell)))


def moment(ts: Column, offset_seconds: int = 0) -> Column:
    """``yyyy-MM-dd_HH:mm:ss`` at a fixed offset, whatever the session's time zone."""
    at = F.timestamp_add("SECOND", ts + F.lit(offset_seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.ltrim(F.date_format(at, "yyyy-MM-dd_HH:mm:ss"), F.lit("+"))  # which stands before a year of five digits


def extra_info(offset_seconds: int = 0) -> Column:
    parts = [("# datetime=", moment(F.col("ts"), offset_seconds)), (" database=", F.col("db")), (" table=", F.col("tb")), (" binlog=", F.col("binlog")), (" startpos=", F.col("start_pos").cast("string")), (" stoppos=", F.col("end_pos").cast("string"))]
    return F.concat(*(x for name, c in parts for x in (F.lit(name), c)))


def keyword(sql: Column) -> Column:
    return F.lower(F.trim(F.rtrim(F.trim(sql), F.lit(";"))))


def path_safe(name: Column) -> Column:
    return F.when(name == "..", "?").otherwise(F.translate(name, "/\\\0", "???"))


def name_base(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[0-9]+$", "")


def name_number(name: Column) -> Column:
    """Number behind the last point; -1 without one."""
    return F.coalesce(F.regexp_extract(name, r"\.([0-9]+)$", 1).try_cast("long"), F.lit(-1).cast("long"))


def file_number(name: Column) -> Column:
    return F.greatest(name_number(name), F.lit(0))


def out_file(prefix: str, per_table: bool) -> Column:
    """Name of the SQL file that a change belongs to."""
    number = file_number(F.col("binlog")).cast("string")
    if per_table:
        return F.concat(F.lit(prefix + "."), path_safe(F.col("db")), F.lit("."), path_safe(F.col("tb")), F.lit("."), number, F.lit(".sql"))
    return F.concat(F.lit(prefix + "."), number, F.lit(".sql"))


def single_file_name(name: Column) -> Column:
    return (F.length(name) > 0) & ~name.isin(".", "..") & (F.translate(name, "/\\\0", "") == name)


def status_line() -> Column:
    return F.format_string("%-17s %-19s %-19s %-10d %-10d %-8d %-8d %-8d %-15s %-20s", "binlog", "start_time", "stop_time", "start_pos", "stop_pos", "inserts", "updates", "deletes", "db", "tb")


def big_long_line() -> Column:
    return F.format_string("%-17s %-19s %-19s %-10d %-10d %-8d %-10d [%s]", "binlog", "start_time", "stop_time", "start_pos", "stop_pos", "rows", "duration", "tables")
