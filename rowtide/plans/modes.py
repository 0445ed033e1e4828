"""The queries: forward statements, undo statements and statistics of a log window."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extra_info, keyword, moment, out_file
from ..operators import render, stats
from ..operators.maps import with_schema
from ..options import Options
from ..sources import sinks
from ..sources.binlog import plan_ranges, register
from ..sources.catalog import dump, frame_of, read_catalog, tables_of


def style(o: Options) -> render.Style:
    return render.Style(o.undo, o.full_columns, o.unique_key_first, o.ignore_primary_key_for_insert, not o.no_db_prefix, o.strict_schema, o.insert_batch)


def read(spark: SparkSession, o: Options, view: str) -> DataFrame:
    register(spark)
    options = o.reader() | {"view": view}
    found = spark.read.format("binlog").options(**options, ranges=plan_ranges(spark, options, o.split_bytes)).load()
    return found.withColumnsRenamed({"trx": "trx_id", "run": "run_id"})


def tables(o: Options) -> list[dict]:
    if not o.schema_file:
        raise ValueError("a schema file is needed (use sources.catalog.online_catalog to make one from a server)")
    return tables_of(read_catalog(o.schema_file))


def changes(spark: SparkSession, o: Options, prepared: render.Style | None = None) -> DataFrame:
    """Every row change of the window, with its transaction and its table's schema; undecodable events carry an error."""
    known = tables(o)
    found = read(spark, o, "changes").where("kind in ('rows', 'error')")
    catalog = frame_of(spark, known)
    return with_schema(found, render.prepare(catalog, prepared) if prepared else catalog, len(known))


def rendered(spark: SparkSession, o: Options) -> DataFrame:
    """Statements of the window, one row a change: sql, file, info, trx_id, error and the order (file_ord, pos, row_no)."""
    how = replace(style(o), prepared=True)
    out = render.batched_inserts(changes(spark, o, how), how)
    prefix = "flashback" if o.undo else "to_sql"
    out = out.withColumn("row_no", F.coalesce("row_no", F.lit(0))).withColumn("file", out_file(prefix, o.file_per_table)).withColumn("info", extra_info(o.offset))
    return out.select("file_ord", "pos", "row_no", "binlog", "start_pos", "end_pos", "ts", "op", "db", "tb", "trx_id", "file", "info", "sql", "error")


def to_sql(spark: SparkSession, o: Options) -> DataFrame:
    """Forward statements in the order of the log."""
    return rendered(spark, o).where("sql is not null").orderBy("file_ord", "pos", "row_no")


def flashback(spark: SparkSession, o: Options) -> DataFrame:
    """Undo statements, last change first, over all files."""
    return rendered(spark, o).where("sql is not null").orderBy(F.desc("file_ord"), F.desc("pos"), F.desc("row_no"))


def ddl(spark: SparkSession, o: Options) -> DataFrame:
    """Statements that an undo leaves out: (timestamp, binlog, position, type, sql)."""
    word = keyword(F.col("sql"))
    found = read(spark, o, "events").where((F.col("kind") == "query") & ~word.isin("", "begin", "commit", "rollback"))
    return found.orderBy("file_ord", "pos").select(moment(F.col("ts"), o.offset).alias("timestamp"), "binlog", F.col("start_pos").alias("position"), F.lit("Query").alias("type"), "sql")


def feed(spark: SparkSession, o: Options) -> tuple[DataFrame, DataFrame]:
    """The statistics feed of the window, and its skipped events. Rows are counted, images not kept."""
    known = tables(o)
    facts = read(spark, o, "facts")
    word = F.coalesce(keyword(F.col("sql")), F.lit(""))
    kind = F.when(F.col("kind") == "rows", "row").when(F.col("kind") == "xid", "commit").when(word.isin("begin", "commit", "rollback"), word).otherwise("tick")
    good = facts.where("error is null and kind in ('rows', 'query', 'xid')")
    # places in a file are below 2**38, and so a file's events keep apart from the next's
    out = good.select((F.shiftleft(F.col("file_ord").cast("long"), 38) + F.col("pos")).alias("seq"), F.col("file_ord").cast("long").alias("segment"), "binlog", kind.alias("kind"), "ts", "start_pos", "end_pos", "db", "tb", "op", "rows", F.col("run_id").alias("run"))
    assert known is not None
    return out, facts.where("error is not null")


@dataclass(frozen=True)
class Summary:
    events: int
    statements: int
    errors: int
    files: int = 0

    def __str__(self) -> str:
        return f"events={self.events}, statements={self.statements}, errors={self.errors}, files={self.files}"


@dataclass(frozen=True)
class StatsSummary:
    events: int
    rows: int
    windows: int
    hits: int
    skipped: int

    def __str__(self) -> str:
        return f"stats done: events={self.events}, statements rows={self.rows}, windows flushed={self.windows}, big/long trx={self.hits}, skipped={self.skipped}"


def run_sql(spark: SparkSession, o: Options) -> Summary:
    """to-sql or flashback into files (or stdout). An undo that must be whole writes nothing unless it is."""
    out = rendered(spark, o).cache()
    try:
        events, statements, errors = stats.summary(out).first()
        if errors and o.on_error == "stop":
            raise RuntimeError(f"{errors} events can't be rendered, the first: {out.where('error is not null').orderBy('file_ord', 'pos').first()['error']}")
        if o.undo and o.report_file:
            sinks.write_lines((json.dumps(r.asDict(), ensure_ascii=False, separators=(",", ":")) for r in ddl(spark, o).toLocalIterator()), o.report_file)
        files = 0
        if not o.dry_run:
            warn = f"-- WARNING: skipped {errors} events, positions in stderr" if o.undo and errors else None
            files = sinks.write_sql(out.where("sql is not null"), None if o.to_stdout else o.output_dir, undo=o.undo, info=o.add_extra_info, keep_trx=o.keep_trx, warn=warn)
        if o.schema_dump:
            dump(tables(o), o.schema_dump)
        return Summary(events, statements, errors, files)
    finally:
        out.unpersist()


def run_stats(spark: SparkSession, o: Options) -> StatsSummary:
    """Writes binlog_status.txt and biglong_trx.txt, and their JSON lines on request, into the output folder."""
    if not o.output_dir:
        raise ValueError("stats needs output_dir (--output-dir)")
    events, bad = feed(spark, o)
    skipped = bad.count()
    if skipped and o.on_error == "stop":
        raise RuntimeError(bad.orderBy("file_ord", "pos").first()["error"])
    events = events.cache()
    try:
        lines = stats.report_lines(stats.window_counts(events, o.print_interval), o.offset).orderBy("segment", "win", "ord").cache()
        hits = stats.big_long(events, o.big_trx_rows, o.long_trx_seconds)
        big = stats.big_long_lines(hits, stats.details(events, hits), o.offset).orderBy("seq").cache()
        sinks.write_reports(lines, big, o.output_dir, skipped, o.stats_json)
        n = events.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if o.schema_dump:
            dump(tables(o), o.schema_dump)
        return StatsSummary(n[0], n[1], lines.select("segment", "win").distinct().count(), big.count(), skipped)
    finally:
        events.unpersist()
