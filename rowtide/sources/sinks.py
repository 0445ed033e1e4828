"""Where results go: SQL files to the byte, reports, or a distributed table of statements."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.render import undo_order
from ..streaming.recovery import Checkpoint, read_checkpoint, write_checkpoint

#: The first line of SQL files, and of the two reports.
HEADER = "SET NAMES utf8mb4;"
STATUS_HEADER = "{:<17} {:<19} {:<19} {:<10} {:<10} {:<8} {:<8} {:<8} {:<15} {:<20}".format("binlog", "starttime", "stoptime", "startpos", "stoppos", "inserts", "updates", "deletes", "database", "table")
BIG_LONG_HEADER = "{:<17} {:<19} {:<19} {:<10} {:<10} {:<8} {:<10} {}".format("binlog", "starttime", "stoptime", "startpos", "stoppos", "rows", "duration", "tables")


def write_lines(lines: Iterable[str], path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(x + "\n" for x in lines)


def lines_of(rows: Iterable, undo: bool, info: bool, keep_trx: bool) -> Iterator[tuple[str, str]]:
    """(file, line) of ordered statements: an event's comment before its first statement, and the scaffold of undone transactions."""
    event = trx = file = None
    for r in rows:
        if r["file"] != file:
            if undo and keep_trx and file is not None:
                yield file, "commit;"
            file, event, trx = r["file"], None, 0
            yield file, HEADER
        if undo and keep_trx and r["trx_id"] != trx:
            yield file, "commit;"
            yield file, "begin;"
        trx = r["trx_id"]
        if info and (r["file_ord"], r["pos"]) != event:
            yield file, r["info"]
        event = (r["file_ord"], r["pos"])
        yield file, r["sql"]
    if undo and keep_trx and file is not None:
        yield file, "commit;"


def write_sql(statements: DataFrame, folder: str | None, undo: bool = False, info: bool = False, keep_trx: bool = True, warn: str | None = None) -> int:
    """One file for each name in ``file``, to the byte as one writer would, without replacing any; no folder: stdout.

    Partitions come to the driver one after another; ``write_parts`` writes large results from the executors instead.
    """
    order = [F.desc(c) if undo else F.asc(c) for c in ("file_ord", "pos", "row_no")]
    rows = statements.select("file", "file_ord", "pos", "row_no", "trx_id", "info", "sql").orderBy("file", *order).toLocalIterator()
    out: TextIO | None = None
    now, n = None, 0
    made: list[str] = []
    try:
        for file, line in lines_of(rows, undo, info, keep_trx):
            if folder is None:
                print(line, file=sys.stdout)
                continue
            if file != now:
                if out:
                    out.close()
                os.makedirs(folder, exist_ok=True)
                path = os.path.join(folder, file)
                try:
                    out = open(path, "x", encoding="utf-8", newline="")  # noqa: SIM115
                except FileExistsError:
                    raise FileExistsError(f"refusing to overwrite {path}") from None
                made.append(path)
                now, n = file, n + 1
                print(line, file=out)
                if warn:
                    print(warn, file=out)
                continue
            print(line, file=out)
    except BaseException:
        if out:
            out.close()
        for path in made:  # whole or not at all
            os.remove(path)
        raise
    if out:
        out.close()
    return n


class Appender:
    """SQL files that batches are appended to, to the byte as :func:`write_sql` would write all of them at once.

    A batch is whole when its checkpoint is written, which names the files and their lengths, after they are forced to
    disk. What a batch that wasn't whole has left is cut off before it is written again.
    """

    def __init__(self, folder: str, checkpoint: str, info: bool = False):
        self.folder, self.checkpoint, self.info = folder, checkpoint, info

    def last(self) -> Checkpoint | None:
        return read_checkpoint(self.checkpoint, self.folder)[0] if os.path.exists(self.checkpoint) else None

    def append(self, statements: DataFrame, number: int) -> None:
        done = self.last() or Checkpoint("-", 4, "")
        if number <= done.batch:
            return
        os.makedirs(self.folder, exist_ok=True)
        sizes = dict(zip(done.written_files, done.sizes, strict=False))
        for name, size in sizes.items():
            os.truncate(os.path.join(self.folder, name), size)
        out: TextIO | None = None
        at = (done.file, done.pos, done.ts)
        rows = statements.select("file", "file_ord", "pos", "row_no", "trx_id", "info", "sql", "binlog", "end_pos", "ts").orderBy("file_ord", "pos", "row_no").toLocalIterator()
        opened: dict[str, TextIO] = {}
        event = None
        try:
            for r in rows:
                name = r["file"]
                out = opened.get(name)
                if out is None:
                    out = opened[name] = open(os.path.join(self.folder, name), "a" if name in sizes else "w", encoding="utf-8", newline="")  # noqa: SIM115
                    if name not in sizes:
                        print(HEADER, file=out)
                if self.info and (r["file_ord"], r["pos"]) != event:
                    print(r["info"], file=out)
                event = (r["file_ord"], r["pos"])
                print(r["sql"], file=out)
                at = (r["binlog"], r["end_pos"], str(r["ts"]))
            for name, f in opened.items():
                f.flush()
                os.fsync(f.fileno())
                sizes[name] = f.tell()
        finally:
            for f in opened.values():
                f.close()
        write_checkpoint(Checkpoint(*at, tuple(sizes), number, tuple(sizes.values())), self.checkpoint)


def write_parts(statements: DataFrame, path: str, undo: bool = False, info: bool = False, keep_trx: bool = True, mode: str = "errorifexists") -> None:
    """Text files under ``path``/file=..., written by the executors in parallel: each part file holds an ordered stretch.

    The parts of a file one after another, in name order, are the text of :func:`write_sql`: each line hangs on its row and
    the one before it alone, and those of the two ends of a file are added to its first and last row.
    """
    key = ("file_ord", "pos", "row_no")
    order = [F.desc(c) if undo else F.asc(c) for c in key]
    ends = statements.groupBy("file").agg(*(f(F.struct(*key)).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))))
    rows = undo_order(statements, "file") if undo else statements.withColumn("new_trx", F.lit(False))
    # of an event, the row that comes first (in an undo the last row of the log)
    of_event = statements.groupBy("file", "file_ord", "pos").agg((F.max if undo else F.min)("row_no").alias("info_row")) if info else None
    rows = rows.join(ends, "file")
    if of_event is not None:
        rows = rows.join(of_event, ["file", "file_ord", "pos"])
    here, first, last = F.struct(*key), F.col("most" if undo else "least"), F.col("least" if undo else "most")
    parts = F.array(
        F.when(here == first, F.lit(HEADER)),
        F.when(F.col("new_trx") & F.lit(undo and keep_trx), F.lit("commit;\nbegin;")),
        F.when(F.col("row_no") == F.col("info_row"), F.col("info")) if info else F.lit(None).cast("string"), F.col("sql"),
        F.when((here == last) & F.lit(undo and keep_trx), F.lit("commit;")),
    )
    rows = rows.withColumn("value", F.array_join(parts, "\n")).repartitionByRange("file", *order).sortWithinPartitions("file", *order)
    rows.select("file", "value").write.mode(mode).partitionBy("file").text(path)


def write_reports(lines: DataFrame, big: DataFrame, folder: str, skipped: int, as_json: bool) -> None:
    os.makedirs(folder, exist_ok=True)
    tail = f"# skipped events: {skipped}"
    jsonl = []
    try:
        for frame, name, header in ((lines, "binlog_status", STATUS_HEADER), (big, "biglong_trx", BIG_LONG_HEADER)):
            write_lines([header], os.path.join(folder, name + ".txt"))
            with open(os.path.join(folder, name + ".txt"), "a", encoding="utf-8", newline="") as f:
                f.writelines(r["line"] + "\n" for r in frame.select("line").toLocalIterator())
                f.write(tail + "\n")
            if as_json:
                jsonl.append(os.path.join(folder, name + ".jsonl"))
                write_lines((r["json"] for r in frame.select("json").toLocalIterator()), jsonl[-1])
    except BaseException:
        for path in jsonl:  # whole or not at all
            os.remove(path)
        raise
