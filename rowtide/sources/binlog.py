"""``spark.read.format("binlog")``: logs of a folder as events or as row changes.

Options: path (folder), startFile, startPos, stopFile, stopPos, startTs, stopTs (seconds), db, table, ignoreDb,
ignoreTable, dml (comma-separated), schemaFile (catalog JSON), view (events, changes or facts), splitBytes (0: a
partition a file), maxEventBytes (a larger event is taken as damage, which ends its file with an error; 4 MiB), strictParity (only the latest table map counts), mode (PERMISSIVE or FAILFAST).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .catalog import columns_of, read_catalog
from . import wire
from .cells import ImageColumn
from .events import Bounds, Event, Images, boundaries, name_key, read_log
from .files import open_log, sized_logs

CELL = "struct<tag:string,txt:string,bin:binary>"
EVENTS = "file_ord int, binlog string, start_pos long, end_pos long, pos long, ts long, type int, kind string, op string, db string, tb string, sql string, n_log int, split int, trx long, run long, error string"
CHANGES = f"{EVENTS}, row_no int, before array<{CELL}>, after array<{CELL}>"
FACTS = f"{EVENTS}, rows long"
VIEWS = {"events": EVENTS, "changes": CHANGES, "facts": FACTS}
SCALARS = [("file_ord", pa.int32()), ("binlog", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("pos", pa.int64()), ("ts", pa.int64()), ("type", pa.int32()), ("kind", pa.string()), ("op", pa.string()), ("db", pa.string()), ("tb", pa.string()), ("sql", pa.string()), ("n_log", pa.int32()), ("split", pa.int32()), ("trx", pa.int64()), ("run", pa.int64()), ("error", pa.string())]
BATCH_ROWS, BATCH_CELLS = 8192, 200_000
#: A task reads stretches one after another, up to so many bytes: a share of all of them within these two bounds.
SHARES, LEAST_SHARE, MOST_SHARE = 200, 256 << 10, 32 << 20
#: Tasks that hop headers, at most.
HOPS = 200


@dataclass
class Stretch:
    path: str
    name: str
    file_ord: int
    split: int
    start: int
    end: int | None
    trx: int = 0
    run: int = 0


@dataclass
class Share(InputPartition):
    """What one task reads: stretches in the order of the logs."""

    stretches: list[Stretch]


def shares(stretches: list[Stretch], sizes: list[int]) -> list[Share]:
    """Neighbours together, so that tasks grow with the bytes and not with the number of logs and cut points."""
    most = min(max(sum(sizes) // SHARES, LEAST_SHARE), MOST_SHARE)
    out: list[Share] = []
    room = 0
    for stretch, size in zip(stretches, sizes, strict=True):
        if not out or size > room:
            out.append(Share([]))
            room = most
        out[-1].stretches.append(stretch)
        room -= size
    return out


def listed(value: str | None) -> tuple[str, ...]:
    return tuple(x for x in (value or "").split(",") if x)


def bounds_of(o: dict) -> Bounds:
    o = {k.lower(): v for k, v in o.items()}
    start_file, stop_file, stop_pos = o.get("startfile"), o.get("stopfile"), o.get("stoppos")
    start = (start_file, int(o.get("startpos", 4))) if start_file else None
    stop = (stop_file or start_file or "", int(stop_pos or 2**32 - 1)) if stop_file or stop_pos else None
    whole = {k: int(o[k.lower()]) for k in ("startTs", "stopTs") if o.get(k.lower()) is not None}
    return Bounds(start, stop, whole.get("startTs"), whole.get("stopTs"), listed(o.get("db")), listed(o.get("table")), listed(o.get("ignoredb")), listed(o.get("ignoretable")), listed(o.get("dml")), int(o.get("maxeventbytes") or wire.MAX_EVENT))


class Batches:
    """Arrow batches of one view. An event's own columns are made once and repeated for its rows."""

    def __init__(self, view: str, images: Images | None):
        self.view, self.images = view, images
        self.clear()

    def clear(self) -> None:
        self.events: list[tuple] = []
        self.rows: list[int] = []  # of each event, one at least
        self.changed: list[int] = []  # row images of each event
        self.before, self.after = ImageColumn(), ImageColumn()

    def add(self, e: Event, split: int) -> None:
        error, n = e.error, 0
        if self.view != "events" and e.kind == "rows" and self.images:
            n, error = self.images.into(e, self.before, self.after)
        if self.view == "facts":  # only the number is wanted
            self.before, self.after = ImageColumn(), ImageColumn()
        elif not n:
            self.before.add(None)
            self.after.add(None)
        self.events.append((e.file_ord, e.binlog, e.start_pos, e.end_pos, e.pos, e.ts, e.type, e.kind, e.op, e.db, e.tb, e.sql, e.n_log, split, e.trx, e.run, error))
        self.changed.append(n)
        self.rows.append(n if n and self.view == "changes" else 1)

    @property
    def full(self) -> bool:
        return len(self.events) >= BATCH_ROWS or len(self.before.sizes) >= BATCH_ROWS or len(self.before.tags) + len(self.after.tags) >= BATCH_CELLS

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*self.events, strict=True), SCALARS, strict=True)]
        names = [n for n, _ in SCALARS]
        if self.view == "changes":
            counts, changed = np.array(self.rows), np.array(self.changed)
            if counts.max() > 1:
                event = pa.array(np.repeat(np.arange(len(counts)), counts))
                columns = [c.take(event) for c in columns]
            row = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            columns += [pa.array(row.astype(np.int32), mask=np.repeat(changed == 0, counts)), images_column(self.before), images_column(self.after)]
            names += ["row_no", "before", "after"]
        elif self.view == "facts":
            columns.append(pa.array([n if e[7] == "rows" else None for n, e in zip(self.changed, self.events, strict=True)], pa.int64()))
            names.append("rows")
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names)


def images_column(images: ImageColumn) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(images.tags, pa.string()), pa.array(images.texts, pa.string()), pa.array(images.raws, pa.binary())], ["tag", "txt", "bin"])
    sizes = np.array([-1 if n is None else n for n in images.sizes])
    offsets = np.cumsum(np.r_[0, np.maximum(sizes, 0)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.r_[sizes < 0, False]), values)


def emit(events: Iterator[tuple[Event, int]], view: str, images: Images | None) -> Iterator[pa.RecordBatch]:
    """Of events with the numbers of their stretches."""
    out = Batches(view, images)
    for e, split in events:
        out.add(e, split)
        if out.full:
            yield out.batch()
    if out.events:
        yield out.batch()


class BinlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binlog"

    @property
    def view(self) -> str:
        view = self.options.get("view", "events")
        if view not in VIEWS:
            raise ValueError(f"view must be one of {', '.join(VIEWS)}")
        return view

    def schema(self) -> str:
        return VIEWS[self.view]

    def images(self) -> Images | None:
        if self.view == "events":
            return None
        path, inline = self.options.get("schemaFile"), self.options.get("schemaJson")
        if not (path or inline):
            raise ValueError("schemaFile or schemaJson is needed to decode rows")
        return Images(columns_of(json.loads(inline) if inline else read_catalog(path)))

    def reader(self, schema: StructType) -> DataSourceReader:
        reader = BinlogReader(self.options, self.view, self.images())
        # tasks are sent the source too, and cut points of all logs are nothing to them
        self.options = {k: v for k, v in dict(self.options).items() if k.lower() != "ranges"}
        return reader

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        from ..streaming.source import BinlogStreamReader

        return BinlogStreamReader(self.options, self.view, self.images())


class BinlogReader(DataSourceReader):
    def __init__(self, options: dict, view: str, images: Images | None):
        self.options, self.view, self.images = dict(options), view, images
        self.bounds = bounds_of(self.options)
        self.strict = str(options.get("strictParity", "false")).lower() == "true"
        self.fail_fast = str(options.get("mode", "PERMISSIVE")).upper() == "FAILFAST"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"options": {k: v for k, v in self.options.items() if k.lower() != "ranges"}}

    def logs(self) -> list[tuple[str, str, int]]:
        """(name, path, length) in order, only those within the window: with a start file and no stop, that file and all later ones of its base."""
        b = self.bounds
        found = sized_logs(self.options["path"], b.start[0] if b.start else None)
        if b.start:
            found = [x for x in found if name_key(x[0]) >= name_key(b.start[0])]
            if not found or found[0][0] != b.start[0]:
                raise FileNotFoundError(f"{b.start[0]} is not in {self.options['path']}")
        if b.stop:
            found = [x for x in found if name_key(x[0]) <= name_key(b.stop[0])]
        return found

    def partitions(self) -> list[Share]:
        """With ``ranges``, transactions and BEGINs are counted on from one stretch to the next, over all files; else within each stretch."""
        ranges = json.loads(self.options["ranges"]) if self.options.get("ranges") else {}
        out, sizes, trx, run = [], [], 0, 0
        for i, (name, path, length) in enumerate(self.logs()):
            cuts, begun, runs = ranges.get(name) or ([], [0], [0])
            if self.bounds.stop_ts is not None:  # take-while by time needs a file in order
                cuts, begun, runs = [], [sum(begun)], [sum(runs)]
            places = [4, *cuts]
            for k, (a, b) in enumerate(zip(places, [*places[1:], None], strict=True)):
                out.append(Stretch(path, name, i, k, a, b, trx, run))
                sizes.append(max((length if b is None else b) - a, 0))
                trx, run = trx + begun[k], run + runs[k]
        return shares(out, sizes)

    def events(self, share: Share) -> Iterator[tuple[Event, int]]:
        for part in share.stretches:
            with open_log(part.path) as f:
                for e in read_log(f, part.name, part.file_ord, self.bounds, part.start, part.end, self.strict, self.fail_fast, part.trx, part.run):
                    yield e, part.split

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        if share is not None:  # no logs: Spark asks once all the same
            yield from emit(self.events(share), self.view, self.images)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinlogSource)


def plan_ranges(spark: SparkSession, options: dict, split_bytes: int) -> str:
    """Cut points of the window's logs and what each stretch counts, as the ``ranges`` option; found by a job that hops headers, a file by one task."""
    bounds = bounds_of(options)
    logs = BinlogReader(options, "events", None).logs()
    if not logs:
        return "{}"
    frame = spark.createDataFrame([x[:2] for x in logs], "name string, path string").repartition(min(len(logs), HOPS))
    schema = "name string, cuts array<long>, trx array<long>, run array<long>"

    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found = b.column("name").to_pylist(), []
            for name, p in zip(names, b.column("path").to_pylist(), strict=True):
                with open_log(p) as f:
                    found.append(boundaries(f, split_bytes, name, bounds))
            lists = [pa.array([getattr(x, c) for x in found], pa.list_(pa.int64())) for c in ("cuts", "trx", "run")]
            yield pa.RecordBatch.from_arrays([pa.array(names), *lists], ["name", "cuts", "trx", "run"])

    return json.dumps({r["name"]: [r["cuts"], r["trx"], r["run"]] for r in frame.mapInArrow(hop, schema).collect()})
