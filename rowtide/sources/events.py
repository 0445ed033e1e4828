"""Events of one log (or a stretch of it) in order, as the data source and the stream source emit them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

from . import wire
from .cells import Cell, ImageColumn, RowReader
from .wire import LogError, TooShort, Unsupported


#: Table maps that a decoder remembers by their bytes.
KNOWN_MAPS = 4096


@dataclass(frozen=True)
class Bounds:
    """Window and lists that are applied while reading; names compare by (base, number)."""

    start: tuple[str, int] | None = None
    stop: tuple[str, int] | None = None
    start_ts: int | None = None
    stop_ts: int | None = None
    db: tuple[str, ...] = ()
    table: tuple[str, ...] = ()
    ignore_db: tuple[str, ...] = ()
    ignore_table: tuple[str, ...] = ()
    dml: tuple[str, ...] = ()
    max_event: int = wire.MAX_EVENT

    def stopped(self, name: str, end: int, ts: int) -> bool:
        return bool(self.stop and (name_key(name), end) >= (name_key(self.stop[0]), self.stop[1])) or (self.stop_ts is not None and ts >= self.stop_ts)

    def pending(self, name: str, end: int, ts: int) -> bool:
        return bool(self.start and (name_key(name), end) < (name_key(self.start[0]), self.start[1])) or (self.start_ts is not None and ts < self.start_ts)

    def wants(self, op: str, db: str, tb: str) -> bool:
        def named(entries: tuple[str, ...]) -> bool:
            return any((e.partition(".")[0] == db and e.partition(".")[2] == tb) if "." in e else e == tb for e in entries)

        return not ((self.dml and op not in self.dml) or (self.db and db not in self.db) or (self.table and not named(self.table)) or db in self.ignore_db or named(self.ignore_table))


def name_key(name: str) -> tuple[str, int]:
    """Logs order by base name, then by their number; a name without one comes before all of its base."""
    base, dot, number = name.rpartition(".")
    return (base, int(number)) if dot and number.isascii() and number.isdigit() else (name, -1)


@dataclass(slots=True)
class Event:
    file_ord: int
    binlog: str
    start_pos: int
    end_pos: int
    pos: int  # where the event itself begins in the file
    ts: int
    type: int
    kind: str  # query, xid, gtid, rotate, rows, other, error
    op: str | None = None
    db: str | None = None
    tb: str | None = None
    sql: str | None = None
    v2: bool | None = None
    n_log: int | None = None
    trx: int = 0  # transactions begun in this stretch, up to and with this event
    run: int = 0  # BEGINs likewise
    error: str | None = None
    table: wire.TableMap | None = None
    body: bytes = b""


def keyword(sql: str) -> str:
    return sql.strip().rstrip(";").strip().lower()


def frames(f: BinaryIO, start: int, end: int | None, max_event: int = wire.MAX_EVENT) -> Iterator[tuple[int, wire.Header, Callable[[], bytes]]]:
    """(place, header, body reader) from ``start`` up to ``end``; a body that isn't read is skipped."""
    f.seek(start)
    at = start
    while end is None or at < end:
        raw = f.read(wire.HEADER_SIZE)
        if not raw:
            return
        if len(raw) < wire.HEADER_SIZE:
            raise TooShort("the file ends within an event header")
        h = wire.parse_header(raw, max_event)
        got: list[bytes] = []

        def body(h: wire.Header = h, raw: bytes = raw, got: list[bytes] = got) -> bytes:
            if not got:
                got.append(f.read(h.size - wire.HEADER_SIZE))
                if len(got[0]) < h.size - wire.HEADER_SIZE:
                    raise TooShort("the file ends within an event")
            return raw + got[0]

        yield at, h, body
        at += h.size
        if not got:
            f.seek(at)


class Decoder:
    """Turns frames into events; keeps what the log's order means: checksums, table maps, counters, the current name."""

    def __init__(self, name: str, file_ord: int, bounds: Bounds, strict: bool = False, trx: int = 0, run: int = 0):
        self.name, self.file_ord, self.bounds, self.strict = name, file_ord, bounds, strict
        self.crc: bool | None = None
        self.maps: dict[int, tuple[wire.TableMap, int]] = {}
        self.known: dict[bytes, wire.TableMap] = {}
        self.trx, self.run, self.done = trx, run, False

    def feed(self, at: int, h: wire.Header, body: Callable[[], bytes]) -> Event | None:
        if self.bounds.stopped(self.name, h.log_pos, h.ts):
            self.done = True
            return None
        frame = body()
        if h.type == wire.FORMAT:
            self.crc = wire.parse_format(frame)
            return None
        if self.crc is None:
            raise LogError("an event before any format description")
        artificial = h.type == wire.ROTATE and h.log_pos == 0
        data = frame[wire.HEADER_SIZE :]
        if self.crc and not artificial:
            if not wire.crc_ok(frame):
                raise wire.ChecksumMismatch
            data = data[:-4]
        pending = self.bounds.pending(self.name, h.log_pos, h.ts)
        if h.type == wire.TABLE_MAP:
            table = self.known.get(data)
            if table is None:
                if len(self.known) >= KNOWN_MAPS:
                    self.known.clear()
                table = self.known[data] = wire.parse_table_map(data)
            if self.strict:  # only the latest map counts
                self.maps.clear()
            self.maps[table.table_id] = (table, h.start)
            return None
        if pending or h.type == wire.PREVIOUS_GTIDS:
            return None
        at = (self.file_ord, self.name, h.start, h.log_pos, at, h.ts, h.type)
        if h.type in wire.ROWS:
            return self.rows_event(at, h, data)
        kind, db, sql = "other", None, None
        if h.type == wire.QUERY:
            kind = "query"
            db, sql = wire.parse_query(data)
            word = keyword(sql)
            self.trx += word not in ("", "commit", "rollback")
            self.run += word == "begin"
        elif h.type == wire.XID:
            kind = "xid"
        elif h.type in (wire.GTID, wire.ANONYMOUS_GTID):
            kind = "gtid"
        elif h.type == wire.ROTATE:
            if len(data) < 8:
                raise TooShort
            kind, sql = "rotate", data[8:].decode("utf-8", "replace")
            self.name = sql  # later events carry the new name
        elif h.type in (20, 21, 22):
            raise LogError("rows events of version 0 are not supported")
        elif h.type == wire.PARTIAL_UPDATE:
            raise Unsupported("partial row updates are not supported")
        return Event(*at, kind, db=db, sql=sql, trx=self.trx, run=self.run)

    def rows_event(self, at: tuple, h: wire.Header, data: bytes) -> Event | None:
        op, v2 = wire.ROWS[h.type]
        if not self.maps:
            raise LogError("a rows event before any table map")
        table_id = int.from_bytes(data[:6], "little")
        table, start = self.maps.get(table_id) or next(reversed(self.maps.values()))
        if not self.bounds.wants(op, table.db, table.tb):
            return None
        return Event(at[0], at[1], start, *at[3:], "rows", op, table.db, table.tb, None, v2, len(table.types), self.trx, self.run, None, table, data)


def read_log(f: BinaryIO, name: str, file_ord: int, bounds: Bounds, start: int = 4, end: int | None = None, strict: bool = False, fail_fast: bool = False, trx: int = 0, run: int = 0) -> Iterator[Event]:
    """Events of a file, or of a stretch that begins between transactions. A damaged file ends with one error event.

    A file that isn't a log, and partial updates, raise whatever the error mode.
    """
    if f.read(4) != wire.MAGIC:
        raise LogError(f"{name}: not a binlog file")
    decoder = Decoder(name, file_ord, bounds, strict, trx, run)
    at = start
    try:
        if start > 4:  # the stretch needs the file's checksum flag
            for _, h, body in frames(f, 4, None):
                if h.type == wire.FORMAT:
                    decoder.crc = wire.parse_format(body())
                break
        for at, h, body in frames(f, start, end, bounds.max_event):
            event = decoder.feed(at, h, body)
            if decoder.done:
                return
            if event:
                yield event
    except Unsupported:
        raise
    except LogError as e:
        if fail_fast:
            raise
        yield Event(file_ord, name, at, at, at, 0, 0, "error", trx=decoder.trx, run=decoder.run, error=f"{e.code}: {e}")


class Images:
    """Row images of rows events by the columns that the catalog has for their tables."""

    def __init__(self, catalog: dict[tuple[str, str], list[tuple[str, bool]]]):
        self.catalog = catalog
        self.readers: dict[wire.TableMap, RowReader] = {}

    def rows(self, e: Event) -> tuple[list[tuple[list[Cell] | None, list[Cell] | None]], str | None]:
        """The event's rows as (before, after), or an error."""
        before, after = ImageColumn(), ImageColumn()
        n, error = self.into(e, before, after)
        return list(zip(before.images(), after.images(), strict=True)) if n else [], error

    def into(self, e: Event, before: ImageColumn, after: ImageColumn) -> tuple[int, str | None]:
        """Adds the event's row images to the two columns: the number of rows, or an error (no schema, or bytes that don't decode)."""
        assert e.table
        reader = self.readers.get(e.table)
        if reader is None:
            columns = self.catalog.get((e.table.db, e.table.tb))
            if columns is None:
                return 0, f"no_schema: no schema for `{e.table.db}`.`{e.table.tb}`"
            reader = self.readers[e.table] = RowReader(e.table, columns)
        try:
            return reader.into(e.body, e.op or "", bool(e.v2), before, after), None
        except LogError as err:
            return 0, f"{err.code}: {err}"
        except RecursionError:
            return 0, "invalid_data: nested too deep"


@dataclass
class Stretches:
    """Places of one log between transactions, and the transactions and BEGINs that each stretch between them has."""

    cuts: list[int]
    trx: list[int]
    run: list[int]


def boundaries(f: BinaryIO, every: int = 0, name: str = "", bounds: Bounds | None = None) -> Stretches:
    """Stretches of about ``every`` bytes (0: one), found by hopping from header to header; only bodies of statements are read.

    Counted is what a :class:`Decoder` counts within the same bounds. A damaged log ends with what is there.
    """
    out, last, open_trx, crc = Stretches([], [0], [0]), 4, False, False
    f.seek(0)
    if f.read(4) != wire.MAGIC:
        return out
    bounds = bounds or Bounds()
    try:
        for at, h, body in frames(f, 4, None, bounds.max_event):
            if bounds.stopped(name, h.log_pos, h.ts):
                break
            if every and at - last >= every and not open_trx:
                out.cuts.append(at)
                out.trx.append(0)
                out.run.append(0)
                last = at
            if h.type == wire.FORMAT:
                crc = wire.parse_format(body())
            elif h.type == wire.QUERY:
                data = body()[wire.HEADER_SIZE :]
                word = keyword(wire.parse_query(data[:-4] if crc else data)[1])
                open_trx = word == "begin" or (open_trx and word not in ("commit", "rollback"))
                if not bounds.pending(name, h.log_pos, h.ts):
                    out.run[-1] += word == "begin"
                    out.trx[-1] += word not in ("", "commit", "rollback")
            elif h.type == wire.XID:
                open_trx = False
            elif h.type in (wire.TABLE_MAP, *wire.ROWS):
                open_trx = True
    except LogError:
        pass  # the reader of the last stretch reports it
    return out
