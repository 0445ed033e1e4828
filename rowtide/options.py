"""Options of the four modes: their defaults, ranges and what excludes what."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta, timezone

DML = ("insert", "update", "delete")
U32 = 2**32 - 1


class OptionError(ValueError):
    """Options that can't be carried out."""


def parse_time_zone(text: str | None) -> int:
    """Offset in seconds: +HH:MM, or UTC, GMT, Z (zero), or SYSTEM, LOCAL (the machine's own)."""
    if text is None or text.upper() in ("UTC", "GMT", "Z"):
        return 0
    if text.upper() in ("SYSTEM", "LOCAL"):
        return int((datetime.now(UTC).astimezone().utcoffset() or timedelta()).total_seconds())
    m = re.fullmatch(r"([+-])(\d{1,2}):(\d{2})", text)
    if not m or int(m[2]) > 14 or int(m[3]) > 59:
        raise OptionError(f"time zone {text!r} is not +HH:MM, UTC or SYSTEM")
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3]) * 60)


def parse_datetime(text: str | None, offset: int) -> int | None:
    if text is None:
        return None
    try:
        at = datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone(timedelta(seconds=offset)))
    except ValueError:
        raise OptionError(f"datetime {text!r} is not YYYY-MM-DD HH:MM:SS") from None
    return max(0, int(at.timestamp()))


@dataclass(frozen=True)
class Options:
    """One run. ``work`` is to-sql, flashback, stats or repl; ``check`` (called when made) rejects what can't be carried out."""

    work: str = "to-sql"
    binlog_dir: str = ""
    start_file: str = ""
    start_pos: int = 4
    stop_file: str | None = None
    stop_pos: int | None = None
    start_datetime: str | None = None
    stop_datetime: str | None = None
    db: tuple[str, ...] = ()
    table: tuple[str, ...] = ()
    ignore_db: tuple[str, ...] = ()
    ignore_table: tuple[str, ...] = ()
    dml: tuple[str, ...] = ()
    uri: str | None = None
    schema_file: str | None = None
    schema_dump: str | None = None
    output_dir: str | None = None
    to_stdout: bool = False
    file_per_table: bool = False
    time_zone: str | None = None
    threads: int = 0  # 0: as Spark has them
    add_extra_info: bool = False
    no_db_prefix: bool = False
    full_columns: bool = False
    unique_key_first: bool = False
    ignore_primary_key_for_insert: bool = False
    strict_schema: bool = False
    insert_batch: int = 1
    on_error: str | None = None
    keep_trx: bool = True
    report_file: str | None = None
    dry_run: bool = False
    print_interval: int = 30
    big_trx_rows: int = 10
    long_trx_seconds: int = 1
    stats_json: bool = False
    server_id: int | None = None
    resume_file: str | None = None
    heartbeat_secs: int = 30
    split_bytes: int = 32 << 20
    max_event_bytes: int = 4 << 20  # a larger event is taken as damage
    strict_parity: bool = False
    offset: int = field(init=False, default=0)
    start_ts: int | None = field(init=False, default=None)
    stop_ts: int | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("offset", parse_time_zone(self.time_zone))
        put("start_ts", parse_datetime(self.start_datetime, self.offset))
        put("stop_ts", parse_datetime(self.stop_datetime, self.offset))
        for k in ("db", "table", "ignore_db", "ignore_table", "dml"):
            v = getattr(self, k)
            put(k, tuple(x for x in v.split(",") if x) if isinstance(v, str) else tuple(v))
        if self.on_error is None:
            put("on_error", "stop" if self.work == "flashback" else "skip-bad-event")
        self.check()

    def check(self) -> None:
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise OptionError(why)

        need(self.work in ("to-sql", "flashback", "stats", "repl"), f"unknown mode {self.work!r}")
        need(self.on_error in ("skip-bad-event", "stop"), "on_error is skip-bad-event or stop")
        need(bool(self.binlog_dir), "binlog_dir is required")
        need(bool(self.start_file) or self.work == "repl", "start_file is required")
        need(bool(self.uri or self.schema_file), "uri or schema_file is required")
        need(set(self.dml) <= set(DML), f"dml is among {', '.join(DML)}")
        need(self.threads >= 0, "threads is 1 at least")
        need(self.max_event_bytes >= 19, "max_event_bytes is 19 at least")
        need(self.insert_batch >= 1, "insert_batch is 1 at least")
        need(4 <= self.start_pos <= U32, "start_pos is 4 at least")
        need(self.stop_pos is None or 4 <= self.stop_pos <= U32, "stop_pos is 4 at least")
        if self.start_ts is not None and self.stop_ts is not None:
            need(self.start_ts < self.stop_ts, "start_datetime must be before stop_datetime")
        if self.stop_pos is not None and self.stop_file in (None, self.start_file):
            need(self.stop_pos > self.start_pos, "stop_pos must be behind start_pos in the same file")
        if self.work == "to-sql":
            need(self.on_error != "stop", "to-sql skips bad events; on_error=stop is for flashback")
        if self.work in ("flashback", "stats"):
            need(not self.to_stdout, f"{self.work} writes files, not to stdout")
        if self.work == "stats":
            need(1 <= self.print_interval <= 600, "print_interval is 1 to 600")
            need(1 <= self.big_trx_rows <= 30_000, "big_trx_rows is 1 to 30000")
            need(0 <= self.long_trx_seconds <= 3600, "long_trx_seconds is 0 to 3600")
        if self.work == "repl":
            need(self.server_id is not None and 1 <= self.server_id <= U32, "server_id is required")
            need(0 <= self.heartbeat_secs <= 3600, "heartbeat_secs is 0 to 3600")
            need(bool(self.output_dir) or self.to_stdout, "an output directory or stdout is required")
            if self.resume_file:
                need(not self.start_file and self.start_ts is None, "resume_file excludes start positions and times")
                need(not self.to_stdout, "resume_file excludes stdout")

    def reader(self) -> dict[str, str]:
        """Options of the binlog source; bounds and lists are applied as it reads."""
        out = {"path": self.binlog_dir, "mode": "FAILFAST" if self.on_error == "stop" else "PERMISSIVE", "strictParity": str(self.strict_parity).lower()}
        for key, value in (("startFile", self.start_file), ("startPos", self.start_pos), ("stopFile", self.stop_file), ("stopPos", self.stop_pos), ("startTs", self.start_ts), ("stopTs", self.stop_ts), ("schemaFile", self.schema_file), ("db", ",".join(self.db)), ("table", ",".join(self.table)), ("ignoreDb", ",".join(self.ignore_db)), ("ignoreTable", ",".join(self.ignore_table)), ("dml", ",".join(self.dml)), ("maxEventBytes", self.max_event_bytes)):
            if value not in (None, ""):
                out[key] = str(value)
        return out

    @property
    def undo(self) -> bool:
        return self.work == "flashback"
