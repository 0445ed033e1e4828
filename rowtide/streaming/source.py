"""The log as a stream: offsets are places between transactions, and so no micro-batch splits one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from ..sources import wire
from ..sources.events import Images, frames, keyword, name_key, read_log
from ..sources.files import list_logs, open_log


@dataclass
class Piece(InputPartition):
    path: str
    name: str
    file_ord: int
    start: int
    end: int
    trx: int
    run: int


def commit_points(path: str, start: int, most: int, max_event: int = wire.MAX_EVENT) -> Iterator[tuple[int, int, int]]:
    """(place, transactions, BEGINs since ``start``) behind each commit, of whole events only, up to about ``most`` bytes on."""
    trx = run = 0
    open_trx = False
    with open_log(path) as f:
        if f.read(4) != wire.MAGIC:
            return
        try:
            for at, h, body in frames(f, max(4, start), None, max_event):
                end = at + h.size
                if h.type == wire.QUERY:
                    word = keyword(wire.parse_query(body()[wire.HEADER_SIZE :])[1])
                    ended = word.startswith(("commit", "rollback"))
                    begun = word.startswith("begin") and len(word) <= 9  # a checksum may follow the text
                    trx += bool(word) and not ended
                    run += begun
                    open_trx = begun or (open_trx and not ended)
                elif h.type == wire.XID:
                    open_trx = False
                elif h.type in (wire.TABLE_MAP, *wire.ROWS):
                    open_trx = True
                f.seek(0, 2)
                if f.tell() < end:
                    return
                f.seek(end)
                if not open_trx:
                    yield end, trx, run
                    if end - start >= most:
                        return
        except wire.LogError:
            return  # what is there of the last event is read again later


class BinlogStreamReader(DataSourceStreamReader):
    """Options as of the batch source, and maxBytesPerTrigger. Stop bounds end the stream: later batches are empty.

    Spark doesn't say where it resumes when it first asks for the latest offset, so the first batch after a start takes
    all there is (a partition a file); the limit holds from then on.
    """

    def __init__(self, options: dict, view: str, images: Images | None):
        from ..sources.binlog import bounds_of

        self.options, self.view, self.images = dict(options), view, images
        self.bounds = bounds_of(self.options)
        self.most = int(options.get("maxBytesPerTrigger", 256 << 20))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        start = self.bounds.start
        return {"file": start[0] if start else "", "pos": 4, "trx": 0, "run": 0}

    def logs(self, start: str) -> list[tuple[str, str]]:
        return [x for x in list_logs(self.options["path"], self.bounds.start[0] if self.bounds.start else None) if name_key(x[0]) >= name_key(start)]

    def latestOffset(self) -> dict:
        at = dict(self.last or self.initialOffset())
        begin, taken = dict(at), 0
        most = self.most if self.last else 1 << 62
        for name, path in self.logs(at["file"]):
            if name != at["file"]:
                at = {**at, "file": name, "pos": 4}
            base = (at["trx"], at["run"])
            from_ = at["pos"]
            for end, trx, run in commit_points(path, from_, most - taken, self.bounds.max_event):
                at = {"file": name, "pos": end, "trx": base[0] + trx, "run": base[1] + run}
            taken += at["pos"] - from_
            if taken >= most:
                break
        self.last = at
        return at if at != begin else begin

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        trx, run = start["trx"], start["run"]
        for i, (name, path) in enumerate(self.logs(start["file"])):
            if name_key(name) > name_key(end["file"]):
                break
            a = start["pos"] if name == start["file"] else 4
            if name == end["file"]:
                b, then = end["pos"], (trx, run)
            else:
                points = list(commit_points(path, a, 1 << 62, self.bounds.max_event))
                b, then = (points[-1][0], (trx + points[-1][1], run + points[-1][2])) if points else (a, (trx, run))
            if b > a:
                out.append(Piece(path, name, i, a, b, trx, run))
            trx, run = then
        return out

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        from ..sources.binlog import emit

        with open_log(part.path) as f:
            yield from emit(((e, 0) for e in read_log(f, part.name, part.file_ord, self.bounds, part.start, part.end, trx=part.trx, run=part.run)), self.view, self.images)

    def commit(self, end: dict) -> None:
        pass


def offset_text(offset: dict) -> str:
    return json.dumps(offset, sort_keys=True)
