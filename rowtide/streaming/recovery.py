"""Where a stream starts, how it is resumed, and which failures end it."""

from __future__ import annotations

import json
import os
import random
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Checkpoint:
    """The last commit whose output is written, and the files that hold it."""

    file: str
    pos: int
    ts: str
    written_files: tuple[str, ...] = field(default=())
    #: The last whole batch, and how long each file was behind it.
    batch: int = -1
    sizes: tuple[int, ...] = field(default=())


class CheckpointError(ValueError):
    pass


def is_single_file_name(name: str) -> bool:
    return bool(name) and name not in (".", "..") and not re.search(r"[/\\\0]", name)


def write_checkpoint(cp: Checkpoint, path: str) -> None:
    """Whole or not at all: a new file that is forced to disk takes the old one's name."""
    tmp = path + ".tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(asdict(cp), f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def read_checkpoint(path: str, folder: str) -> tuple[Checkpoint, list[str]]:
    """The checkpoint, and files of the folder that it doesn't know; a file that it names must be there."""
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        cp = Checkpoint(raw["file"], int(raw["pos"]), raw["ts"], tuple(raw["written_files"]), int(raw.get("batch", -1)), tuple(raw.get("sizes", ())))
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise CheckpointError(f"{path} is no checkpoint: {e}") from None
    for name in (cp.file, *cp.written_files):
        if not is_single_file_name(name):
            raise CheckpointError(f"{name!r} is not the name of a file")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    if missing := sorted(set(cp.written_files) - there):
        raise CheckpointError(f"missing output files: {', '.join(missing)}")
    return cp, sorted(n for n in there - set(cp.written_files) if n.endswith(".sql"))


def locate(resume: Checkpoint | None, file: str, pos: int, ts: int | None) -> tuple[str, object]:
    """(how, from where): a checkpoint before a time before a given file before the present end."""
    if resume is not None:
        return "checkpoint", (resume.file, resume.pos)
    if ts is not None:
        return "datetime", ts
    return ("position", (file, pos)) if file else ("now", None)


def bisect_file(n: int, want: int, first_ts: Callable[[int], int | None]) -> int | None:
    """The last of n files whose first event isn't later than ``want``; the first, if all are. Files without events are passed over."""
    if not n:
        return None
    low, high, best = 0, n - 1, 0
    while low <= high:
        mid = (low + high) // 2
        probe, ts = mid, first_ts(mid)
        while ts is None and probe > low:
            probe -= 1
            ts = first_ts(probe)
        if ts is not None and ts <= want:
            best, low = probe if probe > best else best, mid + 1
        else:
            high = probe - 1
    return best


def backoff_seconds(attempt: int, unit: float | None = None) -> float:
    """1, 2, 4 ... at most 30 seconds, a quarter more or less; ``unit`` in 0..1 stands for chance."""
    base = min(30.0, 2.0 ** min(attempt, 10))
    return base * (0.75 + 0.5 * (random.random() if unit is None else unit))


#: Server error numbers that no retry mends, and what they mean.
TERMINAL = {1236: "purged", 1045: "auth", 1227: "privilege", 1142: "privilege", 1044: "privilege"}


def classify(code: int | None, message: str) -> tuple[str, str]:
    """(terminal or retry, reason)."""
    low = message.lower()
    if code in TERMINAL:
        if code == 1236 and "server_id" in low.replace(" ", "_") and "slave" in low:
            return "retry", "server_id"
        return "terminal", TERMINAL[code]
    if "purged" in low or "could not find first log" in low:
        return "terminal", "purged"
    if "access denied" in low:
        return "terminal", "auth"
    if "server_id" in low or "server_uuid" in low:
        return "retry", "server_id"
    if any(w in low for w in ("disconnect", "connection", "timed out", "timeout", "broken pipe", "reset")):
        return "retry", "disconnect"
    return "retry", "other"


@dataclass
class FailureTracker:
    """Three failures in a row that each came within ``fast`` seconds end the stream."""

    fast: float = 5.0
    most: int = 3
    count: int = 0

    def observe(self, lived_seconds: float, progressed: bool = False) -> bool:
        self.count = 1 if progressed or lived_seconds >= self.fast else self.count + 1
        return self.count >= self.most
