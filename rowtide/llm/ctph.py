"""Context-triggered piecewise hashing: fingerprints of whole texts that survive edits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal, ordered, text_rows

#: Bytes that a boundary depends on; chunks of a signature at most, unless that leaves too few, and at least if it can be; the least block size as a power of two.
WINDOW, CHUNKS, FEW, LEAST = 7, 64, 8, 2
#: Base-64 digits in the order of RFC 4648; two stand for one chunk.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIRS = [a + b for a in DIGITS for b in DIGITS]
MULTIPLIER, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
BLOCK = 1 << 20


def boundaries(data: bytes, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Places behind which a chunk ends at block size 2**power, and their rolling hashes (mixed).

    A place ends a chunk if its hash is below 2**(32 - power): at twice the block size about half of the same places do.
    """
    at, hashes = [], []
    limit = np.uint32(min(2 ** (32 - power), 2**32 - 1))
    for s in range(0, len(data), BLOCK):
        lead = min(s, WINDOW - 1)
        c = np.frombuffer(data, dtype=np.uint8, offset=s - lead, count=min(BLOCK + lead, len(data) - s + lead)).astype(np.uint32)
        h = rolled(c)
        h ^= h >> np.uint32(15)
        h *= MIX
        h ^= h >> np.uint32(13)
        own = np.flatnonzero(h[lead:] < limit)
        at.append(own + s)
        hashes.append(h[lead:][own])
    return (np.concatenate(at), np.concatenate(hashes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def rolled(c: np.ndarray) -> np.ndarray:
    """Polynomial hash of the last WINDOW bytes at each place."""
    h = c.copy()
    weight = np.uint32(1)
    for k in range(1, WINDOW):
        weight = np.uint32(int(weight) * int(MULTIPLIER) % 2**32)
        h[k:] += c[:-k] * weight if len(c) > k else c[:0]
    return h


def signature(data: bytes, ends: np.ndarray) -> str:
    """Two digits a chunk; the last chunk runs to the end of the data."""
    if not data:
        return ""
    stops = (ends + 1).tolist()
    if not stops or stops[-1] != len(data):
        stops.append(len(data))
    return "".join([PAIRS[zlib.crc32(data[a:b]) & 4095] for a, b in zip([0, *stops], stops, strict=False)])


def fingerprint(data: bytes) -> str:
    """``power:signature:signature at twice the block size``, the block size being the least with CHUNKS chunks at most.

    Where that leaves fewer than FEW chunks (a text that repeats itself has its boundaries at a few block sizes), the
    block size below it is taken, with all of its chunks.
    """
    power = max(LEAST, int(len(data) // CHUNKS).bit_length() - 3)
    at, h = boundaries(data, power)
    while len(at) < FEW and power > LEAST:
        power -= 1
        at, h = boundaries(data, power)
    before = None
    while len(at) >= CHUNKS:
        power, before = power + 1, (power, at, h)
        keep = h < np.uint32(2 ** (32 - power)) if power < 32 else np.zeros(len(h), bool)
        at, h = at[keep], h[keep]
    if before and len(at) < FEW:
        power, at, h = before
    twice = at[h < np.uint32(2 ** max(0, 31 - power))]
    return f"{power}:{signature(data, at)}:{signature(data, twice)}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence of chunks, in one word operation a chunk."""
    masks: dict[str, int] = {}
    n = len(a) // 2
    for i in range(n):
        x = a[2 * i : 2 * i + 2]
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << n) - 1
    s = full
    for i in range(0, len(b), 2):
        u = s & masks.get(b[i : i + 2], 0)
        s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def likeness(x: str, y: str) -> float:
    """1 - edits / chunks of both (insertions and deletions of chunks), at a block size that both signatures have; else 0."""
    if x == y:
        return 1.0
    (p, a1, a2), (q, b1, b2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    pairs = [(a1, b1), (a2, b2)] if p == q else [(a2, b1)] if q == p + 1 else [(a1, b2)] if p == q + 1 else []
    return max((4 * common(a, b) / (len(a) + len(b)) for a, b in pairs if a and b), default=0.0)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in ascending id; rows with the same id follow each other by a hash of their text (if they are many, or
    have no id) and by their text, null ids come last, and the first row follows the last. Null text is the empty text.
    Rows are dealt into ranges of ids in one exchange; the first row of each range goes to the range before too, as a
    guest that is only looked at.
    """
    import hashlib

    rows = ordered(text_rows(docs, id_col, text_col), "id", "body")
    place = F.struct(F.col("id").isNull().alias("lost"), "id", "tie")
    # of each range the first place: a row a range, bounded by the number of partitions
    heads = sorted((r["bucket"], r["at"]["id"], r["at"]["tie"]) for r in rows.groupBy("bucket").agg(F.min(place).alias("at")).collect())
    firsts = rows.sparkSession.createDataFrame([(b, k, t, heads[n - 1][0]) for n, (b, k, t) in enumerate(heads)], "own int, key long, t long, to int")
    same = (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("key")) & (F.col("tie") == F.col("t"))
    guests = rows.join(F.broadcast(firsts), same).groupBy("to", "id", "tie").agg(F.min("body").alias("body")).select("id", "body", "tie", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    rows = rows.select("id", "body", "tie", "bucket", F.lit(0).alias("guest")).unionByName(guests)
    rows = deal(rows, "guest", "id", "tie", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, body, fingerprint)
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out = []
            for bucket, guest, key, body in zip(*(b.column(c).to_pylist() for c in ("bucket", "guest", "id", "body")), strict=True):
                if guest and (held is None or held[0] != bucket):
                    continue  # of a range without rows
                own = fingerprint(body)
                if held is not None and held[0] == bucket:
                    text, after = held[2].decode("utf-8", "replace"), body.decode("utf-8", "replace")
                    half = len(text) // 2
                    edited = (text[: len(text) - half] + after[:half]).encode()
                    mark = fingerprint(edited)
                    out.append((held[1], len(text), hashlib.sha256(edited).hexdigest(), held[3], mark, likeness(held[3], mark), likeness(held[3], own)))
                held = None if guest else (bucket, key, body, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)

    return rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
