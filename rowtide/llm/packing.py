"""Best-fit packing of token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, text_rows
from .pieces import encoder as piece_encoder

CAPACITY = 1024


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset, pieces a sequence) and the number of sequences.

    Exactly what best fit would do with the pieces in descending length, but a run of sequences that are filled
    alike is handled at once: the work depends on the number of lengths, not of pieces. Piece number r of a length
    goes to sequence first + (r - rank) // each at offset + (r - rank) % each * length.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, number)
    slots, n = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:
                room = capacity
                runs = [(n, -(-left // (room // length)))]
                n += runs[0][1]
            else:
                runs = free.pop(room)
            each = room // length
            while runs:
                first, size = runs.pop()
                if not left:
                    free.setdefault(room, []).append((first, size))
                    continue
                full = min(size, left // each)
                if full:
                    slots.append((length, rank, full * each, first, capacity - room, each))
                    free.setdefault(room - full_room(length, each), []).append((first, full))
                    left, rank = left - full * each, rank + full * each
                if full < size and left and left < each:
                    slots.append((length, rank, left, first + full, capacity - room, each))
                    free.setdefault(room - left * length, []).append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < size:
                    free.setdefault(room, []).append((first + full, size - full))
    return slots, n


def full_room(length: int, each: int) -> int:
    return length * each


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids, ids_crc32, part, part_rank): whole texts encoded, ``end_id`` appended.

    Only longer documents are cut, from their end, so that the first piece may be the shorter one. part_rank counts
    pieces of one length within the task that wrote them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = piece_encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes = encoder.encode(b.column("body"))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            stop = (sizes - capacity * (pieces - 1))[row] + capacity * piece  # the first piece is the shorter one
            length = np.where(piece == 0, stop, capacity)
            ends = np.cumsum(length)
            data = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(length.tolist(), ends.tolist(), strict=True)]
            by = np.argsort(length, kind="stable")
            same = np.r_[0, np.flatnonzero(np.diff(length[by])) + 1]
            rank = np.empty(len(length), dtype=np.int64)
            rank[by] = np.arange(len(by)) - np.repeat(same, np.diff(np.r_[same, len(by)]))
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            values = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(stop - length), pa.array(length), values, pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)], ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "part_rank"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, part_rank long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of :func:`cut` with sequence_id and offset; its ids stay a column, which a query that leaves them out doesn't read.

    The histogram has ``capacity`` rows at most, and so the plan is bounded whatever the number of documents. Ranks
    within a length are sums over tasks of the counts of each, so no length is gathered in a task. Null text is empty
    (one piece, the end id); null and repeated ids are packed like any others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    by_part = scratch.save(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    table: dict[int, np.ndarray] = {}
    for length in histogram:
        table[length] = np.array(sorted(x[1:] for x in slots if x[0] == length), dtype=np.int64)
    before = by_part.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.empty((len(length), 2), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True]) if len(order) else []
        for a, b in zip(edges, edges[1:], strict=False):
            rows = order[a:b]
            own = table[int(lengths[rows[0]])]
            s = own[np.searchsorted(own[:, 0], ranks[rows], side="right") - 1]
            k = ranks[rows] - s[:, 0]
            out[rows, 0] = s[:, 2] + k // s[:, 4]
            out[rows, 1] = s[:, 3] + k % s[:, 4] * lengths[rows]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = pieces.join(before, ["length", "part"]).withColumn("at", place("length", F.col("before") + F.col("part_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): each packed sequence's ids, its pieces in order of offset; a sequence has ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
