"""Token ids in ORC: one row a document, in ascending document id, each stripe readable by itself."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, deal, ordered, text_rows
from .pieces import encoder as piece_encoder

#: Run-length encoded integers (ORC's version 2 encoding), an index entry each 1,000 rows, Bloom filters on the document id.
ORC = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.write.format": "0.12",
    "compression": "zstd",
}
SCHEMA = "doc_id long, bucket int, bucket_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` to each and writes ORC files under ``path``.

    Files hold ascending ranges of the document id (null ids last) and are sorted by it; ``bucket_start`` counts the ids
    before a document within its range, so that writing needs no pass in order. Texts cross one exchange. Rows with the
    same id keep one order: by a hash of their text if they are many or have no id, then by their text. An empty table gives files without rows.
    """
    rows = deal(ordered(text_rows(docs, id_col, text_col), "id", "body"), "id", "tie", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bucket, at = piece_encoder(vocabulary), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes = encoder.encode(b.column("body"))
            ends = np.cumsum(sizes)
            values = np.insert(ids, ends, end_id)
            sizes, ends = sizes + 1, ends + np.arange(1, len(ends) + 1)
            buckets = b.column("bucket").to_numpy()
            first = np.flatnonzero(np.r_[buckets[0] != bucket, buckets[1:] != buckets[:-1]])
            starts = ends - sizes + at  # ids before the row, counted from where its bucket begins
            for f in first.tolist():
                starts[f:] -= starts[f]
            bucket, at = buckets[-1], int(starts[-1] + sizes[-1])
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("bucket"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), column], ["doc_id", "bucket", "bucket_start", "n_tokens", "ids"])

    rows.mapInArrow(run, SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids). ``doc_ids`` is pushed down: files, stripes and row groups without them aren't read.

    ``start`` is the number of ids of all documents before this one.
    """
    table = spark.read.schema(SCHEMA).orc(path)
    total = table.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()  # one row a range of ids
    before = np.cumsum([0, *(r["n"] for r in total)])[:-1].tolist()
    offsets = spark.createDataFrame([(r["bucket"], b) for r, b in zip(total, before, strict=True)], "bucket int, before long")
    if doc_ids is not None:
        table = table.where(F.col("doc_id").isin(doc_ids))
    return table.join(F.broadcast(offsets), "bucket").select("doc_id", (F.col("before") + F.col("bucket_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) with the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start")), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, scratch.path("orc"), vocabulary, end_id)
    return checksums(read_tokens(docs.sparkSession, scratch.path("orc")))
