"""Interpolated modified Kneser-Ney over byte n-grams: perplexity of documents under trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, text_rows

ORDER = 4
#: Bytes of text in a block at least when it closes (a longer document makes a longer block), and bytes looked at together.
BLOCK, LOT = 6 << 20, 1 << 21
#: Remainder of crc32(id) by FOLDS: trusted documents with 0 set thresholds, the others are counted.
FOLDS = 5
#: Share of trusted documents of a language that its threshold keeps; with fewer held-out documents the counted ones set it too.
QUANTILE, LEAST_DOCS = 0.99, 50


def codes(bodies: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In lots of about LOT bytes: the n-gram that ends at each byte, as an integer of 8 bits a byte, and of which texts how many are there.

    Before a text stand zero bytes; a longer text comes in several lots, each with the bytes before it.
    """

    def lot() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n = np.zeros(len(data), dtype=np.int64)
        for k in range(order):
            n[k:] |= data[: len(data) - k].astype(np.int64) << (8 * k)
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        inside = np.ones(len(data), dtype=bool)
        inside[(np.cumsum(sizes) - sizes)[:, None] + np.arange(order - 1)] = False
        return n[inside], np.array(of, dtype=np.int64), sizes - (order - 1)

    parts, of, held = [], [], 0
    for k, body in enumerate(bodies):
        for s in range(0, len(body), LOT):
            parts.append((body[s - order + 1 : s] if s else b"\0" * (order - 1)) + body[s : s + LOT])
            of.append(k)
            held += len(parts[-1])
            if held >= LOT:
                yield lot()
                parts, of, held = [], [], 0
    if parts:
        yield lot()


def distinct_codes(bodies: list[bytes], order: int) -> np.ndarray:
    out = np.zeros(0, dtype=np.int64)
    for own, _, _ in codes(bodies, order):
        out = np.union1d(out, own)
    return out


def blocks(docs: DataFrame, order: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row a block of about BLOCK bytes: its documents' ids, hashes of their texts, languages, sizes and compressed text, and its distinct n-grams, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        ids, marks, langs, bodies, size = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            grams = distinct_codes(bodies, order)
            steps = np.diff(grams, prepend=0)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())), pa.array([list(map(len, bodies))], pa.list_(pa.int64())),
                 pa.array([squeeze.compress(b"".join(bodies))], pa.binary()), pa.array([squeeze.compress(steps.astype("<i8").tobytes())], pa.binary())],
                ["block", "ids", "marks", "langs", "sizes", "text", "grams"],
            )

        for b in batches:
            for i, mark, lang, body in zip(*(b.column(c).to_pylist() for c in ("id", "mark", "lang", "body")), strict=True):
                ids.append(i)
                marks.append(mark)
                langs.append(lang)
                bodies.append(body)
                size += len(body)
                if size >= BLOCK or len(ids) >= 100_000:
                    yield close()
                    n, ids, marks, langs, bodies, size = n + 1, [], [], [], [], 0
        if ids:
            yield close()

    rows = text_rows(docs, id_col, text_col, lang_col)
    rows = rows.select("id", F.xxhash64("body").alias("mark"), F.col(lang_col).cast("string").alias("lang"), "body")
    return rows.mapInArrow(run, "block long, ids array<long>, marks array<long>, langs array<string>, sizes array<long>, text binary, grams binary")


def unpack(text: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(sizes).tolist()
    return [data[e - s : e] for e, s in zip(ends, sizes, strict=True)]


def grams_of(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype="<i8"))


def trusted_counts(table: DataFrame, chosen: DataFrame, order: int) -> DataFrame:
    """(gram, n) over the texts of the ids in ``chosen`` (block, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, text, own in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "text", "chosen")), strict=True):
                wanted = set(own)
                for own, _, _ in codes([x for i, x in zip(ids, unpack(text, sizes), strict=True) if i in wanted], order):
                    gram, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    rows = table.select("block", "ids", "sizes", "text").join(chosen, "block").select("ids", "sizes", "text", "chosen")
    return rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of one order from its counts of counts (Chen and Goodman), each between 0 and its count."""
    n = counts.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


class Model:
    """Counts of each order with the sums over each context, as tables in the shared folder.

    The highest order has occurrences; a lower one has continuation counts: of how many different bytes its n-gram
    is preceded. Every order backs off to the one below with the weight that its discounts freed, the lowest to 1/256.
    """

    def __init__(self, counts: DataFrame, scratch: Scratch, order: int = ORDER):
        self.order = order
        self.orders: dict[int, tuple[DataFrame, DataFrame]] = {}
        for k in range(order, 0, -1):
            counts = scratch.save(counts, f"counts-{k}")
            d = discounts(counts)
            cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            sums = counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
            self.orders[k] = (counts.select("gram", (F.col("n") - cut).alias("kept")), scratch.save(sums, f"contexts-{k}"))
            counts = counts.groupBy(suffix(F.col("gram"), k - 1).alias("gram")).agg(F.count("*").alias("n"))

    def probabilities(self, grams: DataFrame, scratch: Scratch) -> DataFrame:
        """(gram, p) of the distinct n-grams of the highest order in ``grams``, by equi-joins on n-gram and context."""
        asked = {self.order: grams}
        for k in range(self.order - 1, 0, -1):
            asked[k] = asked[k + 1].select(suffix(F.col("gram"), k).alias("gram")).distinct()
        below = None
        for k in range(1, self.order + 1):
            kept, sums = self.orders[k]
            q = asked[k].withColumn("context", F.shiftright("gram", 8))
            q = q.join(kept, "gram", "left").join(sums, "context", "left")
            if below is None:
                q = q.withColumn("back", F.lit(1 / 256))
            else:
                q = q.withColumn("low", suffix(F.col("gram"), k - 1)).join(below.select(F.col("gram").alias("low"), F.col("p").alias("back")), "low")
            p = F.coalesce((F.coalesce("kept", F.lit(0.0)) + F.col("freed") * F.col("back")) / F.col("total"), F.col("back"))
            below = scratch.save(q.select("gram", p.alias("p")), f"asked-{k}")
        return below


def stored(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks as a table bucketed by block."""
    name = "rowtide_" + scratch.root.rsplit("-", 1)[1]
    rows.write.option("compression", "uncompressed").option("path", scratch.path("blocks")).bucketBy(partitions(scratch.spark), "block").saveAsTable(name)
    return scratch.spark.table(name)


def weighed(table: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(id, mark, lang, n_bytes, perplexity) of all documents of a table of blocks."""
    order = model.order

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("grams").to_pylist(), strict=True):
                gram = grams_of(packed)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.full(len(gram), block)), pa.array(np.arange(len(gram), dtype=np.int32))], ["gram", "block", "at"])

    asked = table.select("block", "grams").mapInArrow(distinct, "gram long, block long, at int")
    known = model.probabilities(asked.select("gram").distinct(), scratch)
    back = asked.join(known, "gram").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.log("p").cast("float").alias("lp")))).alias("found"))
    back = back.select("block", F.col("found.lp").alias("lp"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, lp in enumerate(b.column("lp")):
                ids, marks, langs, sizes, text, packed = (b.column(c)[k].as_py() for c in ("ids", "marks", "langs", "sizes", "text", "grams"))
                grams, lp = grams_of(packed), lp.values.to_numpy().astype(np.float64)
                total, size = np.zeros(len(ids)), np.array(sizes, dtype=np.int64)
                for own, of, n in codes(unpack(text, sizes), order):
                    np.add.at(total, of, np.add.reduceat(lp[np.searchsorted(grams, own)], np.cumsum(n) - n))
                with np.errstate(divide="ignore", invalid="ignore"):
                    perplexity = np.exp(-total / size)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(langs, pa.string()), pa.array(size), pa.array(perplexity, mask=size == 0)], ["id", "mark", "lang", "n_bytes", "perplexity"])

    scored = table.select("block", "ids", "marks", "langs", "sizes", "text", "grams").join(back, "block", "left").select("ids", "marks", "langs", "sizes", "text", "grams", F.coalesce("lp", F.array().cast("array<float>")).alias("lp"))
    return scratch.save(scored.mapInArrow(weigh, "id long, mark long, lang string, n_bytes long, perplexity double"), "scored")


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, keep, mark), one row per document, perplexity per byte; mark is XXH64 of the text by Spark.

    Trusted text: documents all of whose labels say quality 1. Four of five (by crc32 of the id) are counted, the fifth sets each
    language's threshold: the ``quantile`` of its documents' perplexities, never another language's. In a language with fewer than
    LEAST_DOCS of them all trusted documents do, each under a model without its own fifth. Every n-gram of every whole text is scored.
    An empty or null text has no perplexity and is kept; a null id is never trusted; a null language is one of its own.
    Of a language without trusted documents nothing is known: its threshold is null and all of it is kept. Repeated rows are scored alike.

    Text is read once and isn't exchanged: blocks of it lie compressed in a table bucketed by block; exchanged are the
    distinct n-grams of each block, and their probabilities on the way back.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kneser-ney")
    table = stored(blocks(docs, order, id_col, text_col, lang_col), scratch)
    good = labels.groupBy(labels[id_col].cast("long").alias("id")).agg(F.min(labels[quality_col]).alias("quality")).where("quality = 1 and id is not null")
    good = good.select("id", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS)).alias("fold"))
    where = table.select("block", F.explode("ids").alias("id")).join(good, "id")

    def without(fold: int, scratch: Scratch) -> Model:
        chosen = where.where(F.col("fold") != fold).groupBy("block").agg(F.collect_set("id").alias("chosen"))
        return Model(trusted_counts(table, chosen, order), scratch, order)

    scored = weighed(table, without(0, scratch), scratch)
    trusted = scored.join(good, "id").where("perplexity is not null")
    held = trusted.where("fold = 0").select("lang", "perplexity")
    few = trusted.groupBy(F.col("lang").alias("few")).agg(F.count(F.when(F.col("fold") == 0, 1)).alias("n")).where(F.col("n") < LEAST_DOCS).select("few")
    few = scratch.save(few, "few")
    if not few.isEmpty():
        rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).join(good, "id")
        rows = scratch.save(rows.join(few, F.col("lang").eqNullSafe(F.col("few")), "left_semi"), "few-texts")
        for fold in range(1, FOLDS):
            own = Scratch(spark, "kneser-ney")
            part = stored(blocks(rows.where(F.col("fold") == fold), order, "id", "text", "lang"), own)
            held = held.unionByName(weighed(part, without(fold, own), own).where("perplexity is not null").select("lang", "perplexity"))
    by_lang = held.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    out = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"])
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"), "mark")
