"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions

THRESHOLD = 0.93
#: Share of the links at the threshold itself that a visit reaches; closer ones are reached more often.
RECALL = 0.9999
#: Links that are planted to find the radius of it, at least, in each of two ways.
PLANTED = 1 << 15
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 4096
#: Vectors of a block of cells held in a task, and of its queries' share dealt to one task.
CHUNK, SHARE = 2048, 16_384


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; an empty centre moves to the row farthest from its own."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = ((c * c).sum(1) - 2 * x @ c.T) + (x * x).sum(1)[:, None]
        at, far = d.argmin(1), d.min(1)
        for i in range(k):
            own = at == i
            if own.any():
                c[i] = x[own].mean(0)
            else:
                c[i] = x[far.argmax()]
                far[far.argmax()] = 0
    return c


class MultiIndex:
    """A codebook for each half; a vector's cell is the pair of its nearest centres.

    ``bounds`` gives, for each half and centre, the squared distance from the vector's half to that centre's
    region at least (to the plane between it and the nearest centre). Two unit vectors of cosine t lie
    2 - 2t apart squared, so that no cell whose two bounds add up to more can hold a link.
    """

    def __init__(self, books: list[np.ndarray]):
        self.books, self.k = books, len(books[0])
        self.half = books[0].shape[1]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cells, least = [], []
        for book, h in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True):
            d = np.maximum((book * book).sum(1) - 2 * h @ book.T + (h * h).sum(1)[:, None], 0)
            at = d.argmin(1)
            between = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-300))
            plane = np.maximum((d - d.min(1)[:, None]) / (2 * between[at]), 0)
            plane[np.arange(len(at)), at] = 0
            cells.append(at)
            least.append(plane**2)
        return cells, least

    @staticmethod
    def traverse(a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[int, int]]:
        """Cells in ascending sum of the halves' bounds, until the sum passes the radius (multi-sequence order)."""
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}
        while heap:
            s, i, j = heapq.heappop(heap)
            if s > radius:
                return
            yield int(oa[i]), int(ob[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[oa[x]] + b[ob[y]], x, y))


def fit(sample: np.ndarray, k: int, threshold: float, recall: float = RECALL) -> tuple[MultiIndex, float]:
    """Codebooks fitted on the sample, and the radius up to which cells are visited.

    The radius is that within which ``recall`` of planted links lie: to vectors of the sample, whatever links they have,
    others are put at a cosine of exactly ``threshold`` (no link is farther), once in random directions and once in the
    direction of another vector of the sample; the larger radius of the two counts. All links lie within 2 - 2 * threshold.
    """
    half = sample.shape[1] // 2
    k = max(1, min(k, len(sample)))
    index, whole = MultiIndex([codebook(sample[:, :half], k), codebook(sample[:, half:], k)]), 2 - 2 * threshold + 1e-9
    rng = np.random.default_rng(5)
    (c1, c2), (b1, b2) = index.bounds(sample)
    radii = []
    for random in (True, False):
        needed = []
        for _ in range(-(-PLANTED // len(sample))):
            way = rng.normal(size=sample.shape) if random else sample[rng.permutation(len(sample))]
            way = way - (way * sample).sum(axis=1, keepdims=True) * sample
            length = np.sqrt((way * way).sum(axis=1))
            own = np.flatnonzero(length > 1e-6)
            (d1, d2), (e1, e2) = index.bounds(threshold * sample[own] + (1 - threshold**2) ** 0.5 * way[own] / length[own, None])
            at = np.arange(len(own))
            needed.append(np.minimum(b1[own, d1] + b2[own, d2], e1[at, c1[own]] + e2[at, c2[own]]))
        if len(needed := np.concatenate(needed)):
            radii.append(np.quantile(needed, recall, method="higher"))
    return index, min(whole, float(max(radii)) + 1e-9) if radii else whole


def usable(v: Column, label: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept), one row per vector.

    Vectors of one label (and dimension) with a cosine of at least ``threshold`` link; every pair that is reported was
    compared in double precision. Every vector is indexed. A vector visits the nearest cells up to the radius of the target
    ``recall`` (1: every cell that can hold a link of it; see :func:`fit`); a pair counts if either of the two visits the other's cell, so n_links is symmetric. Equal vectors are one class:
    they link with each other and share their links. Vectors that are null, empty, zero, or hold null or non-finite
    components, and those with a null label, link with nothing: n_links 0, component_id their own id. component_id is
    the least id reachable (null ids left out); kept is id = component_id (false for a null id). An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"), usable(v, vectors[label_col]).alias("ok"))
    keys = scratch.save(rows.select("id", "label", "h1", "h2", "ok"), "keys")
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("size"), F.min("id").alias("least"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, groups, dim = classes.agg(F.count("*"), F.approx_count_distinct("label"), F.max(F.size("v"))).first()
    if not n:
        return keys.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    few = classes.where(F.pmod(F.xxhash64("cid"), F.lit(max(1, -(-n // SAMPLE)))) == 0).limit(2 * SAMPLE).select("v").collect()
    dim += dim % 2

    def padded(lists: list) -> np.ndarray:
        out = np.zeros((len(lists), dim))
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return unit(out)

    few = few or classes.limit(1).select("v").collect()
    index, radius = fit(padded([r["v"] for r in few]), int(np.clip(round((n / (40 * groups)) ** 0.5), 2, 256)), threshold, recall)
    if recall >= 1:
        radius = 2 - 2 * threshold + 1e-9
    del few

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("v").to_pylist()
            x = padded(lists)
            (c1, c2), (b1, b2) = index.bounds(x)
            visits = []
            for p, q in zip(b1, b2, strict=True):
                blocks: dict[int, list[int]] = {}
                for i, j in index.traverse(p, q, radius):
                    blocks.setdefault(i, []).append(j)
                visits.append([{"block": i, "cells": js} for i, js in blocks.items()])
            label = [f"{len(y)} {z}" for y, z in zip(lists, b.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(label), b.column("size"), pa.array((c1 * index.k + c2).astype(np.int32)), pa.array(visits, pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))]))), pa.array([r.tobytes() for r in x], pa.binary())], ["cid", "label", "size", "cell", "visits", "v"])

    placed = scratch.save(classes.select("cid", "label", "size", "v").mapInArrow(place, "cid long, label string, size long, cell int, visits array<struct<block:int,cells:array<int>>>, v binary"), "placed")
    block = F.floor(F.col("cell") / index.k).cast("int")  # the cells of one centre of the first half: a vector goes to a block once, whatever it visits there
    cells = placed.groupBy("label", block.alias("block")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    cells = scratch.save(cells, "cells")

    def upto(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def of(c: str, salt: int) -> Column:
        return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(c)).cast("int")

    members = placed.drop("visits").withColumn("block", block).join(cells, ["label", "block"]).withColumn("chunk", of("chunks", 1)).withColumn("share", upto("shares")).withColumn("asks", F.lit(0)).withColumn("visited", F.lit(None).cast("array<int>"))
    queries = placed.withColumn("visit", F.explode("visits")).withColumn("block", F.col("visit.block")).withColumn("visited", F.col("visit.cells")).drop("visits", "visit").join(cells, ["label", "block"])
    queries = queries.withColumn("share", of("shares", 2)).withColumn("chunk", upto("chunks")).withColumn("asks", F.lit(1))
    key = ["label", "block", "chunk", "share"]
    dealt = members.unionByName(queries).select(*key, "asks", "cid", "size", F.col("cell").alias("own"), "v", "visited")
    dealt = dealt.repartition(partitions(spark), *key).sortWithinPartitions(*key, "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            cid, size, own, asks = (b.column(c).to_numpy() for c in ("cid", "size", "own", "asks"))
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=np.float64).reshape(len(cid), -1)
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or asks[i] != asks[i - 1]] + [len(keys)]
            out: list[tuple] = []
            for s, e in zip(edges, edges[1:], strict=False):
                if keys[s] != now:
                    if held:
                        out.append(held.spanning())
                    now, held = keys[s], Cell(index, radius, threshold)
                if asks[s]:
                    for i in range(s, e, 512):
                        j = min(e, i + 512)
                        out += held.ask(cid[i:j], size[i:j], own[i:j], x[i:j], b.column("visited")[i:j].to_pylist())
                else:
                    held.add(cid[s:e], size[s:e], own[s:e], x[s:e])
            yield flat(out)
        if held:
            yield flat([held.spanning()])

    found = scratch.save(dealt.mapInArrow(compare, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    joined = components(found.where("a != b").select("a", "b"), scratch).withColumnRenamed("node", "cid")
    named = classes.select("cid", "label", "h1", "h2", "size", "least").join(counts, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "h1", "h2", F.lit(True).alias("ok"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    named = scratch.save(named, "named")
    scratch.drop("classes", "placed", "cells", "links")  # nothing reads them any more
    out = keys.where("ok").join(named, ["label", "h1", "h2", "ok"]).select("id", "n_links", "component_id")
    out = out.unionByName(keys.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def flat(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])


class Cell:
    """Members of a chunk of a block of cells against the queries that visit some of them: (a, b, 0) for a link that spans, (a, a, n) for n links of a."""

    def __init__(self, index: MultiIndex, radius: float, threshold: float):
        self.index, self.radius, self.threshold = index, radius, threshold
        self.parts: list[tuple] = []
        self.cid: np.ndarray | None = None

    def add(self, *rows: np.ndarray) -> None:
        self.parts.append(rows)

    def ready(self) -> None:
        if self.cid is None:
            self.cid, self.size, self.own, self.x = (np.concatenate(p) for p in zip(*self.parts, strict=True))
            self.root = np.arange(len(self.cid))
            self.given = np.zeros(len(self.cid), dtype=np.int64)
            _, (self.b1, self.b2) = self.index.bounds(self.x)

    def ask(self, cid: np.ndarray, size: np.ndarray, own: np.ndarray, x: np.ndarray, visited: list[list[int]]) -> list[tuple]:
        if not self.parts:
            return []
        self.ready()
        open_to = np.zeros((len(x), self.index.k), dtype=bool)
        open_to[np.repeat(np.arange(len(x)), list(map(len, visited))), np.concatenate(visited).astype(int)] = True
        q, m = np.nonzero((x @ self.x.T >= self.threshold) & open_to[:, self.own % self.index.k])
        other = cid[q] != self.cid[m]
        q, m = q[other], m[other]
        if not len(q):
            return []
        got = np.bincount(q, weights=self.size[m], minlength=len(cid)).astype(np.int64)
        # the member's own visits don't reach the query's cell: it hears of this link here
        unheard = self.b1[m, own[q] // self.index.k] + self.b2[m, own[q] % self.index.k] > self.radius
        self.given += np.bincount(m[unheard], weights=size[q[unheard]], minlength=len(self.cid)).astype(np.int64)
        asked, first = np.unique(q, return_index=True)
        for s, e in zip(first, [*first[1:], len(q)], strict=True):
            roots = self.root[m[s:e]]
            if (low := roots.min()) != roots.max():
                self.root[np.isin(self.root, roots)] = low
        return [(cid[asked], cid[asked], got[asked]), (cid[asked], self.cid[m[first]], np.zeros(len(asked)))]

    def spanning(self) -> tuple:
        if not self.parts:
            return (np.zeros(0),) * 3
        self.ready()
        r, g = self.root != np.arange(len(self.root)), self.given > 0
        a = np.concatenate([self.cid[r], self.cid[g]])
        return a, np.concatenate([self.cid[self.root[r]], self.cid[g]]), np.concatenate([np.zeros(r.sum()), self.given[g]])
