"""SimHash near-duplicates over a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions, text_rows

SEED, RADIUS = 42, 4
#: Fingerprints of one side of a comparison; larger nodes of the index are dealt out as pairs of chunks.
CHUNK = 16_384
FANOUT, PAIRS = 16, 1 << 16
#: Shingles of the sets of one side of a comparison, at most (but for a single set), and pairs of sets that are counted between two looks at what is linked.
HELD, AT_ONCE = 8_000_000, 4096
#: Close pairs a row up to which a root's pairs are given out to be counted; the sets of other roots go to the root.
DENSE = 4
#: Shingles of many texts whose numbers are known to all tasks, at most, and texts of the sample that they are counted in; they stand last in the order of shingles.
COMMON, ORDERED_BY = 50_000, 20_000
#: Sets of fewer shingles are compared whatever their fingerprints; others only if these differ in at most so many of 64, and of 128, bits. At a
#: similarity of 0.8 a bit differs with a probability of 0.16 at most, so that a pair is over 28 or over 48 about once in 10**8.
SMALL, APART = 32, (28, 48)


def shingle_hashes(text: bytes, words: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of each run of so many words, repeats included, in blocks of bounded size."""
    parts = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not parts:
        return
    joined, size = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        yield np.array([size(joined, SEED)], dtype=np.uint64)
        return
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: 1 - words], ends[words - 1 :]
    for i in range(0, len(starts), block):
        yield np.array([size(joined[a:b], SEED) for a, b in zip(starts[i : i + block].tolist(), ends[i : i + block].tolist(), strict=True)], dtype=np.uint64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is 1."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def fingerprint(text: bytes, words: int = 4) -> int:
    """64 bits; a bit is 1 if it is 1 in over half of the shingles' hashes. Without words: 0."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        ones += bit_counts(h)
    return majority(ones, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp), fp as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column("body").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], ["id", "fp"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    rank = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


class Forest:
    """Union-find over 0..n-1 in whole arrays; a root is the least of its members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.up[a], self.up[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
            while not np.array_equal(up := self.up[self.up], self.up):
                self.up = up


class GrayIndex:
    """Fingerprints under their roots, in Gray order below each, with nodes of FANOUT children up to the root.

    A node keeps the bits that all its fingerprints share (mask and pattern). Two nodes differ in at least the bits
    where both patterns are fixed and unequal, so a pair of groups with more such bits than the radius is left out
    whole; the count grows from level to level down to the fingerprints themselves. Many roots are searched at once.
    """

    def __init__(self, roots: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), roots))
        every, root = fps[self.order], roots[self.order]
        ones, n = every, len(every)
        self.levels = [(every, ~np.zeros(n, np.uint64))]
        self.children: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(n), np.ones(n, np.int64))]
        while n and len(first := np.flatnonzero(np.r_[True, root[1:] != root[:-1]])) < n or len(self.levels) == 1:
            place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n])) if n else np.arange(0)
            at = np.flatnonzero(place % FANOUT == 0)
            every, ones, root = (np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(ones, at), root[at]) if n else (every, ones, root)
            self.levels.append((every, ~(every ^ ones)))
            self.children.append((at, np.diff(np.r_[at, n])))
            n = len(at)

    def near(self, level: int, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
        pattern, mask = self.levels[level]
        return np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= radius

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in the given order of all pairs of one root within the radius, in bounded lots."""
        every = np.arange(len(self.levels[-1][0]))
        todo = [(len(self.levels) - 1, every, every)]
        while todo:
            level, i, j = todo.pop()
            keep = self.near(level, i, j, radius)
            i, j = i[keep], j[keep]
            if not level:
                other = i < j
                if other.any():
                    yield self.order[i[other]], self.order[j[other]]
                continue
            first, size = self.children[level]
            for k in range(0, len(i), PAIRS // FANOUT**2):
                x, y = i[k : k + PAIRS // FANOUT**2], j[k : k + PAIRS // FANOUT**2]
                n = size[x] * size[y]
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(size[y], n)
                a, b = np.repeat(first[x], n) + at // wide, np.repeat(first[y], n) + at % wide
                keep = a <= b
                todo.append((level - 1, a[keep], b[keep]))


def spanning(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: pairs of rows that connect, within each key, whatever lies within the radius of each other."""
    same = keys[1:] == keys[:-1]
    rows = np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(keys) else np.zeros(0, np.int64)  # not alone under their root
    forest = Forest(len(rows))
    if len(rows):
        for i, j in GrayIndex(keys[rows], fps[rows]).pairs(radius):
            forest.link(i, j)
    linked = np.flatnonzero(forest.up != np.arange(len(rows)))
    return rows[linked], rows[forest.up[linked]]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a sorted stream; the last group of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = np.ones(b.num_rows, dtype=bool)
        for k in keys:
            last &= b.column(k).to_numpy() == b.column(k)[-1].as_py()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and any(held[-1].column(k)[-1] != b.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def views(radius: int, free: int = 2) -> list[int]:
    """Masks of the index's roots: of radius + free segments of the 64 bits, any two fingerprints within the radius share all bits of some ``free`` segments."""
    cuts = np.linspace(0, 64, radius + free + 1).round().astype(int).tolist()
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, free)]


def paired(rooted: DataFrame, scratch: Scratch, name: str, size: Column | None = None) -> DataFrame:
    """Rows with ``root`` and ``cid``, and ``pair``: a root over CHUNK rows, or whose sizes sum to over HELD, is dealt out as pairs of its chunks."""
    columns = rooted.columns
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(size) / HELD) if size is not None else F.lit(1))
    large = scratch.save(rooted.groupBy("root").agg(chunks.cast("int").alias("chunks")).where("chunks > 1"), name)
    if large.isEmpty():
        return rooted.withColumn("pair", F.lit(0))
    rooted = rooted.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int")
    rooted = rooted.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rooted.select(*columns, (F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")).alias("pair"))


def dealt(rooted: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of :func:`paired` in tasks by (root, pair), sorted."""
    return rooted.repartition(partitions(scratch.spark), "root", "pair").sortWithinPartitions("root", "pair")


def rooted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole (root, pair) groups of a task of :func:`dealt`, several at once: the number of each row's group, and the rows."""
    for t in by_group(batches, ["root", "pair"]):
        root, pair = t.column("root").to_numpy(), t.column("pair").to_numpy()
        yield np.r_[0, np.cumsum((root[1:] != root[:-1]) | (pair[1:] != pair[:-1]))], t


def hamming_links(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b): links among the ``cid`` of distinct fp that have the components of all pairs within the radius.

    Each root of the index fixes one masked pattern, so a fingerprint goes to C(radius + 2, 2) roots, whatever the
    size of the table; below its root it is searched in the :class:`GrayIndex`. (One Gray order of all fingerprints
    can't be dealt out by ranges: with 2**k ranges about k bits of a range are fixed, and at k = 8 a fingerprint is
    within 4 of them for 64 % of the ranges.)
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in views(radius)]
    rooted = classes.select("cid", "fp", F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("view", "mask"))
    rooted = rooted.select("cid", "fp", F.xxhash64("view", F.col("fp").bitwiseAND(F.col("mask"))).alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in rooted_groups(batches):
            cid = t.column("cid").to_numpy()
            a, b = spanning(group, t.column("fp").to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b])], ["a", "b"])

    return dealt(paired(rooted, scratch, "large-roots"), scratch).mapInArrow(run, "a long, b long")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """At most COMMON shingles of several texts of a sample, and their numbers. They only order shingles: any order gives the same links."""
    n = rows.count()
    if n > ORDERED_BY:
        rows = rows.where(F.rand(7) < ORDERED_BY / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), words) for x in b.column("body")]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    found = rows.select("body").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    pairs = np.array(sorted((r["h"], r["n"]) for r in found), dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """A row a document: id, mark (a hash of the text), fp, 128 bits that name its set of shingles (s1, s2), a fingerprint of 128 bits of the set (x1, x2), the set's size, the rarest of the set (firsts), and the text.

    Sets of n and m shingles at or over the similarity share similarity * max(n, m) of them at least, so that, in any one
    order of all shingles, their first n - ceil(similarity * n) + 1 and m - ceil(similarity * m) + 1 share one.
    """
    rows = text_rows(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words))  # bounded by COMMON

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, often = sent.value
        for b in batches:
            numbers, names, firsts = [], [], []
            for body in b.column("body"):
                ones, n, own = np.zeros(64, dtype=np.int64), 0, []
                for x in shingle_hashes(body.as_py(), words):
                    n += len(x)
                    ones += bit_counts(x)
                    own.append(x)
                own = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
                numbers.append((majority(ones, n), majority(bit_counts(own), len(own)), majority(bit_counts(mixed(own)), len(own)), len(own)))
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                own = own.view(np.int64)
                at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
                seen = np.where(h[at] == own, often[at], 0) if len(h) else np.zeros(len(own), np.int64)
                firsts.append(own[np.lexsort((own, seen))[: len(own) - least_common(len(own), similarity) + 1 if len(own) else 0]])
            fp, x1, x2, size = (np.array(c, dtype=np.uint64).view(np.int64) for c in zip(*numbers, strict=True)) if numbers else [np.zeros(0, np.int64)] * 4
            s = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("mark"), pa.array(fp), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(x1), pa.array(x2), pa.array(size), pa.array(firsts, pa.list_(pa.int64())), b.column("body")],
                ["id", "mark", "fp", "s1", "s2", "x1", "x2", "n", "firsts", "body"],
            )

    schema = "id long, mark long, fp long, s1 long, s2 long, x1 long, x2 long, n long, firsts array<long>, body binary"
    return rows.withColumn("mark", F.xxhash64("body")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def least_common(n: int, similarity: float) -> int:
    return int(np.ceil(similarity * n - 1e-9))


def among(rows: DataFrame, key: str, asked: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """Rows whose key is one of ``asked`` (distinct keys): where the rows are if there are few of these, else by an exchange."""
    few = asked.count() <= limit
    return rows.join(F.broadcast(asked) if few else asked, key, "left_semi")


def close(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that sizes and fingerprints of their sets allow to be similar."""
    of = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("x1").alias(f"p{c}"), F.col("x2").alias(f"q{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    apart = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb")))
    return rows.where((F.least("na", "nb") < SMALL) | (apart <= APART[1])).select("a", "b")


def sets_of(rows: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(cid, shingles): the sets of those that are asked for."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([shingle_set(x.as_py(), words).tobytes() for x in b.column("body")], pa.binary())], ["cid", "shingles"])

    return among(rows.select(F.col("row").alias("cid"), "body"), "cid", asked).mapInArrow(sets, "cid long, shingles binary")


def verified(pairs: DataFrame, rows: DataFrame, words: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of at least the given one, counted shingle by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), f"{name}-asked")
    few = scratch.save(sets_of(rows, asked, words), f"{name}-sets")
    both = pairs.join(few.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(few.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    out = scratch.save(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)
    scratch.drop(f"{name}-asked", f"{name}-sets")
    return out


class Sets:
    """Sets at hand, their shingles numbered."""

    def __init__(self, shingles: list[bytes]):
        self.n = np.array([len(x) // 8 for x in shingles], dtype=np.int64)
        self.first = np.cumsum(self.n) - self.n
        known, self.codes = np.unique(np.frombuffer(b"".join(shingles), dtype=np.uint64), return_inverse=True)
        self.mark = np.zeros(len(known), dtype=bool)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many shingles the sets of each pair share."""
        out, order = np.zeros(len(i), dtype=np.int64), np.argsort(i, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
            own = self.codes[self.first[i[at[0]]] :][: self.n[i[at[0]]]]
            self.mark[own] = True
            n = self.n[j[at]]
            ends = np.cumsum(n)
            if ends[-1]:
                hits = self.mark[self.codes[np.repeat(self.first[j[at]] - (ends - n), n) + np.arange(ends[-1])]]
                sums = np.r_[0, np.cumsum(hits)]
                out[at] = sums[ends] - sums[ends - n]
            self.mark[own] = False
        return out


def close_lots(group: np.ndarray, t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of all pairs of a group that sizes and fingerprints allow to be similar, in bounded lots."""
    n, kind = t.column("n").to_numpy(), t.column("kind").to_numpy()
    x1, x2 = (t.column(c).to_numpy().view(np.uint64) for c in ("x1", "x2"))
    for k, radius in enumerate((64, APART[0])):
        own = np.flatnonzero(kind == k)
        if not len(own):
            continue
        for i, j in GrayIndex(group[own], x1[own]).pairs(radius):
            i, j = own[i], own[j]
            keep = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
            if k:
                keep &= np.bitwise_count(x1[i] ^ x1[j]).astype(int) + np.bitwise_count(x2[i] ^ x2[j]) <= APART[1]
            yield i[keep], j[keep]


def open_links(rows: DataFrame, found: DataFrame, classes: DataFrame, texts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): links that connect what no chain of links in ``found`` does yet, below one root.

    What the :class:`GrayIndex` over the sets' fingerprints finds close, and sizes allow to be similar, is counted on the whole
    sets. A root with up to DENSE such pairs a row gives the pairs; of any other the sets go to its task, where each pair is
    counted that links have not connected by then, and least members of components come out, fewer than its rows.
    """
    rows = rows.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("least", "cid", F.coalesce("component", "cid").alias("component"))
    rows = scratch.save(rows, "open-rows")
    apart = rows.groupBy("least").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("least")
    rows = rows.join(apart, "least").join(classes.select("cid", "n", "x1", "x2"), "cid")
    kinds = F.when(F.col("n") < SMALL, F.array(F.lit(0))).when(F.col("n") * similarity > SMALL, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = scratch.save(rows.withColumn("kind", F.explode(kinds)).withColumn("root", F.xxhash64("least", "kind")).drop("least"), "open-sized")

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in rooted_groups(batches):
            cid, component, root = (t.column(c).to_numpy() for c in ("cid", "component", "root"))
            most, count, held = DENSE * np.bincount(group), np.zeros(group[-1] + 1, np.int64), np.zeros((2, 0), np.int64)
            for i, j in close_lots(group, t, similarity):
                apart = component[i] != component[j]
                count += np.bincount(group[i[apart]], minlength=len(count))
                held = np.concatenate([held, [i[apart], j[apart]]], axis=1)
                held = held[:, (count <= most)[group[held[0]]]]
            a, b, dense = cid[held[0]], cid[held[1]], np.unique(root[(count > most)[group]])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "root"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(dense), pa.int64()), pa.nulls(len(dense), pa.int64()), pa.array(dense)], ["a", "b", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in rooted_groups(batches):
            component, n = (t.column(c).to_numpy() for c in ("component", "n"))
            held = Sets(t.column("shingles").to_pylist())
            trees, tree = np.unique(np.stack([group, component]), axis=1, return_inverse=True)  # a component in another group is another tree
            tree, forest = tree.ravel(), Forest(trees.shape[1])
            for i, j in close_lots(group, t, similarity):
                while len(i):
                    apart = forest.up[tree[i]] != forest.up[tree[j]]
                    i, j = i[apart], j[apart]
                    a, b, i, j = i[:AT_ONCE], j[:AT_ONCE], i[AT_ONCE:], j[AT_ONCE:]
                    both = held.common(a, b)
                    links = both >= similarity * (n[a] + n[b] - both) - 1e-9
                    forest.link(tree[a[links]], tree[b[links]])
            linked = np.flatnonzero(forest.up != np.arange(len(forest.up)))
            yield pa.RecordBatch.from_arrays([pa.array(trees[1, forest.up[linked]]), pa.array(trees[1, linked])], ["a", "b"])

    close = scratch.save(dealt(paired(rows, scratch, "open-roots"), scratch).mapInArrow(few, "a long, b long, root long").distinct(), "close")
    links = verified(close.where("root is null").select("a", "b"), texts, words, similarity, scratch, "near-rest")
    rows = scratch.save(rows.join(close.where("root is not null").select("root"), "root", "left_semi"), "open-dense")
    if rows.isEmpty():
        return links
    asked = scratch.save(rows.select("cid").distinct(), "open-asked")
    sets = scratch.save(sets_of(texts, asked, words), "open-sets")
    rows = paired(rows, scratch, "dense-roots", F.col("n")).join(sets, "cid")
    return links.unionByName(dealt(rows, scratch).mapInArrow(run, "a long, b long").distinct())


def similar_links(rows: DataFrame, classes: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): links among the ``cid`` of distinct sets that have the components of all pairs at or over the similarity.

    A rare shingle's sets stand below the least of them, which is their root: sets that share one have a root in common, and
    sets that share many have few. All sets of a root are compared with it first; then, among what those links leave apart,
    whatever the index over the sets' fingerprints finds close is, until links connect it.
    """
    members = rows.select(F.col("row").alias("cid"), "firsts").join(classes.select("cid"), "cid", "left_semi").select("cid", F.explode("firsts").alias("shingle"))
    members = scratch.save(members, "members")
    shared = members.groupBy("shingle").agg(F.min("cid").alias("least"), F.count("*").alias("count")).where("count > 1").drop("count")
    roots = scratch.save(members.join(shared, "shingle").select("least", "cid").distinct(), "roots")
    scratch.drop("members")
    first = scratch.save(close(roots.where("cid != least").select(F.col("least").alias("a"), F.col("cid").alias("b")), classes, similarity), "first")
    near = verified(first, rows, words, similarity, scratch, "near-first")
    found = components(near, scratch, "cc-first")
    rest = scratch.save(open_links(roots, found, classes, rows, words, similarity, scratch), "rest")
    scratch.drop("open-rows", "open-sized", "open-asked", "open-sets", "open-roots", "open-dense", "dense-roots", "close", "near-rest")
    return near.unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``.

    Fingerprints within ``radius`` bits link; component_id is the least id reachable. With ``similarity``, texts link
    whose sets of shingles have at least that Jaccard similarity, whatever their fingerprints: every such pair is found and
    each link is verified on the sets; two more columns are mark (XXH64 of the text by Spark) and kept, true for one row of each
    component: that of the least id (null last), then of the least mark. Null and empty texts, and texts without words, have fingerprint zero. Rows with a null
    id get a fingerprint and the component's least id that isn't null. Repeated rows are returned as often as given.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    if similarity is None:
        key = ["fp"]
        fps = scratch.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
        classes = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("cid", F.col("fp")), "classes")
        links = scratch.save(hamming_links(classes, radius, scratch), "links")
    else:
        key = ["s1", "s2"]
        fps = scratch.save(shingle_rows(docs, id_col, text_col, words, similarity), "shingles")
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "row")).alias("first")
        classes = scratch.save(fps.groupBy(*key).agg(F.min("id").alias("least"), F.min("row").alias("cid"), F.min("n").alias("n"), F.min("x1").alias("x1"), F.min("x2").alias("x2"), first), "classes")
        links = similar_links(fps, classes, words, similarity, scratch)
        fps = scratch.save(fps.select("id", "mark", "fp", "s1", "s2", "row"), "fingerprints")
        scratch.drop("shingles")
    found = components(links, scratch)
    grouped = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    if similarity is None:
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        more = []
    else:
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.min("first")["row"].alias("kept_row"))
        more = ["mark", (F.col("row") == F.col("kept_row")).alias("kept")]
    named = scratch.save(grouped.join(least, "component").select(*key, *least.columns[1:]), "named")
    scratch.drop("classes", "links", "large-roots", "roots", "first", "near-first", "rest")  # nothing reads them any more
    rows = fps.join(named, key)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)
