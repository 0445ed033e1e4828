"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy, part by part."""

from __future__ import annotations

import copy
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_PARTITIONS, Bounded, Scratch, resident, utf8

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: Labelled documents of a part, about, which is trained by itself within a round; rounds over all of them.
PART, ROUNDS = 6000, 4
#: Rows of a table of parameters that are summed in one task.
SLICE = 1 << 12
#: Places in a unit of the logit at which calibrating documents are counted.
BINS = 1024
#: Lengths of the word beginnings that are embedded beside the word.
STEMS = (4, 5, 6)
#: Words that a worker remembers at most, and words of a text that are looked at together.
CACHE, WORDS = 200_000, 1 << 16
FOLDS = 5
#: Signs that don't count at a word's ends.
EDGE = string.punctuation + "«»“”„‘’¿¡…–—"


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings; case and what stands around its letters don't count."""
    w = word.lower().strip(EDGE)
    parts = [b"w" + w.encode()] + [b"%d" % k + w[:k].encode() for k in STEMS if len(w) >= k]
    return [zlib.crc32(p) % BUCKETS for p in parts]


@dataclass
class Classifier:
    """Score: sigmoid of the weighted maxima, over the whole text, of each filter of each width."""

    embedding: np.ndarray  # BUCKETS, DIM
    filters: list[np.ndarray]  # of a width w: w, DIM, FILTERS
    weights: np.ndarray
    bias: float

    def columns(self) -> np.ndarray:
        """BUCKETS x (sum of widths * FILTERS): what a bucket adds to each filter at each of its places."""
        if not hasattr(self, "_columns"):
            self._columns = np.empty((BUCKETS, sum(WIDTHS) * FILTERS), dtype=np.float32)
            for i, column in enumerate(f[k] for f in self.filters for k in range(len(f))):
                self._columns[:, i * FILTERS : (i + 1) * FILTERS] = self.embedding @ column
        return self._columns

    def words(self, words: list[str]) -> np.ndarray:
        """A row a word: the sum of the columns of its buckets."""
        found = [features(w) for w in words]
        at = np.cumsum([0, *map(len, found)])[:-1]
        return np.add.reduceat(self.columns()[np.fromiter((b for f in found for b in f), dtype=np.int64)], at, axis=0)

    def pooled(self, blocks: Iterable[np.ndarray]) -> np.ndarray:
        """Largest rectified response of each filter over the rows of a text's words, given in blocks; words beyond the text's ends add nothing."""
        best = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        edge = np.zeros((max(WIDTHS) - 1, sum(WIDTHS) * FILTERS), dtype=np.float32)
        held, words = edge, 0
        for rows in chain(blocks, [None]):
            last = rows is None
            if last and not words:
                break
            words += 0 if last else len(rows)
            held = np.concatenate([held, edge if last else rows])
            at = 0
            for c, w in enumerate(WIDTHS):
                n = len(held) - len(edge) - (max(WIDTHS) - w if last else 0)  # windows that end in this block
                total = np.zeros((n, FILTERS), dtype=np.float32)
                for k in range(w):
                    first = len(edge) - (w - 1) + k
                    total += held[first : first + n, at : at + FILTERS]
                    at += FILTERS
                if n:
                    own = best[c * FILTERS : (c + 1) * FILTERS]
                    np.maximum(own, total.max(0), out=own)
            held = held[len(held) - len(edge) :]
        return best

    def score(self, blocks: Iterable[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(blocks) @ self.weights + self.bias, -60, 60))))


def word_numbers(texts: Iterable[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's words by number; a row of buckets for each number, filled up with BUCKETS."""
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in t.split()], dtype=np.int32) for t in texts]
    pool = np.full((len(known), 1 + len(STEMS)), BUCKETS, dtype=np.int32)
    for i, w in enumerate(known):
        found = features(w)
        pool[i, : len(found)] = found
    return docs, pool


class Training:
    """A classifier's parameters, and the sums of squares by which Adagrad divides their steps; the embedding's last row, of no bucket, stays zero."""

    def __init__(self, seen: np.ndarray, n: np.ndarray, seed: int = 7):
        """``seen``: documents of each class (a row a bucket) that have the bucket; ``n``: documents of each class. The first coordinate of the embedding begins as the bucket's log odds."""
        rng = np.random.default_rng(seed)
        odds = np.log((seen[:, 1] + 0.5) / (n[1] + 1)) - np.log((seen[:, 0] + 0.5) / (n[0] + 1))
        self.e = np.zeros((BUCKETS + 1, DIM))
        self.e[:BUCKETS] = rng.normal(0, 0.02, (BUCKETS, DIM))
        self.e[:BUCKETS, 0] = np.clip(np.where(seen.sum(1) >= 2, odds, 0.0), -1, 4) / 4
        self.f = rng.normal(0, 0.1, (sum(WIDTHS), DIM, FILTERS))  # the filters of all widths, word by word
        self.f[:, 0, : FILTERS // 2] += 0.8 / np.repeat(WIDTHS, WIDTHS)[:, None] ** 0.5
        self.weights, self.bias = rng.normal(0.2, 0.05, FILTERS * len(WIDTHS)), np.array([-2.0])
        self.ge, self.gf, self.gw, self.gb = np.full(BUCKETS + 1, 1e-2), np.full(self.f.shape, 1e-2), np.full(len(self.weights), 1e-2), np.array([1e-2])
        self.per = 0.5 / np.maximum(n, 1) * n.sum()  # each class weighs half
        self.clear()

    def clear(self) -> None:
        """Forgets what this part of the documents has changed."""
        self.touched, self.docs = np.zeros(BUCKETS + 1, dtype=bool), 0

    def dense(self) -> list[np.ndarray]:
        return [self.f, self.weights, self.bias, self.gf, self.gw, self.gb]

    def classifier(self) -> Classifier:
        return Classifier(self.e[:BUCKETS], np.split(self.f, np.cumsum(WIDTHS)[:-1]), self.weights, float(self.bias[0]))

    def pooled(self, words: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over a text's words, and the last word of the window where it is; in blocks of WORDS."""
        best, where, edge = np.full(FILTERS * len(WIDTHS), -np.inf), np.zeros(FILTERS * len(WIDTHS), dtype=np.int64), max(WIDTHS) - 1
        columns = self.f.transpose(0, 2, 1).reshape(-1, DIM)
        for s in range(0, len(words) + edge, WORDS):
            end = min(s + WORDS, len(words) + edge)
            x = np.zeros((end - s + edge, DIM))
            lo, hi = max(0, s - edge), min(len(words), end)
            x[lo - (s - edge) : hi - (s - edge)] = np.einsum("ijk->ik", self.e.take(pool.take(words[lo:hi], axis=0), axis=0))
            x, at = columns @ x.T, 0
            for c, w in enumerate(WIDTHS):
                n = min(end, len(words) + w - 1) - s  # windows that end in this block
                total = reduce(np.add, (x[at + k * FILTERS : at + (k + 1) * FILTERS, edge - (w - 1) + k : edge - (w - 1) + k + max(0, n)] for k in range(w)))
                at += w * FILTERS
                if n > 0:
                    own = slice(c * FILTERS, (c + 1) * FILTERS)
                    top = total.argmax(1)
                    value = total[np.arange(FILTERS), top]
                    where[own] = np.where(value > best[own], top + s, where[own])
                    best[own] = np.maximum(best[own], value)
        return np.maximum(best, 0), where

    def logit(self, words: np.ndarray, pool: np.ndarray) -> float:
        return float((self.pooled(words, pool)[0] if len(words) else 0 * self.weights) @ self.weights + self.bias[0])

    def step(self, words: np.ndarray, pool: np.ndarray, toxic: bool, rate: float) -> None:
        """Adagrad on the logistic loss of one text."""
        self.docs += 1
        if not len(words):
            return
        p, where = self.pooled(words, pool)
        g = (1 / (1 + np.exp(-np.clip(p @ self.weights + self.bias[0], -30, 30))) - toxic) * self.per[int(toxic)]
        if abs(g) < 1e-4:
            return
        back = g * self.weights * (p > 0)
        self.gw += (g * p) ** 2
        self.weights -= rate * g * p / np.sqrt(self.gw)
        self.gb += g * g
        self.bias -= rate * g / np.sqrt(self.gb)
        width = np.repeat(np.arange(len(WIDTHS)), WIDTHS)
        before = np.concatenate([np.arange(w)[::-1] for w in WIDTHS])
        rows = where.reshape(-1, FILTERS)[width] - before[:, None]  # the word at each place of each filter
        b = np.where((rows >= 0) & (rows < len(words)), back.reshape(-1, FILTERS)[width], 0.0)
        of = pool[words[np.clip(rows, 0, len(words) - 1)]]
        into, grad = self.f.transpose(0, 2, 1) * b[:, :, None], (self.e[of].sum(2) * b[:, :, None]).transpose(0, 2, 1)
        self.gf += grad**2
        self.f -= rate * grad / np.sqrt(self.gf)
        used = b != 0
        at, into = of[used].ravel(), np.repeat(into[used], of.shape[2], axis=0)
        at, into = at[at < BUCKETS], into[at < BUCKETS]
        np.add.at(self.ge, at, (into**2).mean(1))
        np.add.at(self.e, at, -0.2 * rate * into / np.sqrt(self.ge[at])[:, None])
        self.touched[at] = True

    def changes(self) -> np.ndarray:
        """What a part of the documents made of the parameters, for a mean with other parts: a row a bucket or other parameter, the weight last. A bucket that the part didn't touch has no weight."""
        rest = np.concatenate([x.ravel() for x in self.dense()])
        out = np.zeros((BUCKETS + len(rest), DIM + 2))
        t = np.flatnonzero(self.touched)
        out[t] = np.c_[self.e[t], self.ge[t], np.ones(len(t))]
        out[BUCKETS:, 0], out[BUCKETS:, -1] = rest * self.docs, self.docs
        return out

    def mixed(self, total: np.ndarray) -> None:
        """Takes the means from the sum of all parts' changes."""
        t = np.flatnonzero(total[:BUCKETS, -1])
        self.e[t], self.ge[t] = total[t, :DIM] / total[t, -1:], total[t, DIM] / total[t, -1]
        if not total[-1, -1]:
            return
        rest, at = total[BUCKETS:, 0] / total[BUCKETS:, -1], 0
        for x in self.dense():
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size


def constant(share: float) -> Classifier:
    """For documents of one class only."""
    return Classifier(np.zeros((BUCKETS, DIM)), [np.zeros((w, DIM, FILTERS)) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), 6.0 if share > 0.5 else -6.0)


def with_buckets(docs: list[np.ndarray], pool: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """How many documents of each class (a column) have each bucket (a row)."""
    seen = np.zeros((BUCKETS + 1, 2))
    for d, y in zip(docs, toxic.tolist(), strict=True):
        seen[np.unique(pool[d]), int(y)] += 1
    return seen[:BUCKETS]


def train(texts: Iterable[str], toxic: np.ndarray, seed: int = 7, rounds: int = ROUNDS) -> Classifier:
    """Texts at hand, as one part; they are taken once, one after another."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return constant(float(toxic.mean()) if len(toxic) else 0.0)
    docs, pool = word_numbers(texts)
    model, rng = Training(with_buckets(docs, pool, toxic), np.array([(~toxic).sum(), toxic.sum()]), seed), np.random.default_rng(seed)
    for r in range(rounds):
        for i in rng.permutation(len(docs)):
            model.step(docs[i], pool, bool(toxic[i]), 0.1 / (1 + r))
    return model.classifier()


def sparse(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a table that aren't zero, in slices of SLICE rows."""
    for k in range(0, len(table), SLICE):
        own = table[k : k + SLICE]
        at = np.flatnonzero(own.any(1)).astype(np.int32)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([at.tobytes()]), pa.array([own[at].astype(np.float32).tobytes()])], ["slice", "at", "rows"])


SPARSE = "slice int, at binary, rows binary"


def summed(tables: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of tables given by :func:`sparse`, a slice in one task; the driver gets one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at, x in zip(b.column("slice").to_pylist(), b.column("at").to_pylist(), b.column("rows").to_pylist(), strict=True):
                sums.setdefault(k, np.zeros((SLICE, width)))[np.frombuffer(at, np.int32)] += np.frombuffer(x, np.float32).reshape(-1, width)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()])], ["slice", "rows"])

    out = np.zeros((-(-rows // SLICE) * SLICE, width))
    for r in tables.repartitionById(len(out) // SLICE, F.col("slice")).mapInArrow(run, "slice int, rows binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["rows"]).reshape(-1, width)
    return out[:rows]


CHUNKS = "part int, id binary, toxic binary, apart binary, lang array<string>, size binary, words binary, pool binary"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents, sorted by part and id, as numbered words: a row for those of a part in a batch. Of rows with one id the first counts."""
    last = None
    for b in batches:
        part, ids = b.column("part").to_numpy(), b.column("id").to_numpy()
        new = np.r_[last is None or ids[:1] != last, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
        last = ids[-1:] if len(ids) else last
        for k in np.unique(part[new]).tolist():
            own = b.filter(pa.array(new & (part == k)))
            docs, pool = word_numbers(x.as_py().decode("utf-8", "replace") for x in own.column("body"))
            ids_ = own.column("id").to_numpy()
            apart = np.array([zlib.crc32(b"c%d" % i) % 3 == 0 for i in ids_.tolist()], dtype=bool)
            toxic, size = np.array(own.column("toxic").to_pylist(), dtype=bool), np.array([len(d) for d in docs], dtype=np.int64)
            arrays = [pa.array([x.tobytes()]) for x in (ids_, toxic, apart)]
            rest = [pa.array([x.tobytes()], pa.binary()) for x in (size, np.concatenate(docs), pool)]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *arrays, pa.array([own.column("lang").to_pylist()], pa.list_(pa.string())), *rest], [f.split()[0] for f in CHUNKS.split(", ")])


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[str | None], list[np.ndarray], np.ndarray]]:
    """Of each row of :func:`chunked`: part, ids, toxic, apart, languages, documents, pool."""
    for b in batches:
        for r in b.to_pylist():
            words, size = np.frombuffer(r["words"], np.int32), np.frombuffer(r["size"], np.int64)
            pool = np.frombuffer(r["pool"], np.int32).reshape(-1, 1 + len(STEMS))
            docs = np.split(words, np.cumsum(size)[:-1])
            yield r["part"], np.frombuffer(r["id"], np.int64), np.frombuffer(r["toxic"], bool), np.frombuffer(r["apart"], bool), r["lang"], docs, pool


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str, scratch: Scratch) -> DataFrame:
    """All labelled documents whose crc32(id) mod FOLDS isn't 0, dealt by a hash of the id into parts of about PART and numbered; no sample is taken."""
    own = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
    own = own.where(F.pmod(F.crc32(own[id_col].cast("string").cast("binary")), F.lit(FOLDS)) != 0)
    own = scratch.save(own.groupBy(own[id_col].cast("long").alias("id")).agg((F.max(own[label_col]) > 0).alias("toxic")), "labels")
    parts = min(MOST_PARTITIONS, -(-own.count() // PART) or 1)
    rows = docs.select(docs[id_col].cast("long").alias("id"), utf8(docs[text_col]).alias("body"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.join(own, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    return scratch.save(rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "id", "body", "lang").mapInArrow(chunked, CHUNKS), "chunks")


def train_parts(chunks: DataFrame, seed: int = 7, rounds: int = ROUNDS) -> tuple[Training | None, np.ndarray]:
    """Training on all documents that aren't apart, and their number by class.

    In each round every part goes on from the same parameters by itself; then the parts' means are taken, of a bucket's row
    over the parts that touched it, of the rest weighed by documents. Only one table of parameters comes to the driver a round.
    """
    spark = chunks.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((BUCKETS + 1, 2))
        for _, _, toxic, apart, _, docs, pool in documents_of(batches):
            at = np.flatnonzero(~apart)
            seen[:BUCKETS] += with_buckets([docs[i] for i in at], pool, toxic[at])
            seen[BUCKETS] += [(~toxic[at]).sum(), toxic[at].sum()]
        yield from sparse(seen)

    seen = summed(chunks.mapInArrow(count, SPARSE), BUCKETS + 1, 2)
    seen, n = seen[:BUCKETS], seen[BUCKETS]
    if not n.all():
        return None, n
    model = Training(seen, n, seed)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], r: int = r, sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            part, own = None, None
            for k, ids, toxic, apart, _, docs, pool in documents_of(batches):
                if k != part:
                    if own is not None:
                        yield from sparse(own.changes())
                    part, own = k, copy.deepcopy(sent.value)
                    own.clear()
                at = np.flatnonzero(~apart)
                for i in at[np.random.default_rng([seed, r, k, int(ids[0]) % (1 << 32)]).permutation(len(at))]:
                    own.step(docs[i], pool, bool(toxic[i]), 0.1 / (1 + r))
            if own is not None:
                yield from sparse(own.changes())

        model.mixed(summed(chunks.mapInArrow(run, SPARSE), BUCKETS + sum(x.size for x in model.dense()), DIM + 2))
        sent.unpersist()
    return model, n


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> tuple[Classifier, dict[str | None, float]]:
    """The classifier and a threshold for each language, from all labelled documents whose crc32(id) mod FOLDS isn't 0.

    A third of them, by a hash of the id, calibrates, the others train: the score is shifted and each language's threshold set
    where the errors of both classes, weighed alike, are fewest, by their counts at each place of the logit; languages with under 20 of either class use 0.5. Neither
    ids nor languages enter a score.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    chunks = labelled(docs, labels, id_col, text_col, label_col, lang_col, scratch)
    trained, n = train_parts(chunks)
    limits: dict[str | None, float] = {}
    if trained is None:
        scratch.drop("labels", "chunks")
        return constant(float(n[1] / max(1, n.sum()))), limits
    sent = docs.sparkSession.sparkContext.broadcast(trained)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, toxic, apart, langs, docs, pool in documents_of(batches):
            at = np.flatnonzero(apart)
            z = np.array([sent.value.logit(docs[i], pool) for i in at], dtype=np.float64)
            place = np.round(np.clip(z, -60, 60) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in at], pa.string()), pa.array(place), pa.array(toxic[at].astype(np.int64))], ["lang", "place", "toxic"])

    model = trained.classifier()
    counts = F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    found = chunks.mapInArrow(logits, "lang string, place int, toxic long").withColumn("clean", 1 - F.col("toxic"))
    found = scratch.save(found.groupBy("lang", "place").agg(*counts), "logits")

    def cut(rows: list[Row]) -> float:
        z, toxic, clean = np.array(sorted((r["place"], r["toxic"], r["clean"]) for r in rows)).T
        return best_cut(z / BINS, toxic, clean)

    every = found.groupBy("place").agg(*counts).collect()
    if any(r["toxic"] for r in every) and any(r["clean"] for r in every):
        model.bias -= (shift := cut(every))
        enough = found.groupBy("lang").agg(*counts).where(F.col("lang").isNotNull() & (F.least("toxic", "clean") >= 20)).select("lang")
        own: dict[str, list[Row]] = {}
        for r in found.join(enough, "lang", "left_semi").collect():
            own.setdefault(r["lang"], []).append(r)
        limits = {lang: float(1 / (1 + np.exp(shift - cut(own[lang])))) for lang in sorted(own)}
    scratch.drop("logits")
    scratch.drop("labels", "chunks")
    return model, limits


def best_cut(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the widest stretch of cuts with the fewest errors, both classes weighed alike; z ascends without repeats, with the documents of each class at it."""
    wrong = np.r_[0, np.cumsum(toxic)] / max(1, toxic.sum()) + (clean.sum() - np.r_[0, np.cumsum(clean)]) / max(1, clean.sum())
    edges = np.r_[z[0] - 1, (z[1:] + z[:-1]) / 2, z[-1] + 1]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    width = np.r_[0, np.diff(z), 0]
    return float(edges[best[np.argmax(width[best])]])


class Reader(Bounded):
    """Rows of filter responses for the words of a text, in blocks of WORDS; a worker remembers words."""

    def __init__(self, model: Classifier, most: int = CACHE):
        self.model, self.most = model, max(most, WORDS)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((self.most, sum(WIDTHS) * FILTERS), dtype=np.float32)

    def block(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        new = {w for w in words if w not in cache}
        if new:
            if len(cache) + len(new) > self.most:
                cache.clear()
                new = set(words)
            listed, first = list(new), len(cache)
            for i in range(0, len(listed), 4096):
                some = listed[i : i + 4096]
                self.rows[first + i : first + i + len(some)] = self.model.words(some)
            cache.update(zip(listed, range(first, first + len(listed)), strict=True))
        return self.rows[[cache[w] for w in words]]

    def __call__(self, text: str) -> Iterator[np.ndarray]:
        words = text.split()
        for i in range(0, len(words), WORDS):
            yield self.block(words[i : i + WORDS])


def score(docs: DataFrame, model: Classifier, limits: dict[str | None, float] | None = None, text_col: str = "text", lang_col: str | None = None, score_col: str = "toxic_score", limit_col: str = "toxic_limit") -> DataFrame:
    """``docs`` with ``score_col`` (double, 0 to 1) and, given a language column, ``limit_col``: 0.5 or the language's own. Columns of these two names are replaced.

    Whole texts; null is the empty text, which has the score of no words. No exchange: rows keep their partitions.
    The model is of fixed size and is sent once to each executor.
    """
    spark = docs.sparkSession
    docs = docs.drop(score_col, limit_col)
    body_col = "body_" + "_".join(docs.columns)  # unlike any other
    sent, name = spark.sparkContext.broadcast(model), f"toxicity {uuid.uuid4()}"
    Scratch(spark, "toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = resident(name, lambda: Reader(sent.value))
        for b in batches:
            scores = [reader.model.score(reader(x.as_py().decode("utf-8", "replace"))) for x in b.column(body_col)]
            keep = [c for c in b.schema.names if c != body_col]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    out = docs.withColumn(body_col, utf8(docs[text_col])).mapInArrow(run, schema)
    if lang_col:
        own = F.lit(0.5)
        for lang, limit in (limits or {}).items():
            own = F.when(F.col(lang_col) == lang, limit).otherwise(own)
        out = out.withColumn(limit_col, own)
    return out
