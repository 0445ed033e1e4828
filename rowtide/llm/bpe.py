"""Byte-level BPE by ranks: encoding through a hierarchical-bitmap queue of merge ranks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Bounded, Scratch, resident, text_rows
from .words import WordIds

#: Bytes of pre-tokens that are merged in one run of the queue; a longer pre-token is a run of its own.
RUN = 1 << 17
#: Fixed value: the pattern under which texts can be cut at spaces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which the linked list lies in packed arrays.
PACKED = 1 << 20


class RankQueue:
    """Positions by merge rank; three levels of 64-bit words say which ranks have any.

    The next rank is found by three find-first-set steps, whatever the number of waiting pairs, and comes with all
    positions that wait for it. Stale entries stay until they come up; the caller skips them.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0

    def push(self, rank: int, places: list[int]) -> None:
        self.buckets[rank] = places
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions, the leftmost first."""
        m = (self.top & -self.top).bit_length() - 1
        w = m << 6 | (self.mid[m] & -self.mid[m]).bit_length() - 1
        rank = w << 6 | (self.low[w] & -self.low[w]).bit_length() - 1
        self.low[w] &= self.low[w] - 1
        if not self.low[w]:
            self.mid[m] &= self.mid[m] - 1
            if not self.mid[m]:
                self.top &= self.top - 1
        places, self.buckets[rank] = self.buckets[rank], None
        places.sort()
        return rank, places

    def __bool__(self) -> bool:
        return self.top != 0


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Decoder(Bounded):
    """The bytes of each token, and the ids as text."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.names = [str(i) for i in range(len(self.tokens))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Ranks:
    """A vocabulary of ranks: which token any two tokens merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.n = ranks, max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.n
        for t, r in ranks.items():
            self.tokens[r] = t
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        #: Of each token, what it makes with those behind it and before it; and the tokens that may make one of a lower rank.
        self.behind: list[dict[int, int]] = [nothing := {}] * self.n
        self.ahead: list[dict[int, int]] = [nothing] * self.n
        self.lower: set[int] = set()
        self.first = np.full((256, 256), -1, dtype=np.int64)  # of two bytes
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    for known, x, y in ((self.behind, a, b), (self.ahead, b, a)):
                        if known[x] is nothing:
                            known[x] = {}
                        known[x][y] = r
                    self.lower.update(x for x in (a, b) if r < x)
            if len(t) == 2:
                self.first[t[0], t[1]] = r
        self.queue = RankQueue(self.n)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pre-tokens, none empty: in each, the pair of least rank is merged first, of equal ranks the leftmost.

        The pre-tokens lie in one linked list with gaps between them, so that a rank's whole bucket is taken at once
        for all of them; if a merge makes a pair of a rank below that of its bucket, the rest of the bucket waits.
        """
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(data)
        stops = np.cumsum([len(p) for p in pieces])
        first = np.r_[0, stops[:-1]]
        start = np.full(n, -1, dtype=np.int64)
        start[:-1] = self.first[data[:-1], data[1:]]
        start[stops - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stops - 1] = n
        before[first] = -1
        token = self.single[data]
        at = np.flatnonzero(start >= 0)
        at = at[np.argsort(start[at], kind="stable")]
        edges = np.flatnonzero(np.r_[True, np.diff(start[at]) != 0, True]) if len(at) else np.zeros(0, np.int64)
        packed = n > PACKED
        held = (lambda x: array("q", x.tobytes())) if packed else (lambda x: x.tolist())
        queue = self.queue
        ranks, at, edges = start[at[edges[:-1]]].tolist() if len(at) else [], at.tolist(), edges.tolist()
        for rank, a, b in zip(ranks, edges, edges[1:], strict=False):
            queue.push(rank, at[a:b])
        token, after, before, waiting = held(token), held(after), held(before), held(start)
        buckets, push = queue.buckets, queue.push
        while queue:
            rank, places = queue.pop()
            behind, ahead, lower = self.behind[rank].get, self.ahead[rank].get, rank in self.lower
            for done, i in enumerate(places, 1):
                if waiting[i] != rank:
                    continue
                j = after[i]
                after[i] = k = after[j]
                token[i] = rank
                token[j] = waiting[j] = new = old = -1
                if k < n:
                    before[k] = i
                    new = behind(token[k], -1)
                    if new >= 0:
                        if buckets[new] is None:
                            push(new, [i])
                        else:
                            buckets[new].append(i)
                waiting[i] = new
                h = before[i]
                if h >= 0:
                    waiting[h] = old = ahead(token[h], -1)
                    if old >= 0:
                        if buckets[old] is None:
                            push(old, [h])
                        else:
                            buckets[old].append(h)
                if lower and (0 <= new < rank or 0 <= old < rank) and done < len(places):
                    push(rank, places[done:])
                    break
        token = np.frombuffer(token, dtype=np.int64) if packed else np.array(token)
        alive = token >= 0
        return token[alive].astype(np.uint32), np.add.reduceat(alive, first, dtype=np.int64)


class BytePairs(WordIds):
    """Encodes whole texts, each match of the pattern by itself."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.model = Ranks(read_ranks(path))
        self.cuts = pattern == PATTERN
        self.bytes_of = np.array([len(t) for t in self.model.tokens], dtype=np.int64)
        self.split = regex.compile(pattern).findall

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Under another pattern texts aren't cut."""
        return np.full(len(texts), not self.cuts)

    def pieces(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pre-tokens: whole ones have a rank, the others are merged."""
        parts = [x.encode() for x in found]
        whole = np.fromiter(map(self.model.ranks.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        sizes, new = np.ones(len(parts), dtype=np.int64), np.flatnonzero(whole < 0)
        if not len(new):
            return whole.astype(np.uint32), sizes
        length = np.cumsum([len(parts[i]) for i in new.tolist()])
        cuts = [0, *(np.flatnonzero(np.diff(length // RUN)) + 1).tolist(), len(new)]
        runs = [self.model.merge([parts[i] for i in new[a:b].tolist()]) for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes[new] = np.concatenate([n for _, n in runs])
        out = np.repeat(whole, sizes)
        out[np.repeat(whole < 0, sizes)] = np.concatenate([ids for ids, _ in runs])
        return out.astype(np.uint32), sizes

    def rows(self, texts: list[str]) -> np.ndarray:
        return self.pieces([x for t in texts for x in self.split(t)])[0]


def model(path: str, pattern: str) -> BytePairs:
    """One model a worker."""
    return resident(f"pairs {path} {pattern}", lambda: BytePairs(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each row's whole text as token ids; null is the empty text. No exchange; rows keep their partitions."""
    Scratch(docs.sparkSession, "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model(path, pattern)
        for b in batches:
            ids, sizes = pairs.encode(b.column("body"))
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), column], ["id", "ids"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): texts encoded, and the bytes decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = resident(f"tokens {path}", lambda: Decoder(path))
        for b in batches:
            n, ids_sha, bytes_sha = [], [], []
            ids_column = b.column("ids")
            at, values = ids_column.offsets.to_numpy().tolist(), ids_column.values
            for s, e in zip(at[:-1], at[1:], strict=True):
                ids = values.slice(s, e - s).to_numpy(zero_copy_only=False).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(tokens.names.__getitem__, ids)).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(tokens.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path, pattern, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")
