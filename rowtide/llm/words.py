"""Token ids of whole texts, a batch at a time: each distinct word of a batch is put together once, from atoms that a worker remembers.

The byte-level pre-tokenizer never joins what stands before a single space to the space, so that a text can be cut
there and its words encoded apart, each with the space before it.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Bounded

#: Where a text may be cut: before a single space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: ASCII signs but the apostrophe: behind a letter or digit they are a pre-token of their own. Letters and digits as far as all versions of Unicode agree.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER = "[A-Za-z0-9À-ÖØ-öø-ſ]$"
#: Characters of a text that are looked at together; a longer one is taken in parts, cut where it may be.
PART = 4 << 20
#: Bytes that a worker's table of known words may take.
CACHE_BYTES = 112 << 20
#: Atoms in one text for the encoder, new atoms that are encoded together, and words whose ids are copied together.
ROW, LOT, COPIED = 256, 1 << 15, 1 << 20


def parts_of(text: str) -> list[str]:
    """The text in parts of about PART characters."""
    out, at = [], 0
    while len(text) - at > PART and (cut := CUT.search(text, at + PART)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]] if at else [text]


class WordIds(Bounded):
    """Remembers the ids of atoms of words, the space before a word being part of it; subclasses encode what is new.

    The table is dropped whole when it passes its bytes: results never depend on it.
    """

    #: Bytes of each token.
    bytes_of: np.ndarray

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used, self.taken = np.zeros(1 << 14, np.uint32), 0, 0  # the pool's ids, and bytes of the whole table

    def rows(self, texts: list[str]) -> np.ndarray:
        """ids of texts in a row."""
        raise NotImplementedError

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of atoms. They are encoded in rows, those without a space on lines of their own; each token's bytes tell which atom it is of."""
        white = [i for i, w in enumerate(words) if w.isspace()]
        row = ["" if w.isspace() else w if w[0] == " " else "\n" + w for w in words]
        ids = self.rows(["".join(row[i : i + ROW]) for i in range(0, len(row), ROW)])
        ends, stops = np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(pa.array(row, pa.string())).to_numpy(), dtype=np.int64)
        if len(words) and (ends[-1] if len(ends) else 0) != stops[-1]:
            raise ValueError("the tokens don't have the bytes of their text")
        after = np.searchsorted(ends, stops, side="right")
        line = np.array([x[:1] == "\n" for x in row], dtype=bool)
        before = np.r_[0, after[:-1]]
        if line.any():  # the end of line before an atom isn't its own
            before[line] = np.searchsorted(ends, np.r_[0, stops[:-1]][line] + 1, side="right")
        sizes = after - before
        out = ids[np.repeat(before - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        for i in reversed(white):
            own = self.rows([words[i]])
            sizes[i] = len(own)
            out = np.insert(out, int(sizes[:i].sum()), own)
        return out, sizes

    def encode_text(self, text: str) -> np.ndarray:
        return self.rows([text])

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that can't be cut at spaces for some reason of the vocabulary's own."""
        return np.zeros(len(texts), dtype=bool)

    def learn(self, words: list[str]) -> None:
        n, first = len(words), len(self.slots)
        ids, sizes = self.encode_words(words)
        while first + n > len(self.size):
            self.start, self.size = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.size, np.zeros_like(self.size)]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        self.pool[self.used : self.used + len(ids)] = ids
        self.size[first : first + n] = sizes
        self.start[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.slots.update(zip(words, range(first, first + n), strict=True))
        self.taken += 4 * len(ids) + sum(map(len, words)) + 180 * n

    def slots_of(self, words: list[str]) -> np.ndarray:
        """Of distinct words."""
        found = np.fromiter(map(self.slots.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(found < 0)
        if len(new) and self.taken > self.limit:
            self.forget()
            new, found = np.arange(len(words)), np.full(len(words), -1)
        for a in range(0, len(new), LOT):
            at = new[a : a + LOT]
            found[at] = len(self.slots) + np.arange(len(at))
            self.learn([words[i] for i in at.tolist()])
        return found

    def encode(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of a batch of UTF-8 texts in a row, and how many of them each text has. Bytes that aren't UTF-8 count as U+FFFD."""
        try:
            texts = bodies.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in bodies.to_pylist()], pa.string())
        long = pc.greater(pc.binary_length(texts), PART).to_numpy(zero_copy_only=False)
        if not long.any():
            return self.batch(texts)
        ids, sizes = [], np.zeros(len(texts), dtype=np.int64)
        edges = np.flatnonzero(np.diff(np.r_[2, long, 2]))  # runs of texts of one kind
        for a, b in zip(edges, edges[1:], strict=False):
            if not long[a]:
                own, sizes[a:b] = self.batch(texts.slice(a, b - a))
                ids.append(own)
                continue
            for i in range(a, b):
                odd = self.odd(texts.slice(i, 1))[0]
                text = texts[i].as_py()
                for k, x in enumerate([text] if odd else parts_of(text)):
                    own = self.encode_text(x) if odd else self.batch(pa.array([x]), follows=k > 0)[0]
                    ids.append(own)
                    sizes[i] += len(own)
        return np.concatenate(ids), sizes

    def batch(self, texts: pa.Array, follows: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`; ``follows``: the texts go on behind a word, with the space before their first one."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if follows:  # the first word is none
            texts = pc.utf8_slice_codeunits(texts, 1)
        odd = self.odd(texts)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, pattern=" ")
        at = lists.offsets.to_numpy()
        coded = lists.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
        at, words, codes = at - at[0], coded.dictionary, coded.indices.to_numpy()
        fine = whole_word(words)
        whole = odd if fine.all() else odd | (np.add.reduceat(~fine[codes], at[:-1]) > 0)  # texts that can't be cut at each space
        first = np.zeros(0, np.int64) if follows else at[:-1][~whole]
        heads = pa.array(codes[first]).dictionary_encode()  # words at the beginning, with no space before them
        some = np.flatnonzero(fine)
        pool, sizes = self.compose(words.take(pa.array(np.r_[some, heads.dictionary.to_numpy()])), len(some))
        slot = np.zeros(len(words), dtype=np.int64)
        slot[some] = np.arange(len(some))
        slots = slot[codes]
        slots[first] = len(some) + heads.indices.to_numpy()
        n = sizes[slots] if len(sizes) else np.zeros(len(slots), np.int64)
        if whole.any():
            n[np.repeat(whole, np.diff(at))] = 0
        ids, each = gathered(pool, np.r_[np.cumsum(sizes) - sizes, 0], slots, n), np.add.reduceat(n, at[:-1])
        if not whole.any():
            return ids, each
        own = {i: self.encode_text((" " if follows else "") + t) for i in np.flatnonzero(whole).tolist() if (t := texts[i].as_py()) or follows}
        ends = np.cumsum(each)
        out = [own.get(i, ids[e - s : e]) for i, (s, e) in enumerate(zip(each.tolist(), ends.tolist(), strict=True))]
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def compose(self, words: pa.Array, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words, the first ``spaced`` of them with a space before them, from the ids of their atoms.

        Atoms are a word's lines, the ends of line between them, and the ASCII signs behind a line's last letter: the
        pre-tokenizer parts all of these.
        """
        lines = pc.split_pattern(words, pattern="\n")
        at = lines.offsets.to_numpy()
        parts, at = lines.values.slice(int(at[0]), int(at[-1] - at[0])), at - at[0]
        fine = whole_word(parts)
        if not fine.all():  # ends of line beside other white space
            keep = np.add.reduceat(~fine, at[:-1]) > 0
            lines = pc.if_else(pa.array(keep), pa.array([[w] for w in words.to_pylist()], lines.type), lines)
            at = np.r_[0, np.cumsum(pc.list_value_length(lines).to_numpy())]
            parts = pc.list_flatten(lines)
        stems = pc.utf8_rtrim(parts, characters=SIGNS)
        signs = (pc.binary_length(parts).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int64)
        signs[~pc.match_substring_regex(stems, LETTER).to_numpy(zero_copy_only=False)] = 0
        tailed = np.flatnonzero(signs)
        stems = pc.if_else(pa.array(signs > 0), stems, parts)
        tails = [x[-k:] for x, k in zip(parts.take(pa.array(tailed)).to_pylist(), signs[tailed].tolist(), strict=True)]
        begins = np.zeros(len(parts), dtype=bool)
        begins[at[:-1]] = True
        space = np.zeros(len(parts), dtype=bool)
        space[at[:spaced]] = True
        stems = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), stems, "")
        coded = pa.concat_arrays([stems, pa.array(["\n", *tails], pa.string())]).dictionary_encode()
        slots = self.slots_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = 1 + ~begins + (signs > 0)  # atoms of each part
        ends = np.cumsum(n)
        atoms = np.full(int(ends[-1]) if len(ends) else 0, slots[len(parts)], dtype=np.int64)
        atoms[ends - 1 - (signs > 0)] = slots[: len(parts)]
        atoms[ends[tailed] - 1] = slots[len(parts) + 1 :]
        sizes = self.size[atoms]
        each = np.add.reduceat(sizes, (ends - n)[at[:-1]]) if len(words) else np.zeros(0, np.int64)
        return gathered(self.pool, self.start, atoms, sizes), each


def whole_word(words: pa.Array) -> np.ndarray:
    """Neither empty nor with white space at an end."""
    return pc.equal(pc.utf8_trim_whitespace(words), words).to_numpy(zero_copy_only=False) & (pc.binary_length(words).to_numpy() > 0)


def gathered(pool: np.ndarray, start: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of slots, ``sizes`` of each from its start, in a row."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    for a in range(0, len(slots), COPIED):
        s, e = sizes[a : a + COPIED], ends[a : a + COPIED]
        low, high = int(e[0] - s[0]), int(e[-1])
        out[low:high] = pool[np.repeat(start[slots[a : a + COPIED]] - (e - s), s) + np.arange(low, high)]
    return out
