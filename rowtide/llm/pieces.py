"""Token ids of whole texts by the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import resident
from .words import WordIds


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: bytes that print in Latin-1 stand for themselves, the others for the characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class PieceEncoder(WordIds):
    """Texts that hold an added token (such as the end of a text, written out), and all texts under another pre-tokenizer than the byte-level one, are left to the library as a whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        split = json.loads(self.library.to_str())
        level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.cuts = split["normalizer"] is None and {k: v for k, v in (split["pre_tokenizer"] or {}).items() if k in level} == level
        letters, vocabulary = byte_letters(), self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token) if all(c in letters for c in token) else len(token.encode())

    def rows(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False))])

    def odd(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), not self.cuts)
        for token in self.added:
            out |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return out


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker."""
    return resident(f"pieces {path}", lambda: PieceEncoder(path))
