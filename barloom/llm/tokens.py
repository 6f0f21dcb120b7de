"""Token ids of many texts at once.

Texts are cut at single spaces between visible characters, where no pre-token of the public vocabularies can reach
across; equal pieces are then encoded once. Every piece still goes through the tokenizers library: plain words straight
to its merge model, all others through the whole tokenizer.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa

from barloom.llm.common import buffers

_SAFE_NEXT = np.zeros(256, bool)  # first bytes of a character that is no white space for sure
_SAFE_NEXT[33:127] = True
_SAFE_NEXT[0xC3:0xE1] = True
_SAFE_NEXT[0xE4:] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True
_STOPS = frozenset(".,;:!?")


def cut_pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of the pieces: text borders and safe spaces (a piece starts with its space)."""
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        i = np.flatnonzero(data[1:-1] == 32) + 1
        before = data[i - 1]
        plain = (before > 32) & (before < 127)
        # a character beyond ASCII before the space: unsafe if it starts with a byte of some white space
        two, three = data[np.maximum(i - 2, 0)], data[np.maximum(i - 3, 0)]
        wide = _INNER[before] & (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
        mark[i[_SAFE_NEXT[data[i + 1]] & (plain | wide)]] = True
    mark[at] = True
    return np.flatnonzero(mark)


def _byte_table() -> dict[int, str]:
    """Byte -> printable stand-in of byte-level vocabularies: visible Latin-1 stays, the rest follows from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes string arrays with one vocabulary file; pieces seen before are kept up to `most_pieces`.

    The library encodes in the calling thread: threads of its own, one for each core of the machine in every Python worker,
    would each keep memory of theirs.
    """

    def __init__(self, path: str, most_pieces: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None  # the lower-casing vocabulary also drops white space
        self.table = _byte_table()
        self.most = most_pieces
        self.slot: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def _plain(self, piece: str) -> list[int] | None:
        """Ids of a word of Latin letters, with a space before and a stop behind it or not; None for anything else."""
        word = piece[1:] if piece[:1] == " " else piece
        stop = word[-1:] if word[-1:] in _STOPS else ""
        if stop:
            word = word[:-1]
        if not word.isalpha() or max(word) > "ÿ":
            return None
        if self.lower:
            word = word.lower()
        elif piece[0] == " ":
            word = " " + word
        text = word.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(text)]
        return ids + [t.id for t in self.model.tokenize(stop)] if stop else ids

    def _slots(self, pieces: list[str]) -> np.ndarray:
        found = np.fromiter((self.slot.get(p, -1) for p in pieces), np.int64, len(pieces))
        late = []
        for i in np.flatnonzero(found < 0).tolist():
            ids = self._plain(pieces[i])
            if ids is None:
                late.append(i)
                continue
            found[i] = self._add(pieces[i], ids)
        for start in range(0, len(late), 4096):
            part = late[start : start + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch([pieces[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = self._add(pieces[i], e.ids)
        return found

    def _add(self, piece: str, ids: list[int]) -> int:
        n = len(self.ends) - 1
        if len(piece) <= 64 and len(self.slot) < self.most:
            self.slot[piece] = n
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        return n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end as uint32, offsets of each text); null counts as empty."""
        data, at = buffers(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        full, kept = len(self.slot) >= self.most, (len(self.ends), len(self.flat))
        cuts = cut_pieces(data, at)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32)
        use = slots[coded.indices.to_numpy()]
        start, size = ends[use], ends[use + 1] - ends[use]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(start - total[:-1], size) + np.arange(total[-1])] if total[-1] else np.empty(0, np.uint32)
        del ends, flat  # the arrays can change their size again
        if full:
            del self.ends[kept[0] :], self.flat[kept[1] :]
        return ids, total[np.searchsorted(cuts, at)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
