"""Token ids of whole texts by way of context-free chunks.

Byte-level BPE cuts a text into pieces before it merges, and a single blank or line feed between
two characters that aren't white space is always such a cut: the blank belongs to the piece that
follows, the line feed is a piece of its own. So a text falls into chunks whose ids don't depend
on their neighbours, and each distinct chunk needs to be encoded only once per worker.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides the blank and the line feed, in the widest sense of any of the libraries.
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"
_SOLID = rf"[^ \n{_OTHER_SPACE}]"
_CUT = re.compile(rf"(?<={_SOLID})(?= {_SOLID})|(?<={_SOLID})(?=\n{_SOLID})|(?<={_SOLID}\n)(?={_SOLID})")


def is_plain(text: str) -> bool:
    """Whether all white space of ``text`` is single blanks and line feeds between other characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return text.isascii() and text.isprintable() or not any(c in text for c in _OTHER_SPACE)


class _Numbers(dict):
    """Numbers keys in the order of their first look-up and keeps new ones in ``fresh``."""

    def __init__(self, prefix: str, owner: "ChunkVocabulary"):
        super().__init__()
        self.prefix, self.owner = prefix, owner

    def __missing__(self, key: str) -> int:
        owner = self.owner
        number = self[key] = owner.size + len(owner.fresh)
        owner.fresh.append(self.prefix + key)
        return number


class ChunkVocabulary:
    """Ids of distinct chunks, as one flat array with offsets, filled as texts come.

    ``encode_chunks`` maps a list of distinct chunks to (flat ids, number of ids of each). Beyond
    ``max_chunks`` entries those that were met first, which are the frequent ones, stay, up to half as
    many, and the others go: that bounds memory and changes no result.
    """

    def __init__(self, encode_chunks, max_chunks: int = 200_000):
        self.encode_chunks, self.max_chunks = encode_chunks, max_chunks
        self.bare, self.spaced = _Numbers("", self), _Numbers(" ", self)
        self.fresh: list[str] = []
        self.size = 0
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)

    def _shrink(self) -> None:
        size = self.max_chunks // 2
        for name in ("bare", "spaced"):
            old = getattr(self, name)
            new = _Numbers(old.prefix, self)
            new.update((k, n) for k, n in old.items() if n < size)
            setattr(self, name, new)
        self.starts = self.starts[: size + 1].copy()
        self.ids = self.ids[: self.starts[-1]].copy()
        self.size = size

    def _absorb(self) -> None:
        if not self.fresh:
            return
        ids, counts = self.encode_chunks(self.fresh)
        used, n = int(self.starts[self.size]), self.size + len(self.fresh)
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used // 2 + len(ids), np.int32)])
        if n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[: self.size + 1], np.zeros(n + n // 2, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.starts[self.size + 1 : n + 1] = used + np.cumsum(counts)
        self.size, self.fresh = n, []

    def _number(self, text: str, out: array) -> None:
        bare, spaced = self.bare, self.spaced
        if not is_plain(text):
            out.extend([spaced[c[1:]] if c[:1] == " " else bare[c] for c in _CUT.split(text)] if text else [])
            return
        feed = bare["\n"]
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append(feed)
            out.append(bare[words[0]])
            del words[0]
            out.extend(map(spaced.__getitem__, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if self.size > self.max_chunks:
            self._shrink()
        numbers, edges = array("i"), [0]
        for t in texts:
            self._number(t, numbers)
            edges.append(len(numbers))
        self._absorb()
        chunk = np.frombuffer(numbers, np.int32) if len(numbers) else np.empty(0, np.int32)
        begins = self.starts[chunk]
        lens = self.starts[chunk + 1] - begins
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begins - upto[:-1], lens)]
        return ids, np.diff(upto[edges])


def text_slices(column: pa.Array, max_bytes: int = 1 << 21):
    """(from, to) of runs of rows with about ``max_bytes`` of text: bounds what is worked on at once."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for k, n in enumerate(sizes.tolist()):
        if size and size + n > max_bytes:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def release() -> None:
    """Give memory that a task has freed back to the system: Python workers outlive their tasks, and what
    they keep counts against the executor that runs other stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
