"""Exact token ids of whole texts with a public tokenizer file, batch by batch.

Both tokenizers cut a text before they merge, and never across the cuts made
here (white space, as their own patterns treat it).  So each distinct piece is
encoded by the library once per task and looked up afterwards.  Texts in which
a piece could differ from the whole (special tokens' strings, white space
other than ASCII) are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Strings of special tokens, and characters that only some engines call white space.
_ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0 ᠎ -‏    -⁤　﻿]")
#: Both tokenizers part a run of letters from a run of these after it.
_SIGNS = "!\"#$%&()*+,./:;=>?@[\\]^_`{}~-"
#: A run of letters, which no pattern parts, no normaliser but lower case changes, and which stand for one word of the model.
_LATIN = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_LETTERS = re.compile(f" ?[{_LATIN}]+").fullmatch
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER_BYTE = np.isin(np.arange(256), [ord(c) for c in _LATIN if c.isascii()])
_SIGN_BYTE = np.isin(np.arange(256), [ord(c) for c in _SIGNS])
CACHE = 800_000  # pieces, about 150 bytes each
CHUNK_BYTES, TOKEN_CHUNK = 4 << 20, 8 << 20


def _odd(text: str) -> bool:
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _ODD.search(text) is not None


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def id_kind(path: str) -> str:
    """The little-endian unsigned kind that holds every id of the vocabulary."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


class Encoder:
    """``kind``: ``byte`` (white space is part of tokens) or ``word`` (dropped, lower case)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.kind = kind
        self.model = self.lib.model
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = str.maketrans({c: signs(c)[0][0] for c in _LATIN + " "} | {"\0": "\0"})
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _add(self, pieces: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        first, total = len(self.index), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(pieces) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used:self.used + total] = ids
        self.starts[first:first + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:first + len(pieces)] = lengths
        self.index.update(zip(pieces, range(first, first + len(pieces))))
        self.used += total

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of known pieces by number."""
        n = self.lengths[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], n

    def _spelled(self, pieces: list[str]) -> list[str]:
        """Runs of letters in the signs that the model has for their bytes."""
        text = "\0".join(pieces)
        if self.kind == "word":
            text = text.lower()
        return (text.replace(" ", "Ġ") if text.isascii() else text.translate(self.signs)).split("\0")

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of each piece.  ``pieces``: all runs of letters, which go to its model
        as they are, or all others, which take the way of whole texts."""
        if _LETTERS(pieces[0]):
            tokenize = self.model.tokenize
            return [[t.id for t in tokenize(p)] for p in self._spelled(pieces)]
        return [e.ids for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        kinds = [], [], []  # others, runs of letters, runs of ASCII letters
        for p in pieces:
            kinds[_LETTERS(p) is not None and 1 + p.isascii()].append(p)
        for some in kinds:
            for at in range(0, len(some), 4096):
                part = some[at:at + 4096]
                ids = self._ids(part)
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                self._add(part, n, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())))

    def _evict(self) -> None:
        """Keep the pieces that came twice or more, at most half of the cache."""
        hits = self.hits[:len(self.index)]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > CACHE // 2:
            keep = np.sort(np.argpartition(hits, -(CACHE // 2))[-(CACHE // 2):])
        marked = np.zeros(len(hits), bool)
        marked[keep] = True
        pieces = [p for p, k in zip(self.index, marked.tolist()) if k]  # numbers rise with insertion
        ids, n = self._gather(keep)
        self._clear()
        self._add(pieces, n, ids)

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; new ones are learned."""
        if len(self.index) > CACHE:
            self._evict()
        rows = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(rows < 0)):
            new = [pieces[i] for i in missing.tolist()]
            self._learn(new)
            rows[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        return rows

    def _parted(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of all texts, and where those of each text start and the last one's end."""
        stops = np.frombuffer(texts.buffers()[1], np.int32)[:len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[:stops[-1]]
        blank = _BLANK[data]
        edges = np.zeros(len(data) + 1, bool)  # where texts start
        edges[stops] = True
        edges = edges[:-1]
        turn = edges.copy()
        turn[1:] |= blank[1:] != blank[:-1]
        tail = np.zeros(len(data), bool)
        tail[1:] = _SIGN_BYTE[data[1:]] & self._letters(data)[:-1]  # the first sign after letters
        if self.kind == "word":
            start = np.flatnonzero((turn | tail) & ~blank)
            size = np.diff(np.cumsum(np.concatenate([[False], ~blank]), dtype=np.int32)[np.append(start, len(data))])
            data = data[~blank]
        else:
            # a run of white space is parted before its last character if a word follows; a word takes a space before it
            start = turn & (blank | edges)
            start[:-1] |= blank[:-1] & ~blank[1:] & ~edges[1:]
            start[1:] |= ~blank[1:] & blank[:-1] & (data[:-1] != 32)
            start = np.flatnonzero(start | tail)
            size = np.diff(np.append(start, len(data)))
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(start, stops)

    @staticmethod
    def _letters(data: np.ndarray) -> np.ndarray:
        """Which bytes end a letter of A-Z, a-z, U+00C0 to U+00FF."""
        letters = _LETTER_BYTE[data]
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1
        letters[wide] = (data[wide] != 0x97) & (data[wide] != 0xB7)
        return letters

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text (uint32), with ``end`` appended."""
        tail = np.array([] if end is None else [end], np.uint32)
        whole = ["\0" in t or _odd(t) for t in texts]
        if self.kind == "word":  # the tokenizer lower-cases too
            own = ["" if w else t.lower() if t.isascii() else t for t, w in zip(texts, whole)]
        else:
            own = ["" if w else t for t, w in zip(texts, whole)]
        pieces, stops = self._parted(pa.array(own, pa.string()))
        pieces = pieces.dictionary_encode()  # a chunk's pieces, each once
        known = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        rows = known[pieces.indices.to_numpy()]
        if len(self.hits) < len(self.starts):
            self.hits = np.concatenate([self.hits, np.zeros(len(self.starts) - len(self.hits), np.int32)])
        self.hits[known] += np.bincount(pieces.indices, minlength=len(known)).astype(np.int32)
        ids, n = self._gather(rows)
        cuts = np.concatenate([[0], np.cumsum(n)])[stops]
        out = []
        for i, (t, w) in enumerate(zip(texts, whole)):
            own = self.lib.encode(t, add_special_tokens=False).ids if w else ids[cuts[i]:cuts[i + 1]]
            out.append(np.concatenate([np.asarray(own, np.uint32), tail]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """One for the life of a Python worker: its pieces serve later tasks too."""
    return Encoder(path, kind)


def chunks(column, limit: int = CHUNK_BYTES):
    """(first row, texts) of an Arrow string column, few bytes at a time; null is empty."""
    first, texts, size = 0, [], 0
    for i, v in enumerate(column):
        t = v.as_py() or ""
        if texts and size + len(t) > limit:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts
