"""Sets of hashed five-word shingles of whole texts (numpy, batch by batch)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
_MUL, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)
CACHE = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def blank_parted(data: np.ndarray, ends: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words (runs of bytes that are not ASCII white space) of the texts that lie end to end
    in ``data`` (bytes) and stop at ``ends``, and the number of words of each."""
    ink = ~_BLANK[data]
    fresh, last = ink.copy(), ink.copy()
    fresh[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    fresh[edges], last[edges - 1] = ink[edges], ink[edges - 1]
    first = np.flatnonzero(fresh)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - first)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[ink])])
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """``split(text) -> list[bytes]`` gives the words; the default lower-cases A-Z
    and cuts at ASCII white space, all texts of a call at once."""

    def __init__(self, split=None):
        self.split = split
        self.hashes = _Words()

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words of the texts, and the number of words of each."""
        if self.split is None:
            return self._blank_parted(texts)
        if len(self.hashes) > CACHE:
            self.hashes.clear()
        lists = [self.split(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.hashes.__getitem__
        return np.fromiter((get(x) for ws in lists for x in ws), np.uint64, int(sizes.sum())), sizes

    @staticmethod
    def _blank_parted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        words, sizes = blank_parted(np.frombuffer(b"".join(raw).lower(), np.uint8), ends)
        own = words.dictionary_encode()  # each word is hashed once
        each = own.dictionary.to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))
        return hashes[own.indices.to_numpy()], sizes

    def sequences(self, texts: list[str]) -> list[np.ndarray]:
        """The shingle hashes of each text, in order; a text of fewer than
        ``WIDTH`` words has one of the whole sequence, one without words none."""
        return self.sequences_of(*self.words(texts))

    def sequences_of(self, w: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """``sequences`` from ``words``."""
        h = w.copy()
        for k in range(1, WIDTH):
            h = h * _MUL
            h[:max(0, len(w) - k)] += w[k:]
        h = mix(h)
        ends = np.cumsum(sizes)
        out = []
        for n, e in zip(sizes.tolist(), ends.tolist()):
            if n >= WIDTH:
                out.append(h[e - n:e - WIDTH + 1])
            elif n:
                own = np.uint64(xxhash.xxh3_64_intdigest(w[e - n:e].tobytes(), seed=n))
                out.append(np.array([own], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The distinct shingle hashes of each text, rising."""
        out = []
        for h in map(np.sort, self.sequences(texts)):
            new = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=new[1:])
            out.append(h if new.all() else h[new])
        return out
