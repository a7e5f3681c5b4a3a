"""Words of many texts at once, and the measuring pass without signatures."""

import numpy as np
import pyarrow as pa
import xxhash

from segmint.llm import jaccard_join
from segmint.llm.shingles import Shingler, blank_parted

TEXTS = ["", " ", "a", "A b", "  x  Y ", "\n", "É é \x0b z", "\ud800 a b c d e f", "a\xa0b \x1c c\x00d", "", "one two three four five six\t",
         "a", "b", "日本 \r\n語", "one two three four five one two three four five", "", "\x85  x　 y"]


def _split(text):
    return text.encode("utf-8", "surrogatepass").lower().split()


def test_words_of_texts_laid_end_to_end():
    for texts in (TEXTS, [], [""], [" ", ""], ["a"], TEXTS[::-1]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        words, sizes = blank_parted(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64))
        assert words.to_pylist() == [w for x in raw for w in x.split()]
        assert sizes.tolist() == [len(x.split()) for x in raw]
        for a, b in zip(Shingler().sets(texts), Shingler(_split).sets(texts), strict=True):
            assert a.dtype == b.dtype and a.tolist() == np.unique(b).tolist()


def test_a_word_is_hashed_once_a_call(monkeypatch):
    seen = []

    class Hash:
        def __getattr__(self, name):
            return lambda x, **options: seen.append(x) or getattr(xxhash, name)(x, **options)

    monkeypatch.setattr("segmint.llm.shingles.xxhash", Hash())
    sh = Shingler()
    sh.words(["a b a", "A c\nb"])
    assert sorted(seen) == [b"a", b"b", b"c"] and not sh.hashes


def test_measuring_makes_no_signatures(monkeypatch):
    texts = [*TEXTS[:7], " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(400))]
    want = jaccard_join.signatures(Shingler().sets(texts))[1]
    found = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            keys = pa.array(range(len(texts)))
            found.extend(run(iter([pa.record_batch([keys, keys, pa.array(texts)], ["doc_id", "text_key", "text"])])))

    class Column:
        cast = alias = lambda self, *_: self

    monkeypatch.setattr(jaccard_join, "signatures", None)
    monkeypatch.setattr(jaccard_join, "F", type("F", (), {"col": lambda *_: Column(), "xxhash64": lambda *_: Column()})())
    jaccard_join.measured(Rows())
    got = [r for b in found for r in b.to_pylist()]
    assert [[r["tol0"] for r in got], [r["tol1"] for r in got]] == [t.tolist() for t in want]
    assert any(t.any() for t in want)
