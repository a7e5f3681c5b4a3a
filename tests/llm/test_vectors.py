"""Word vectors of many texts at once (op4)."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from segmint.llm import toxicity
from segmint.llm.decontaminate import plain_bytes, plain_words

TEXTS = ["", " ", "a", "A b", "b!a,A", "", "unseen", "\n", "É é x", "a", "一 b-b 二", "unseen words a a a", "b"]


@pytest.mark.parametrize("learned", [2, 1000])
def test_vectors_of_texts_laid_end_to_end(monkeypatch, learned):
    monkeypatch.setattr(toxicity, "LEARNED", learned)
    known = [w.encode() for w in ("a", "b", "x", "é", "一")]
    hashes = np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in known], np.uint64))
    weight = np.arange(1.0, 6.0)
    number = {w: int(np.searchsorted(hashes, xxhash.xxh3_64_intdigest(w))) for w in known}
    terms = toxicity.Terms(hashes, weight)
    looked_up = []
    monkeypatch.setattr(terms, "learn", lambda words: looked_up.extend(words) or toxicity.Terms.learn(terms, words), raising=False)
    for texts in (TEXTS, [], [""], ["", ""], ["b"], TEXTS[::-1]):
        looked_up.clear()
        vectors, sizes, name = terms.vectors([plain_bytes(t) for t in texts])
        assert sizes.tolist() == [len(plain_words(t)) for t in texts] and len(vectors) == len(texts)
        # each word is looked up once, however many texts have it
        assert sorted(looked_up) == sorted({w for t in texts for w in plain_words(t)})
        for t, (ids, w) in zip(texts, vectors):
            tf = Counter(number[x] for x in plain_words(t) if x in number)
            raw = np.array([(1 + np.log(tf[i])) * weight[i] for i in sorted(tf)])
            assert ids.tolist() == sorted(tf) and np.allclose(w, raw / np.linalg.norm(raw) if len(raw) else raw)
            assert all(number[name[i]] == i for i in ids.tolist())
    empty = toxicity.Terms(np.zeros(0, np.uint64), np.zeros(0))
    assert [len(ids) for ids, _ in empty.vectors([b"a b", b""])[0]] == [0, 0]


def test_slices():
    x = np.arange(100, 120)
    first, n = np.array([3, 0, 19, 7, 7]), np.array([2, 4, 1, 0, 3])
    assert toxicity._slices(x, first, n).tolist() == [103, 104, 100, 101, 102, 103, 119, 107, 108, 109]
