"""Toxicity by nearest labelled examples: exact TF-IDF cosine on block-max inverted
lists, distance-weighted votes calibrated to scores, and evidence.

Learning uses a bounded sample of distinct labelled texts, by text hash: at most
``MAX_EXAMPLES``, and ``MAX_POSTINGS`` distinct words in sum.  Every example is
indexed by all its words and every text that has words is searched whole, where it
is read.  The weight of a word is (1 + log tf) * idf * (1 + how surely it is commoner in
toxic examples): with idf alone the words of a long text that say nothing choose its
neighbours.  The score is a function of the neighbours' vote only.  It is calibrated by
a logistic fit on the examples' own votes, each left out of its neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table
from .decontaminate import plain_bytes, plain_words
from .shingles import _Words, blank_parted
from .tokens import chunks

MAX_EXAMPLES, MAX_POSTINGS = 20_000, 1 << 23
NEIGHBOURS, BLOCK, THRESHOLD = 15, 64, 0.7
SURE = 2.0  # standard errors that a word's log odds must exceed to count
FIRST = 4  # blocks that a text's search begins with
CENTRES, ROUNDS, CLUSTERED = 96, 4, 256  # of the clustering (by so many words) that puts similar examples into the same blocks
QUERIES = 256  # texts whose scores are held at once
DENSE_BYTES = 64 << 20  # weights of the commonest words, by example
LEARNED = 300_000  # words that a task keeps looked up
RIDGE = 0.001


def leaning(t, c, n_toxic: int, n_clean: int) -> np.ndarray:
    """The log odds of words to be in a toxic example against a clean one (``t`` and ``c``
    of them), less ``SURE`` standard errors; 0 where that is below 0."""
    t, c = np.asarray(t, np.float64), np.asarray(c, np.float64)
    odds = np.log((t + 0.5) / (n_toxic - t + 0.5)) - np.log((c + 0.5) / (n_clean - c + 0.5))
    return np.maximum(0.0, odds - SURE * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))


class Terms(dict):
    """Word -> its number in the examples' words (-1: in none), made as words come."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray):
        super().__init__()
        self.hashes, self.weight = hashes, weight

    def learn(self, words: list[bytes]) -> None:
        """Look the new ones of distinct words up."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > LEARNED:
            self.clear()
            new = words
        if not new:
            return
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        at = np.searchsorted(self.hashes, h)
        known = np.flatnonzero(at < len(self.hashes))
        hit = np.full(len(new), -1, np.int64)
        hit[known] = np.where(self.hashes[at[known]] == h[known], at[known], -1)
        self.update(zip(new, hit.tolist()))

    def vectors(self, texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, dict[int, bytes]]:
        """Of the plain bytes of all texts at once: (numbers, weights scaled to length 1) of each one's
        words, how many words it has, and the words by number.  Words that no example has
        would only scale all its cosines alike."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        words, sizes = blank_parted(np.frombuffer(b"".join(texts), np.uint8), ends)
        words = words.dictionary_encode()  # each word is looked up once
        each = words.dictionary.to_pylist()
        self.learn(each)
        number = np.fromiter(map(self.__getitem__, each), np.int64, len(each))
        ids = number[words.indices.to_numpy()]
        key = np.repeat(np.arange(len(texts)) * len(self.hashes), sizes) + ids
        key, tf = np.unique(key[ids >= 0], return_counts=True)
        doc, ids = np.divmod(key, max(1, len(self.hashes)))
        weight = (1 + np.log(tf)) * self.weight[ids]
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        return [(ids[i:j], scaled(weight[i:j])) for i, j in zip(cuts, cuts[1:])], sizes, dict(zip(number.tolist(), each))


def scaled(w: np.ndarray) -> np.ndarray:
    return w / np.sqrt((w * w).sum()) if len(w) else w


class BlockMaxIndex:
    """Inverted lists of all words.  Those of the commonest words (one example in 20 and
    more, up to ``DENSE_BYTES``) are matrices by block of ``BLOCK`` examples, with the
    largest weight of each word in each block.  A text's rarer words are summed first; the
    largest sum in a block and the text's weights times the block's maxima bound its cosines
    there, and a block whose bound stays under the k-th cosine found so far is skipped."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self._hold((np.concatenate([t for t, _ in vectors]).astype(np.int32) if vectors else np.zeros(0, np.int32),
                           np.concatenate([w for _, w in vectors]).astype(np.float32) if vectors else np.zeros(0, np.float32),
                           np.cumsum([0, *(len(t) for t, _ in vectors)]), n_terms))

    @classmethod
    def of(cls, own: np.ndarray, weight: np.ndarray, starts: np.ndarray, n_terms: int) -> BlockMaxIndex:
        out = cls.__new__(cls)
        out._hold((own, weight, starts, n_terms))
        return out

    def _hold(self, state):
        self.own, self.own_weight, self.starts, self.n_terms = state
        self.n, self.built = len(self.starts) - 1, False

    __setstate__ = _hold

    def __getstate__(self):
        return self.own, self.own_weight, self.starts, self.n_terms

    def _build(self):
        """The lists, made where they are first used."""
        self.built = True
        self.row = common_words(self.own, self.n, self.n_terms)
        self.n_blocks = -(-self.n // BLOCK)
        example = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))
        row = self.row[self.own]
        at, e = row[row >= 0], example[row >= 0]
        self.dense = np.zeros((self.n_blocks, int(self.row.max(initial=-1)) + 1, BLOCK), np.float32)
        self.dense[e // BLOCK, at, e % BLOCK] = self.own_weight[row >= 0]
        self.dense_most = np.ascontiguousarray(self.dense.max(axis=2).T)
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(self.own[rare], kind="stable")]
        # example and weight side by side: a word's are one slice
        self.pairs = np.empty(len(rare), np.int64)
        self.pairs.view(np.int32)[::2], self.pairs.view(np.float32)[1::2] = example[rare], self.own_weight[rare]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(self.own[rare], minlength=self.n_terms))])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k largest cosines (over 0) and their examples; of ties the lower number."""
        return self.nearest_of([(terms, weights)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """``nearest`` of each text, ``QUERIES`` with similar bounds at once."""
        if not self.built:
            self._build()
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        if not self.n:
            return out
        common = np.zeros((len(queries), self.dense.shape[1]), np.float32)
        for i, (t, w) in enumerate(queries):
            row = self.row[t]
            common[i, row[row >= 0]] = w[row >= 0]
        bound = common @ self.dense_most
        full = np.zeros(self.n_terms)
        order = np.argsort(bound.argmax(axis=1), kind="stable")
        for at in range(0, len(order), QUERIES):
            part = order[at:at + QUERIES]
            score = np.zeros((len(part), self.n_blocks, BLOCK), np.float32)
            for own, q in zip(score, part.tolist()):
                t, w = queries[q]
                first, n = self.cuts[t], self.cuts[t + 1] - self.cuts[t]
                first, w, n = first[n > 0], w[n > 0], n[n > 0]
                if len(n):
                    pairs = _slices(self.pairs, first, n)
                    own.reshape(-1)[:] = np.bincount(pairs.view(np.int32)[::2], np.repeat(w.astype(np.float32), n) * pairs.view(np.float32)[1::2],
                                                     self.n_blocks * BLOCK)
            most = bound[part] + score.max(axis=2)
            need = np.zeros(most.shape, bool)
            need[np.arange(len(part))[:, None], np.argsort(-most, axis=1)[:, :FIRST]] = True
            self._add(score, common[part], need)
            # the k-th cosine is no less than the k-th of the best blocks' sums, nor of all blocks' largest
            least = _kth(score.max(axis=2), k)
            least = np.maximum(least, _kth(score[need].reshape(len(part), -1), k))
            self._add(score, common[part], (most > 0) & (most >= (least - 1e-4)[:, None]) & ~need)
            most = score.max(axis=2)
            least = np.maximum(least, _kth(most, k))
            for i, q in enumerate(part.tolist()):
                t, w = queries[q]
                full[t] = w
                out[q] = self._best(score[i], most[i], float(least[i]) - 1e-4, full, k)
                full[t] = 0
        return out

    def _add(self, score: np.ndarray, common: np.ndarray, need: np.ndarray) -> None:
        """Add the common words' part of each text's cosines with the blocks that it needs."""
        for b in np.flatnonzero(need.any(axis=0)).tolist():
            rows = np.flatnonzero(need[:, b])
            score[rows, b] += common[rows] @ self.dense[b]

    def _best(self, score: np.ndarray, most: np.ndarray, least: float, full: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The candidates by single precision, ordered by double."""
        blocks = np.flatnonzero((most > 0) & (most >= least))
        own = score[blocks]
        b, e = np.nonzero((own > 0) & (own >= least))
        at, own = blocks[b] * BLOCK + e, own[b, e]
        if len(at) > k:
            at = at[own >= np.partition(own, len(own) - k)[len(own) - k] - 1e-4]
        if not len(at):
            return []
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        exact = np.add.reduceat(full[_slices(self.own, first, n)] * _slices(self.own_weight, first, n), np.cumsum(n) - n)
        order = np.argsort(-exact, kind="stable")[:k]
        return [(min(1.0, s), e) for s, e in zip(exact[order].tolist(), at[order].tolist())]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; 0 where there are not as many."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.zeros(len(x), np.float32)


def _slices(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slices of ``x`` that start at ``first`` and are ``n`` long, one after the other."""
    return np.concatenate([x[i:j] for i, j in zip(first.tolist(), (first + n).tolist())])


def common_words(own: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """The row of each word that is in one of 20 of the ``n`` examples and more, else -1."""
    df = np.bincount(own, minlength=n_terms)
    common = np.argsort(-df, kind="stable")[:DENSE_BYTES // (4 * max(1, n))]
    common = common[df[common] >= max(8, n / 20)]
    row = np.full(n_terms, -1, np.int64)
    row[common] = np.arange(len(common))
    return row


def similar_order(own: np.ndarray, weight: np.ndarray, starts: np.ndarray, n_terms: int) -> np.ndarray:
    """The examples in an order that has similar ones side by side: a few rounds of k-means
    over their common words, from evenly spaced examples."""
    n = len(starts) - 1
    row = common_words(own, n, n_terms)
    if n <= BLOCK or not (row >= 0).any():
        return np.arange(n)
    row[row >= CLUSTERED] = -1
    x = np.zeros((n, int(row.max()) + 1), np.float32)
    example = np.repeat(np.arange(n), np.diff(starts))
    at = row[own]
    x[example[at >= 0], at[at >= 0]] = weight[at >= 0]
    centre = x[np.linspace(0, n - 1, min(CENTRES, n)).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        near = (x @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            if (near == c).any():
                centre[c] = scaled(x[near == c].sum(axis=0))
    close = x @ centre.T
    return np.lexsort((-close.max(axis=1), close.argmax(axis=1)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + RIDGE * len(x) ** 0.5 * np.eye(len(w)),
                               x.T @ (y - p) - RIDGE * len(x) ** 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Examples:
    """What all tasks share: the examples' words, labels and index."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (hash of the text, doc_id, label, word hashes, counts), in a fixed order."""
        size = np.array([len(r[3]) // 8 for r in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(int(starts[-1]), np.uint64)
        for r, i, j in zip(rows, starts[:-1], starts[1:]):
            flat[i:j] = np.frombuffer(r[3], "<u8")
        rising = np.sort(flat)
        first = np.flatnonzero(np.r_[True, rising[1:] != rising[:-1]]) if len(rising) else np.zeros(0, np.int64)
        self.hashes = rising[first]
        del rising
        ids, weights = np.empty(len(flat), np.int32), np.empty(len(flat), np.float32)
        for i, j in zip(starts[:-1], starts[1:]):
            ids[i:j] = np.searchsorted(self.hashes, flat[i:j])
        del flat
        labels = np.array([r[2] for r in rows], np.int64)
        df = np.bincount(ids, minlength=len(self.hashes))
        toxic = np.bincount(ids[np.repeat(labels == 1, size)], minlength=len(self.hashes))
        self.leans = leaning(toxic, df - toxic, int(labels.sum()), len(rows) - int(labels.sum()))
        self.weight = (np.log((1 + len(rows)) / (1 + df)) + 1) * (1 + self.leans)
        for r, i, j in zip(rows, starts[:-1], starts[1:]):
            weights[i:j] = scaled((1 + np.log(np.frombuffer(r[4], "<u4"))) * self.weight[ids[i:j]])
        order = similar_order(ids, weights, starts, len(self.hashes))
        ids, weights = (np.concatenate([x[:0], *(x[starts[i]:starts[i + 1]] for i in order.tolist())]) for x in (ids, weights))
        self.index = BlockMaxIndex.of(ids, weights, np.concatenate([[0], np.cumsum(size[order])]), len(self.hashes))
        self.doc_ids, self.labels = [rows[i][1] for i in order.tolist()], labels[order]
        h = np.array([r[0] for r in rows], np.int64)[order]
        self.by_hash = np.argsort(h)
        self.h = h[self.by_hash]
        self.share = float(labels.mean()) if rows else 0.0

    def terms(self) -> Terms:
        return Terms(self.hashes, self.weight)

    def numbers(self, h: np.ndarray) -> list[int]:
        """The examples with these text hashes."""
        return self.by_hash[np.searchsorted(self.h, h)].tolist()

    def vote(self, near: list[tuple[float, int]], left_out: int = -1) -> float:
        """The toxic share of the neighbours' cosines; without neighbours, of all examples."""
        own = [(s, e) for s, e in near if e != left_out][:NEIGHBOURS]
        total = sum(s for s, _ in own)
        return sum(s for s, e in own if self.labels[e]) / total if total else self.share


class Model:
    def __init__(self, shared, weights: np.ndarray, prior: float):
        """``shared``: the broadcast ``Examples``; ``prior``: score of texts without words."""
        self.shared, self.weights, self.prior = shared, weights, prior

    def scores(self, texts: list[list[bytes]], terms: Terms) -> list[tuple[float, list[int], str]]:
        """(score, nearest examples, words that drew toxic neighbours) of each text's words."""
        return self.scores_of([b" ".join(w) for w in texts], terms)

    def scores_of(self, texts: list[bytes], terms: Terms) -> list[tuple[float, list[int], str]]:
        """``scores`` from the texts' plain bytes."""
        own = self.shared.value
        out = []
        vectors, sizes, name = terms.vectors(texts)
        for words, (ids, weight), near in zip(sizes.tolist(), vectors, own.index.nearest_of(vectors)):
            x = float(self.weights[0] + self.weights[1] * own.vote(near))
            why = ""
            if x > 0 and len(ids):
                top = ids[np.argsort(-weight * (own.leans[ids] > 0), kind="stable")[:5]]
                why = ",".join(name[t].decode("utf-8", "replace") for t in top.tolist() if own.leans[t] > 0)
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) if words else self.prior,
                        [own.doc_ids[e] for _, e in near[:3]], why))
        return out


def held_out():
    """crc32 of the doc_id as text, mod 3, is 1; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that aren't held out (of repeated labels
    the highest counts; equal texts are one example, toxic if any is)."""
    own = kept(labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")), "labels")
    own = F.broadcast(own) if own.count() <= 1 << 20 else own
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("h")).join(own, "doc_id")
    distinct = kept(rows.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")), "distinct")
    # the sample's border: the MAX_EXAMPLES-th hash
    border = distinct.select("h").orderBy("h").limit(MAX_EXAMPLES).agg(F.max("h")).first()[0]
    chosen = F.broadcast(distinct.where(F.col("h") <= F.lit(border)).select("h", "doc_id", "toxic"))
    # at most MAX_EXAMPLES texts
    picked = kept(rows.drop("toxic").join(chosen, ["h", "doc_id"]).dropDuplicates(["h", "doc_id"]), "picked")

    def hashed(batches):
        words = _Words()
        for b in batches:
            if len(words) > 300_000:
                words.clear()
            for at, texts in chunks(b.column(3)):
                own = [np.unique(np.fromiter(map(words.__getitem__, x := plain_words(t)), np.uint64, len(x)), return_counts=True) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(at, len(texts)) for i in range(3)), pa.array([len(h) for h, _ in own], pa.int64()),
                     pa.array([h.astype("<u8").tobytes() for h, _ in own], pa.binary()),
                     pa.array([n.astype("<u4").tobytes() for _, n in own], pa.binary())], ["h", "doc_id", "toxic", "size", "words", "counts"])

    examples = kept(picked.select("h", "doc_id", "toxic", "text").mapInArrow(
        hashed, "h long, doc_id long, toxic int, size long, words binary, counts binary"), "examples")
    # the sample ends earlier if its texts have more than MAX_POSTINGS distinct words in sum
    sizes = sorted((r[0], r[1]) for r in examples.select("h", "size").collect())
    n = int(np.searchsorted(np.cumsum([s for _, s in sizes]), MAX_POSTINGS, side="right")) if sizes else 0
    inside = F.col("h") <= F.lit(sizes[n - 1][0]) if n else F.lit(False)
    rows = sorted((r[0], r[1], r[2], bytes(r[3]), bytes(r[4])) for r in examples.where(inside).select(
        "h", "doc_id", "toxic", "words", "counts").toLocalIterator())
    own = Examples(rows)
    del rows
    shared = documents.sparkSession.sparkContext.broadcast(own)

    def features(batches):
        m = shared.value
        terms = m.terms()
        for b in batches:
            for at, texts in chunks(b.column(2)):
                vectors, sizes, _ = terms.vectors([plain_bytes(t) for t in texts])
                near = m.index.nearest_of(vectors, NEIGHBOURS + 1)
                h = b.column(0).slice(at, len(texts))
                votes = [m.vote(e, i) for e, i in zip(near, m.numbers(h.to_numpy()))]
                yield pa.RecordBatch.from_arrays([h, b.column(1).slice(at, len(texts)), pa.array(sizes, pa.int64()),
                                                  pa.array(votes, pa.float64())], ["h", "toxic", "n_words", "vote"])

    found = sorted(tuple(r) for r in picked.where(inside).select("h", "toxic", "text").mapInArrow(
        features, "h long, toxic int, n_words long, vote double").collect())
    # calibration of the texts without words: their share of toxic examples
    none = [y for _, y, size, _ in found if not size]
    prior = (sum(none) + 0.5) / (len(none) + 1)
    some = [(1.0, x, y) for _, y, size, x in found if size]
    weights = _logistic(np.array(some)[:, :2], np.array(some)[:, 2]) if some else np.zeros(2)
    return Model(shared, weights, min(prior, 0.5))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest (doc_ids of the three nearest examples) and
    evidence (the words that drew toxic neighbours; empty below a score of 0.5).

    One row for each row: repeated rows score alike.  A null or empty text, and one without
    words, has the share of toxic examples among such texts, 0.5 at most; a text whose words
    no example has votes as all examples do.  A null doc_id is never held out.  Of equal
    cosines the example that comes first in the index counts.  Empty tables give no rows;
    without examples every score is 0.5.  Other columns are not read.
    """
    def run(batches):
        terms = model.shared.value.terms()
        for b in batches:
            for at, texts in chunks(b.column(2)):
                once = list(dict.fromkeys(texts))  # copies score alike
                found = dict(zip(once, model.scores_of([plain_bytes(t) for t in once], terms)))
                s, near, why = zip(*(found[t] for t in texts))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(s, pa.float64()),
                     pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array(near, pa.list_(pa.int64())),
                     pa.array(why, pa.string())], ["doc_id", "held_out", "score", "predicted", "nearest", "evidence"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, evidence string")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
