"""Language by nearest centroid: TF-IDF vectors of character n-grams, several
clustered centroids per language, cosine distance, rejection by distance.

A text's vector counts its n-grams of one to three code points (lower-cased; what
isn't a letter is a gap) in ``DIM`` hashed places, damped by a logarithm, weighted by
the inverse document frequency over all training rows, and normalised.  Each
language's vectors are clustered by spherical k-means.  A text gets the language of
the nearest centroid; one farther from it than nearly all of its cluster is rejected.

Document frequencies and counts cover all training rows.  The clusters are fitted on
at most about ``SAMPLE`` rows a language, chosen by hash, of the ``LANGUAGES`` commonest
languages, so the model has a fixed bound of LANGUAGES * CENTROIDS * DIM numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table
from .shingles import mix

BITS = 13
DIM = 1 << BITS
CENTROIDS, ROUNDS, LANGUAGES, SAMPLE = 4, 12, 200, 2000
#: A cluster with a smaller share of its language's sample is dissolved.
LEAST_SHARE = 0.05
#: A text is rejected beyond its cluster's mean distance plus so many standard deviations.
REACH = 4.0
UNKNOWN = "und"
#: Texts that are counted together: so many, or so many code points.
TEXTS, POINTS = 64, 1 << 20
#: Fixed odd multipliers of the places of an n-gram.
_P = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@cache
def _is_letter() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased code points of all texts (0 where there is no letter; each text
    stands between zeros) and the text that each belongs to."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(f"\0{t}\0" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)) + 2)
    return np.where(_is_letter()[points], points, 0).astype(np.uint64), owner


def counts(texts: list[str]) -> np.ndarray:
    """One row of ``DIM`` n-gram counts per text."""
    c, owner = letters(texts)
    places = []
    one, two, three = c, c[:-1] * _P[0] + c[1:], (c[:-2] * _P[0] + c[1:-1]) * _P[1] + c[2:] * _P[2]
    for h, has, n in ((one, c > 0, 1), (two, (c[:-1] > 0) | (c[1:] > 0), 2), (three, c[1:-1] > 0, 3)):
        at = np.flatnonzero(has)
        slot = mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)
        places.append(owner[at] * DIM + slot.astype(np.int64))
    return np.bincount(np.concatenate(places), minlength=len(texts) * DIM).reshape(len(texts), DIM)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a text without letters has zeros."""
    x = np.zeros(n.shape)
    at = np.nonzero(n)
    x[at] = np.log1p(n[at]) * idf[at[1]]
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with few texts and code points (a longer text is alone)."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            n = len(t or "")
            if i > start and (i - start >= TEXTS or size + n > POINTS):
                yield batch.slice(start, i - start), [x or "" for x in texts[start:i]]
                start, size = i, 0
            size += n
        if len(texts) > start:
            yield batch.slice(start), [x or "" for x in texts[start:]]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIM, np.int64)
    for _, texts in _groups(batches):
        total += (counts(texts) > 0).sum(axis=0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["place", "df"])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """The number of ``rows`` (text) that have an n-gram in each place: one sum a place."""
    parts = rows.select("text").mapInArrow(_frequencies, "place int, df long")
    out = np.zeros(DIM, np.int64)
    for r in parts.groupBy("place").agg(F.sum("df").alias("df")).collect():  # DIM rows at most
        out[r.place] = r.df
    return out


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: (centroids, the cluster of each row)."""
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]]
    member = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        member = np.argmax(x @ centres.T, axis=1)
        share = np.bincount(member, minlength=len(centres))
        alive = np.flatnonzero(share >= min(LEAST_SHARE * len(x), share.max()))
        sums = np.stack([x[member == i].sum(axis=0) for i in alive])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, np.argmax(x @ centres.T, axis=1)


@dataclass
class Model:
    """Centroids (rows), the language of each, its reach (distance), and the weights.
    Languages stand in the order that decides ties: the commonest first, then by name."""
    languages: list[str]
    of: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray
    idf: np.ndarray

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, distance, rejected) of each text."""
        n = counts(texts)
        letterless = ~n.any(axis=1)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), np.ones(len(texts), bool)
        # rounded, as a product's last digits depend on the texts beside
        d = np.round(1.0 - np.clip(vectors(n, self.idf) @ self.centroids.T, 0.0, 1.0), 9)
        per = np.full((len(texts), len(self.languages)), 1.0)
        for i in range(len(self.languages)):
            per[:, i] = d[:, self.of == i].min(axis=1)
        best = per.argmin(axis=1)
        row = np.arange(len(texts))
        nearest = np.where(self.of[None, :] == best[:, None], d, 2.0).argmin(axis=1)
        first = per[row, best]
        per[row, best] = np.inf
        second = np.minimum(per.min(axis=1), 1.0)
        reach = self.reach[nearest]
        rejected = (first > reach) | letterless
        margin = np.where(second > 0, (second - first) / np.maximum(second, 1e-12), 0.0)
        score = np.where(rejected, 0.5 * np.minimum(1.0, reach / np.maximum(first, 1e-12)) * (1.0 - first), 0.5 + 0.5 * margin)
        score = np.where(letterless, 0.0, np.clip(score, 0.0, 1.0))
        names = [UNKNOWN if no else self.languages[i] for no, i in zip(letterless.tolist(), best.tolist())]
        return names, score, first, rejected


def _clusters(idf, k: int):
    def fit(part: pa.Table) -> pa.Table:
        x = np.zeros((len(part), DIM), np.float32)
        places, weights = part["places"].combine_chunks(), part["weights"].combine_chunks()
        row = np.repeat(np.arange(len(part)), np.diff(places.offsets.to_numpy()))
        x[row, places.flatten().to_numpy()] = weights.flatten().to_numpy()
        centres, member = cluster(x, k)
        d = 1.0 - (x * centres[member]).sum(axis=1)
        reach = [float(d[member == i].mean() + REACH * d[member == i].std()) if (member == i).any() else 0.0 for i in range(len(centres))]
        return pa.table({"lang": pa.array([part["lang"][0].as_py()] * len(centres), pa.string()),
                         "centre": pa.array(list(centres.astype(np.float32)), pa.list_(pa.float32())), "reach": pa.array(reach, pa.float64())})
    return fit


def fit(rows: DataFrame, languages: int = LANGUAGES, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """A model of ``rows`` (text, lang, both not null), see the module.

    Rows without letters teach nothing; a language with few rows has fewer centroids;
    no rows give a model that knows no language."""
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    common = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages)
    sizes = {r.lang: r.rows for r in common.collect()}  # ``languages`` rows at most
    df = document_frequencies(rows)
    idf = (np.log((1.0 + sum(sizes.values())) / (1.0 + df)) + 1.0).clip(min=0.0)
    empty = Model([], np.zeros(0, np.int64), np.zeros((0, DIM)), np.zeros(0), idf)
    if not sizes:
        return empty
    share = rows.sparkSession.createDataFrame([(x, min(1.0, sample / n)) for x, n in sizes.items()], "lang string, share double")
    # of copies one is enough; with them gone each text is drawn by its own hash
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(share), "lang").where(drawn).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def weigh(batches):
        for batch, texts in _groups(batches):
            x = vectors(counts(texts), idf)
            keep = x.any(axis=1)
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], pa.array(at, pa.list_(pa.int32())), pa.array([r[i].astype(np.float32) for r, i in zip(x, at)], pa.list_(pa.float32()))],
                ["lang", "places", "weights"]).filter(pa.array(keep))

    points = kept(chosen.select("text", "lang").mapInArrow(weigh, "lang string, places array<int>, weights array<float>"), "points")
    found = points.groupBy("lang").applyInArrow(_clusters(idf, k), "lang string, centre array<float>, reach double").collect()
    if not found:
        return empty
    names = sorted({r.lang for r in found}, key=lambda x: (-sizes[x], x.encode()))
    found.sort(key=lambda r: (names.index(r.lang), r.reach))
    return Model(names, np.array([names.index(r.lang) for r in found]), np.array([r.centre for r in found], np.float64),
                 np.array([r.reach for r in found]), idf)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score``, ``distance`` and ``rejected``.

    The language of the nearest centroid, ``und`` for a null text or one without a
    letter (score 0, rejected) and where no language was learned.  A score is below 0.5
    for rejected texts; for others half of it is the margin to the next language.
    Equal distances go to the language with more training rows, then by name.
    Columns of these names are replaced; repeated rows get the same answer."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = ("lang_pred", "score", "distance", "rejected")
    rows = documents.drop(*names)
    inner = rows.select("text", F.struct(*rows.columns).alias("row"))

    def judge(batches):
        for batch, texts in _groups(batches):
            lang, score, distance, rejected = shared.value.judge(texts)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(lang, pa.string()), pa.array(score), pa.array(distance), pa.array(rejected)],
                                             ["row", *names])

    schema = f"row {inner.schema['row'].dataType.simpleString()}, lang_pred string, score double, distance double, rejected boolean"
    return inner.mapInArrow(judge, schema).select("row.*", *names)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from, with those of a null doc_id (which aren't held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from ``text`` and ``lang`` of the rows that aren't held out; said of every row."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = docs.select("text", F.struct("doc_id").alias("of"))
    return predict(out, model).select(F.col("of.doc_id").alias("doc_id"), F.coalesce(held_out(F.col("of.doc_id")), F.lit(False)).alias("held_out"),
                                      "lang_pred", "score")
