"""Benchmark decontamination by size-partitioned containment MinHash.

Items are put in partitions by size (their number of shingles).  The sketch of an
item is the least of its shingle hashes (bottom-k MinHash); k is the same part of
every partition's largest size: floor((1 - threshold) * size) + 1.  Of so many
shingles at least one is in every text that contains the item to the threshold,
however long the text is, so the search misses nothing.  (Sketching the long
side as well would: a 20-word item is lost in a 20,000-word text.)  Candidates
are verified by the exact share of the item's shingles that the text contains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, kept, table
from .shingles import _MUL, WIDTH, Shingler, mix
from .tokens import chunks

THRESHOLD = 0.8
BLOCK = 1 << 20  # shingles of items that one pass over the documents looks for: 8 MB
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def plain_bytes(text: str) -> bytes:
    """``text`` with A-Z lower-cased and a blank for all that is no letter, no digit and not beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN)


def plain_words(text: str) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return plain_bytes(text).split()


def short_windows(w: np.ndarray, sizes: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct hashes of the ``k`` words from every word of each text on, seeded by ``k``."""
    h = w.copy()
    for i in range(1, k):
        h = h * _MUL
        h[:max(0, len(w) - i)] += w[i:]
    h = mix(mix(h) + np.uint64(k))
    ends = np.cumsum(sizes)
    return [np.unique(h[e - n:max(e - n, e - k + 1)]) for n, e in zip(sizes.tolist(), ends.tolist())]


def item_sets(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id, size, elements (rising hashes), words (their number up to ``WIDTH``) of items with words."""
    def run(batches):
        sh = Shingler(plain_words)
        for b in batches:
            for at, texts in chunks(b.column(1)):
                w, n = sh.words(texts)
                sets = [np.unique(x) for x in sh.sequences_of(w, n)]
                for k in range(1, WIDTH):
                    if (n == k).any():
                        sets = [x if m == k else s for s, x, m in zip(sets, short_windows(w, n, k), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array(np.minimum(n, WIDTH))],
                    ["item_id", "size", "elements", "words"])
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(
        run, "item_id long, size long, elements binary, words long").where("size > 0")


def sketch_size(size: int, threshold: float = THRESHOLD) -> int:
    """k for the partition of ``size``: the sizes from one power of two to the next."""
    largest = (1 << int(size).bit_length()) - 1
    return min(size, int(np.floor((1 - threshold) * largest + 1e-9)) + 1)


class Index:
    """The sketches of one block of items, by hash, and their whole sets."""

    def __init__(self, rows: list[tuple[int, bytes]], threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _ in rows]
        self.sets = [np.frombuffer(e, "<u8") for _, e in rows]
        low = [s[:sketch_size(len(s), threshold)] for s in self.sets]
        h = np.concatenate(low) if low else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(low)), [len(x) for x in low])
        order = np.argsort(h, kind="stable")
        self.item = item[order]
        self.hash, self.first = np.unique(h[order], return_index=True)
        self.last = np.r_[self.first[1:], len(h)] if len(h) else self.first

    def find(self, sets: list[np.ndarray]):
        """(text index, item index, shared shingles) of every containment."""
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        if not len(flat) or not len(self.hash):
            return
        at = np.minimum(np.searchsorted(self.hash, flat), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == flat)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        at = at[hit]
        n = self.last[at] - self.first[at]
        item = self.item[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for key in np.unique((np.repeat(doc, n) << 32) | item).tolist():
            d, i = key >> 32, key & 0xFFFFFFFF
            shared = len(np.intersect1d(sets[d], self.sets[i], assume_unique=True))
            if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                yield d, i, shared


def probes(sh: Shingler, texts: list[str], short: list[int]) -> list[np.ndarray]:
    """The distinct hashes of each text: its shingles, and its windows of the lengths ``short``."""
    w, n = sh.words(texts)
    parts = [sh.sequences_of(w, n), *(short_windows(w, n, k) for k in short)]
    return [np.unique(np.concatenate(x) if len(x) > 1 else x[0]) for x in zip(*parts)]


def contained(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_size, shared, containment of every pair at or over the threshold.

    Items without words are in nothing; an item of fewer than five words is in every
    text that has these words one after the other (size 1).  Null texts are empty, null ids stay null;
    repeated rows give repeated pairs; an empty table gives no rows."""
    stored = kept(item_sets(items), "items")
    total = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // BLOCK))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in range(n_blocks):  # a block of the stated query set against all rows
        mine = stored.where(F.pmod(F.xxhash64("elements", "item_id"), F.lit(n_blocks)) == block)
        found = mine.collect()
        rows = sorted((r["item_id"] is not None, r["item_id"], bytes(r["elements"])) for r in found)
        shared = documents.sparkSession.sparkContext.broadcast([r[1:] for r in rows])
        short = sorted({r["words"] for r in found if r["words"] < WIDTH})

        def run(batches, shared=shared, short=short):
            sh, index = Shingler(plain_words), Index(shared.value, threshold)
            for b in batches:
                ids = b.column(0).to_pylist()
                for at, texts in chunks(b.column(1)):
                    found = [(ids[at + d], index.ids[i], len(index.sets[i]), n) for d, i, n in index.find(probes(sh, texts, short))]
                    if found:
                        cols = [pa.array(c, pa.int64()) for c in zip(*found)]
                        share = pa.array([n / s for _, _, s, n in found], pa.float64())
                        yield pa.RecordBatch.from_arrays([*cols, share], ["doc_id", "item_id", "item_size", "shared", "containment"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, item_size long, shared long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that contain no item."""
    key = free_name(documents, "row_key")
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))  # equal rows get the same answer
    hits = contained(keyed.select(F.col(key).alias("doc_id"), "text"), items, threshold)
    bad = kept(hits.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    small = bad.count() <= 1 << 20
    return keyed.join(F.broadcast(bad) if small else bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"

SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, unnest({_SHINGLES}) AS h FROM dw WHERE len(w) >= 5),
b AS (SELECT item_id, unnest(g) AS h, len(g)::BIGINT AS n FROM (SELECT item_id, {_SHINGLES} AS g FROM bw WHERE len(w) >= 5)),
p AS (SELECT doc_id, item_id, any_value(b.n) AS item_size, count(*) AS shared FROM d JOIN b ON d.h = b.h GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_size, shared, shared / item_size AS containment FROM p WHERE shared >= {THRESHOLD} * item_size - 1e-9
UNION ALL
SELECT doc_id, item_id, 1::BIGINT, 1::BIGINT, 1.0::DOUBLE FROM dw JOIN bw
ON len(bw.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(bw.w, ' ') || ' ')"""
