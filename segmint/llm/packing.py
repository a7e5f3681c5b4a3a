"""Best-fit packing by sums of squares.

Pieces that fill a sequence have it to themselves.  The others are dealt by
hash to groups of bounded size.  Inside a group each piece goes to the open
sequence for which the sum of the squared counts of open sequences per residual
gap becomes smallest, which keeps gaps of all sizes for the pieces to come.
The pieces of sequences that it leaves open are dealt anew and finished by best
fit: no pieces come after them, so only the tightest gap counts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table, tidy
from .tokens import chunks, encoder, tokenizer_path

LENGTH, GROUP, END = 1024, 16_384, 2


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only more than ``length`` are
    cut, and only the first piece is shorter then."""
    first = n if n <= length else n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def sum_of_squares(sizes, length: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each size, and the used length of each bin.

    ``open_[g]`` counts open bins with gap g.  A piece of size s in a bin with gap
    g takes one from open_[g] and gives one to open_[g - s]; the sum of squares
    changes by 2 * (open_[g - s] - open_[g]) + 2, without the first term where
    the bin closes.  Of equal changes the smallest gap is taken."""
    open_, stacks, used, bins, offsets = np.zeros(length + 1, np.int64), [[] for _ in range(length + 1)], [], [], []
    far = np.int64(1) << 60
    for s in sizes:
        have = open_[s:]
        change = np.where(have > 0, 2 * (open_[:length + 1 - s] - have) + 2, far)
        change[0] = 1 - 2 * have[0] if have[0] else far  # closes the bin
        k = int(change.argmin())
        gap = k + s
        if change[k] <= (2 * open_[length - s] + 1 if s < length else 0):
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            b, gap = len(used), length
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        if gap > s:
            open_[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets, used


def best_fit(sizes, length: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """As ``sum_of_squares``, but each piece goes to the smallest gap that holds it."""
    open_, stacks, used, bins, offsets = np.zeros(length + 1, bool), [[] for _ in range(length + 1)], [], [], []
    for s in sizes:
        gap = s + int(open_[s:length].argmax()) if s < length else length
        if gap < length and open_[gap]:
            b = stacks[gap].pop()
            open_[gap] = bool(stacks[gap])
        else:
            b, gap = len(used), length
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        if 0 < gap - s < length:
            open_[gap - s] = True
            stacks[gap - s].append(b)
    return bins, offsets, used


def _place(length: int, method):
    """A group's rows (item, size, grp) by falling size: rows (item, size, grp, bin, offset, used)."""
    def run(t: pa.Table) -> pa.Table:
        size, item, grp = (t.column(c).to_numpy() for c in ("size", "item", "grp"))
        order = np.lexsort((item, -size))
        bins, offsets, used = method(size[order].tolist(), length)
        columns = [item[order], size[order], grp[order], bins, offsets, np.array(used, np.int64)[bins] if bins else []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "size", "grp", "bin", "offset", "used"), columns)})
    return run


_PLACED = "item long, size long, grp long, bin long, offset long, used long"


def _dealt(items: DataFrame, length: int, method) -> DataFrame:
    """Items in groups of about ``GROUP``, each packed in one task."""
    groups = max(1, -(-items.count() // GROUP))
    return items.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("grp").applyInArrow(
        _place(length, method), _PLACED)


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (length, ...) with ``sequence_id`` and ``offset``.

    ``pieces`` must be a written table: it is read more than once and its rows
    are told apart by their place in it.  Lengths run from 1 to ``length``; a
    piece of the whole length makes a sequence.  Ties and repeated rows are
    pieces of their own; an empty table gives no rows.
    """
    rows = kept(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    small = rows.where(F.col("length") < length).select("item", F.col("length").cast("long").alias("size"))
    first = kept(_dealt(small, length, sum_of_squares), "packed")
    second = _dealt(first.where(F.col("used") < length).select("item", "size"), length, best_fit)
    number = (F.col("grp") * 65536 + F.col("bin")) * 4  # a group has fewer bins than 65536
    placed = first.where(F.col("used") == length).select("item", (number + 2).alias("sequence_id"), "offset").unionByName(
        second.select("item", (number + 1).alias("sequence_id"), "offset"))
    whole = rows.where(F.col("length") >= length).withColumns({"sequence_id": F.col("item") * 4, "offset": F.lit(0).cast("long")})
    return rows.where(F.col("length") < length).join(placed, "item").unionByName(whole).drop("item")


def pieces_of(documents: DataFrame, path: str, kind: str = "byte", end: int = END, length: int = LENGTH,
              with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document; null text: only ``end``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        enc = encoder(path, kind)
        for b in batches:
            docs = b.column(0).to_pylist()
            for first, texts in chunks(b.column(1)):
                out = []
                for i, ids in enumerate(enc.encode(texts, end)):
                    for k, (s, n) in enumerate(cut(len(ids), length)):
                        raw = ids[s:s + n].astype("<u4").tobytes()
                        out.append((docs[first + i], k, s, n, zlib.crc32(raw), *([raw] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidy(run, tokens=True), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (pieces by offset) from ``pack`` of pieces with ids;
    a sequence has at most the packed length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def packed_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    return pack(pieces_of(documents, tokenizer_path(tokenizer))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
