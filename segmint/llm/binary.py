"""Token-id output: static range asymmetric numeral system (rANS) files.

All blocks share one frequency table, counted over all ids.  A block holds
whole documents and is coded by itself in ``LANES`` interleaved streams, with
checkpoints of every lane's state and a checksum, so blocks and parts of blocks
decode in parallel.  The container is Parquet, written and committed by Spark:

    blocks/   part, block, part_start, n_tokens, n_docs, payload
    table/    token, freq (sum 2**bits)
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_dir
from .common import kept, table
from .shards import n_parts
from .tokens import TOKEN_CHUNK, chunks, encoder, id_kind, tokenizer_path

LANES, BLOCK, CHECK_STEPS = 1024, 1 << 20, 256
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC = b"RNS1"


class Table:
    """Frequencies scaled to 2**bits, at least one for each id that occurs."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray, bits: int):
        self.tokens, self.bits = tokens, bits
        self.freq, self.cum = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(tokens), dtype=np.int32), freqs)
        self.rank = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, np.int32)
        self.rank[tokens] = np.arange(len(tokens))

    @classmethod
    def of(cls, tokens, counts) -> Table:
        order = np.argsort(tokens)
        tokens, counts = np.asarray(tokens, np.uint32)[order], np.asarray(counts, np.float64)[order]
        bits = min(24, max(16, int(len(tokens) * 4).bit_length()))
        freqs = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << bits))).astype(np.int64)
        while len(freqs) and (over := int(freqs.sum()) - (1 << bits)):
            if over < 0:
                freqs[np.argmax(freqs)] -= over
            else:  # ids that were raised to one are paid for by the largest
                k = int(np.argmax(freqs))
                freqs[k] -= min(over, max(1, int(freqs[k]) // 2))
        return cls(tokens, freqs, bits)


def encode_block(ids: np.ndarray, t: Table) -> bytes:
    """Payload of ``ids`` (uint32): sizes, checksum, checkpoints, words."""
    s = t.rank[ids]
    freq, cum = t.freq[s], t.cum[s]
    steps = -(-len(ids) // LANES)
    x = np.full(LANES, LOW, np.uint64)
    bits, room = np.uint64(t.bits), np.uint64(63 - t.bits)
    words, checks, done = [], [], 0
    for k in range(steps - 1, -1, -1):
        f, c = freq[k * LANES:(k + 1) * LANES], cum[k * LANES:(k + 1) * LANES]
        v = x[:len(f)]
        full = v >= (f << room)
        out = v[full]
        words.append(out.astype(np.uint32))
        done += len(out)
        v[full] = out >> WORD
        q = v // f
        v[:] = (q << bits) + (v - q * f) + c
        if k % CHECK_STEPS == 0:
            checks.append((k, done, x.tobytes()))
    body = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    # a checkpoint: step, words that stand before it, states of the lanes
    marks = b"".join(struct.pack("<II", k, len(body) - n) + states for k, n, states in reversed(checks))
    head = struct.pack("<4sIIIII", MAGIC, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), LANES, len(checks), len(body))
    return head + marks + body.astype("<u4").tobytes()


def decode_block(data: bytes, t: Table, first_check: int = 0, n_checks: int | None = None) -> np.ndarray:
    """The ids of a block, or of ``n_checks`` checkpoint intervals from ``first_check`` on."""
    magic, n, crc, lanes, checks, n_words = struct.unpack_from("<4sIIIII", data)
    if magic != MAGIC or len(data) != 24 + checks * (8 + 8 * lanes) + 4 * n_words:
        raise ValueError("not a token block, or cut short")
    if not checks:
        return np.zeros(0, np.uint32)
    at = 24 + first_check * (8 + 8 * lanes)
    step, pos = struct.unpack_from("<II", data, at)
    x = np.frombuffer(data, "<u8", lanes, at + 8).astype(np.uint64)
    body = np.frombuffer(data, "<u4", n_words, 24 + checks * (8 + 8 * lanes)).astype(np.uint64)
    last = checks if n_checks is None else min(checks, first_check + n_checks)
    end = n if last == checks else struct.unpack_from("<I", data, 24 + last * (8 + 8 * lanes))[0] * lanes
    out = np.empty(end - step * lanes, np.int32)
    bits, mask = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    for i in range(0, len(out), lanes):
        v = x[:min(lanes, len(out) - i)]
        slot = v & mask
        s = t.slot[slot]
        out[i:i + len(v)] = s
        v[:] = t.freq[s] * (v >> bits) + slot - t.cum[s]
        low = np.flatnonzero(v < LOW)
        v[low] = (v[low] << WORD) | body[pos:pos + len(low)]
        pos += len(low)
    ids = t.tokens[out]
    if last == checks and (x != LOW).any():
        raise ValueError("the streams don't end where they began")
    if first_check == 0 and last == checks and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum differs")
    return ids


def tokenised(documents: DataFrame, path: str, kind: str, end: int) -> DataFrame:
    """doc_id, n_tokens, ids (of the kind that ``id_kind`` names), ``end`` appended; null text: empty."""
    kind_of_id = id_kind(path)

    def run(batches):
        enc = encoder(path, kind)
        for b in batches:
            for first, texts in chunks(b.column(1), TOKEN_CHUNK):
                ids = enc.encode(texts, end)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype(kind_of_id).tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def count_ids(tokens: DataFrame, kind: str) -> DataFrame:
    """token, n over all rows: each task sends at most one row a distinct id."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))  # as long as the vocabulary: one a batch, not a text
            if len(n) > len(total):
                total, n = n, total
            total[:len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])
    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write(tokens: DataFrame, path: str, kind: str) -> None:
    """``tokens`` (doc_id, n_tokens, ids of ``kind``) as files in ascending doc_id order, null
    first; rows of one doc_id keep one order (by content).  ``tokens`` is read
    several times, so it should be a written table."""
    spark = tokens.sparkSession
    counts = count_ids(tokens, kind).collect()  # one row an id of the vocabulary
    tab = Table.of([r["token"] for r in counts], [r["n"] for r in counts])
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(tab.tokens, tab.freq)], "token long, freq long").coalesce(
        1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((tab.tokens, tab.freq.astype(np.int64), tab.bits))

    def run(batches):
        from pyspark import TaskContext

        part, t, state = TaskContext.get().partitionId(), Table(*shared.value), {"block": 0, "start": 0}
        docs, ids, size = [], [], 0

        def flush():
            flat = np.concatenate(ids).astype(np.uint32)
            names = np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs)
            head = struct.pack("<I", len(docs)) + names + np.array([len(x) for x in ids], "<u4").tobytes()
            row = [part, state["block"], state["start"], len(flat), len(docs), head + encode_block(flat, t)]
            state["block"] += 1
            state["start"] += len(flat)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], _NAMES)

        for b in batches:
            for d, v in zip(b.column(0).to_pylist(), b.column(1)):
                one = np.frombuffer(v.as_buffer(), kind)
                if docs and size + len(one) > BLOCK:
                    yield flush()
                    docs, ids, size = [], [], 0
                docs.append(d)
                ids.append(one)
                size += len(one)
        if docs:
            yield flush()

    order = ["doc_id", "tie"]
    rows = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    (rows.repartitionByRange(n_parts(rows), *order).sortWithinPartitions(*order).select("doc_id", "ids")
     .mapInArrow(run, "part int, block int, part_start long, n_tokens long, n_docs long, payload binary")
     .write.parquet(f"{path}/blocks"))


_NAMES = ["part", "block", "part_start", "n_tokens", "n_docs", "payload"]


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    rows = spark.read.parquet(f"{path}/table").collect()
    tab = (np.array([r["token"] for r in rows], np.uint32), np.array([r["freq"] for r in rows], np.int64))
    order = np.argsort(tab[0])
    shared = spark.sparkContext.broadcast((tab[0][order], tab[1][order], int(tab[1].sum()).bit_length() - 1))
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row a partition of the writer
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))

    def run(batches):
        t = Table(*shared.value)
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1)):
                data = payload.as_buffer().to_pybytes()
                n = struct.unpack_from("<I", data)[0]
                docs = np.frombuffer(data, "<i8", n, 4).tolist()
                null = data[4 + 8 * n:4 + 9 * n]
                sizes = np.frombuffer(data, "<u4", n, 4 + 9 * n).astype(np.int64)
                ids = decode_block(data[4 + 13 * n:], t).astype("<u4")
                ends = np.cumsum(sizes)
                raw = [ids[e - k:e].tobytes() for e, k in zip(ends, sizes)]
                cols = [pa.array([None if z else d for d, z in zip(docs, null)], pa.int64()),
                        pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return blocks.join(F.broadcast(parts), "part").select(
        (F.col("before") + F.col("part_start")).alias("start"), "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op8_token_binary(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    file = tokenizer_path(tokenizer)
    tokens = kept(tokenised(table(spark, sf_dir, "documents"), file, "word", end=2), "tokens")
    path = fresh_dir(spark, "token-files")
    write(tokens, path, id_kind(file))
    return read(spark, path)
