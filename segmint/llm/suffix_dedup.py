"""Repeated passages by a distributed difference-cover suffix sort.

A byte goes if a string of ``WIDTH`` bytes over it also starts in a document with
a smaller doc_id.  The work is dealt so that equal strings always meet:

1. Every window of ``WIDTH`` bytes is assigned to its least 16-byte gram (its
   anchor).  Neighbouring windows of one anchor form a run, whose key hashes the
   33 or 34 bytes that all its windows share.  Equal windows have equal keys, so
   runs whose key occurs in one document only are done.
2. The others send their bytes, as distinct contexts with the least and largest
   doc_id, to the bucket of their key.
3. A bucket is suffix-sorted by difference cover (positions 1 and 2 mod 3):
   sampled triples of eight-byte letters are sorted and named (24 bytes), the
   names are paired and named again (48 bytes), and the windows at all positions
   are merged by a byte or two and the name of a sampled position.  Adjacent
   windows that agree in ``WIDTH`` bytes are one string; its least doc_id decides.
4. The spans go back to every place of the context, and are merged per document.

Texts that are equal as a whole are found first, by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import in_batches, kept, table, tidy
from .shingles import mix

WIDTH, GRAM, SIDE = 50, 16, 18
SPAN = WIDTH - GRAM + 1
HOT = 1 << 16  # a key with more places sends single windows, dealt by their own bytes
PER_BUCKET = 1 << 20
BROADCAST_BYTES = 64 << 20
CHUNK, SLICE = 4 << 20, 1 << 20
LAST = (1 << 63) - 1  # stands for a null doc_id
_POS = np.uint64((1 << 31) - 1)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _letters(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as unsigned numbers (``buf`` has 64 bytes more)."""
    return np.ndarray((len(buf) - 8,), "<u8", buf.tobytes(), strides=(1,))


def runs(texts: list[bytes]):
    """(text index, first window in the text, windows, key) of every run of each text.

    Long texts go in overlapping slices of ``SLICE`` windows, so memory is bounded;
    a run that a slice's border cuts is two runs of one key."""
    slices = [(i, a, t[a:a + SLICE + WIDTH - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - WIDTH + 1), SLICE)]
    parts, batch, size = [], [], 0
    for x in slices:
        if batch and size + len(x[2]) > SLICE + WIDTH:
            parts.append(_of_slices(batch))
            batch, size = [], 0
        batch.append(x)
        size += len(x[2])
    parts.append(_of_slices(batch))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _of_slices(batch: list[tuple[int, int, bytes]]):
    d, p, n, key = _runs([t for _, _, t in batch])
    return np.array([i for i, _, _ in batch], np.int64)[d], p + np.array([a for _, a, _ in batch], np.int64)[d], n, key


def _runs(texts: list[bytes]):
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    buf = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    v = _letters(buf)
    if n < WIDTH:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    g = v[:n] * _K[0]
    g ^= g >> np.uint64(29)
    g += v[8:n + 8] * _K[1]
    g ^= g >> np.uint64(32)
    g *= _K[2]
    m = (g & ~_POS) | np.arange(n, dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, SPAN - 32):  # the least of 2, 4, ... 32, SPAN grams from here on
        m = np.minimum(m[:-step], m[step:])
    at = (m & _POS).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    idx = np.flatnonzero(np.arange(len(at)) + WIDTH <= ends[doc])
    if not len(idx):
        return idx, idx, idx, idx.astype(np.uint64)
    a = at[idx]
    left = a - idx >= SIDE
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (left[1:] != left[:-1])])
    p, a, left = idx[first], a[first], left[first]
    base = np.where(left, a - SIDE, a)
    key = np.where(left, _K[3], _K[4])
    for k in range(0, 32, 8):
        key = mix(key ^ v[base + k])
    tail = buf[base + 32].astype(np.uint64) | np.where(left, buf[base + 33].astype(np.uint64) << np.uint64(8), np.uint64(0))
    d = doc[p]
    return d, p - (ends - sizes)[d], np.diff(np.r_[first, len(idx)]), mix(key ^ tail)


def _chunks(column, limit: int = CHUNK):
    first, texts, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_buffer().to_pybytes() if x.is_valid else b""
        if texts and size + len(t) > limit:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def _keys(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Run keys packed by bucket with the number of their row; a row holds the arrays of one chunk of texts."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, texts in _chunks(b.column(1)):
                d, p, _, key = runs(texts)
                bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
                # 40 bits of the key beside its bucket's; places in halves, as the upper ones are mostly 0
                doc, pos, low = ids[at + d[order]].astype("<i8"), p[order], key[order]
                columns = [doc, (pos & 0xFFFF).astype("<u2"), (pos >> 16).astype("<u2"),
                           (low & np.uint64(0xFFFFFFFF)).astype("<u4"), ((low >> np.uint64(32)) & np.uint64(0xFF)).astype("u1")]
                rows = [(k, *(c[i:j].tobytes() for c in columns))
                        for k, i, j in zip(range(n_buckets), cuts[:-1], cuts[1:]) if j > i]
                for i in range(0, len(rows), 64):
                    cols = list(zip(*rows[i:i + 64]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                        ["bucket", "rows", "places", "places2", "low", "high"])
    return docs.select("row", "bytes").mapInArrow(tidy(run), "bucket int, rows binary, places binary, places2 binary, low binary, high binary")


def _met(t: pa.Table) -> pa.Table:
    """Of one bucket: the places (negative: of a hot key, as ~place) of keys of several rows."""
    get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    docs, places = get("rows", "<i8"), get("places", "<u2").astype(np.int64) | (get("places2", "<u2").astype(np.int64) << 16)
    key = get("low", "<u4").astype(np.uint64) | (get("high", "u1").astype(np.uint64) << np.uint64(32))
    order = np.argsort(key)
    k, d, p = key[order], docs[order], places[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    n = np.diff(np.r_[first, len(k)])
    several = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), n)
    p = np.where(np.repeat(n > HOT, n), ~p, p)
    return in_batches(pa.table({"row": d[several], "place": p[several].astype(np.int32)}))


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _contexts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, place, key, context of the runs at each document's ``places``."""
    def run(batches):
        for b in batches:
            ids, rows, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            for at, texts in _chunks(b.column(2), CHUNK // 4):
                d, p, n, key = runs(texts)
                base = np.cumsum([0] + [len(t) for t in texts])[:-1]
                want = [lists[at + i].values.to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(texts))]
                size = [len(x) for x in want]
                place = np.concatenate(want)
                # (text, place) as one number, to look the runs up
                mine = (np.repeat(np.arange(len(texts)), size) << 32) | np.where(place < 0, ~place, place)
                hot = np.sort(mine[place < 0])
                own = (d << 32) | p
                take = np.isin(own, mine)
                d, p, n, key, own = d[take], p[take], n[take], key[take], own[take]
                single = np.isin(own, hot)
                # a hot run becomes its windows, each with a key of its own
                times = np.where(single, n, 1)
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                d, p, single, key = np.repeat(d, times), np.repeat(p, times) + step, np.repeat(single, times), np.repeat(key, times)
                n = np.where(single, 1, np.repeat(n, times))
                buf = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
                first = base[d] + p
                own_key = np.zeros(int(single.sum()), np.uint64)
                v = _letters(buf)
                for k in (0, 8, 16, 24, 32, 40, 42):
                    own_key = mix(own_key ^ v[first[single] + k])
                key[single] = own_key
                for i in range(0, len(d), 1 << 14):
                    s = slice(i, i + (1 << 14))
                    size = n[s] + WIDTH - 1
                    flat = buf[np.repeat(first[s] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at + d[s]]), pa.array(rows[at + d[s]]), pa.array(p[s].astype(np.int32)),
                         pa.array(key[s].astype(np.int64)), _binary(flat, size)],
                        ["doc_id", "row_key", "place", "key", "context"])
    return docs.select("doc_id", "row_key", "bytes", "places").mapInArrow(
        run, "doc_id long, row_key long, place int, key long, context binary")


def _named(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the tuples (most significant first): sorted, then numbered where neighbours differ."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _least(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each key's rows: sort, compare neighbours, reduce."""
    if not len(key):
        return value
    order = np.argsort(key)
    s = key[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    out = np.empty_like(value)
    out[order] = np.repeat(np.minimum.reduceat(value[order], first), np.diff(np.r_[first, len(s)]))
    return out


def least_document(buf: np.ndarray, window: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each window start in ``buf`` (64 bytes more at the end): the least
    value of all windows with the same ``WIDTH`` bytes, by difference cover."""
    v = _letters(buf).byteswap()  # so that numbers compare as bytes do
    size = len(v)
    need = np.zeros(size, bool)
    for k in (0, 1, 2):
        need[window + k] = True
    need[np.arange(0, size, 3)] = False  # the sample: 1 and 2 mod 3
    names = need.copy()
    names[24:] |= need[:-24]
    p = np.flatnonzero(names)
    first = np.zeros(size, np.int64)
    # triples of letters: 24 bytes
    first[p] = _named(_named(v[p], v[p + 8]).astype(np.uint64), v[p + 16]) if len(p) else 0
    q = np.flatnonzero(need)
    rank = np.zeros(size, np.int64)
    # the names recur at the same residue: 48 bytes
    rank[q] = _named((first[q] << 32) | first[q + 24]) if len(q) else 0
    b = buf.astype(np.int64)
    mod = window % 3
    out = value.copy()
    i = np.flatnonzero(mod != 0)
    w = window[i]
    out[i] = _least((rank[w] << 16) | (b[w + 48] << 8) | b[w + 49], value[i])
    merged = out.copy()
    for other, k in ((1, 1), (2, 2)):  # merge the positions 0 mod 3 with those of each sampled residue
        i = np.flatnonzero((mod == 0) | (mod == other))
        w = window[i]
        edge = (b[w] << 8) | (b[w + 49] if k == 1 else b[w + 1])
        merged[i] = np.minimum(merged[i], _least((rank[w + k] << 16) | edge, out[i]))
    return merged


def _sorted_bucket(t: pa.Table) -> pa.Table:
    """Of one bucket's contexts (key, digest, context, lo, hi): the window runs that some place may lose."""
    context = t.column("context").combine_chunks()
    texts = context.to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    lo, hi = t.column("lo").to_numpy(), t.column("hi").to_numpy()
    n = size - WIDTH + 1
    base = np.cumsum(size) - size
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(texts)), n)
    buf = np.frombuffer(b"".join(texts) + bytes(128), np.uint8)
    m = least_document(buf, base[owner] + step, lo[owner])
    at = np.flatnonzero(m < hi[owner])
    o, s, m = owner[at], step[at], m[at]
    first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1) | (m[1:] != m[:-1])]) if len(at) else at
    key, digest = t.column("key").to_numpy(), t.column("digest").to_numpy()
    return in_batches(pa.table({"key": key[o[first]], "digest": digest[o[first]], "shift": s[first].astype(np.int32),
                                "n": np.diff(np.r_[first, len(at)]).astype(np.int32), "least": m[first]}))


def spans(rows: DataFrame) -> DataFrame:
    """doc_id, row_key, span (start, end) of the bytes to remove, not yet merged.

    ``rows``: doc_id (not null), row_key, bytes; documents of equal bytes must be one row.
    Places belong to a row, as many rows may have one doc_id."""
    rows = rows.withColumn("row", F.xxhash64("doc_id", "row_key"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    n_buckets = max(1, -(-total // (12 * PER_BUCKET)))  # about one run in twelve bytes
    met = _keys(rows, n_buckets).groupBy("bucket").applyInArrow(_met, "row long, place int")
    places = kept(met.groupBy("row").agg(F.collect_list("place").alias("places")), "places")
    size = places.agg(F.coalesce(F.sum(4 * F.size("places") + 64), F.lit(0))).first()[0]
    found = rows.join(F.broadcast(places) if size <= BROADCAST_BYTES else places, "row")
    c = kept(_contexts(found), "contexts", "zstd")
    distinct = c.groupBy("key", "context").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    n = max(1, -(-c.count() // (PER_BUCKET // 32)))
    # key and digest: 128 bits that tell the contexts apart
    lost = distinct.withColumns({"bucket": F.pmod("key", F.lit(n)), "digest": F.xxhash64("context")}).groupBy(
        "bucket").applyInArrow(_sorted_bucket, "key long, digest long, shift int, n int, least long")
    hit = c.select("doc_id", "row_key", "place", "key", F.xxhash64("context").alias("digest")).join(
        lost, ["key", "digest"]).where(F.col("least") < F.col("doc_id"))
    start = F.col("place") + F.col("shift")
    return hit.select("doc_id", "row_key", start.alias("start"), (start + F.col("n") + (WIDTH - 1)).alias("end"))


def merged(found: DataFrame) -> DataFrame:
    """doc_id, row_key, spans: the maximal spans, as little-endian pairs of 32-bit numbers."""
    def run(batches):
        for b in batches:
            out = []
            for a, e in zip(b.column(2), b.column(3)):
                a, e = a.values.to_numpy(zero_copy_only=False), e.values.to_numpy(zero_copy_only=False)
                o = np.argsort(a)
                a, top = a[o], np.maximum.accumulate(e[o])
                first = np.flatnonzero(np.r_[True, a[1:] > top[:-1]])
                last = np.r_[first[1:] - 1, len(a) - 1]
                out.append(np.stack([a[first], top[last]], 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "row_key", "spans"])
    lists = found.groupBy("doc_id", "row_key").agg(F.collect_list("start").alias("s"), F.collect_list("end").alias("e"))
    # two lists of one aggregation: they have the rows in the same order
    return lists.mapInArrow(run, "doc_id long, row_key long, spans binary")


def marked(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ``_row`` (all columns of ``documents``), ``_bytes`` (UTF-8), ``_spans`` (maximal
    removed runs; null: none) and ``_copy`` (all bytes go: a smaller doc_id has the same text).

    A null text is empty.  A null doc_id comes after all others.  Rows of one
    doc_id don't remove each other's bytes."""
    b = F.coalesce(F.col(text), F.lit("")).cast("binary")
    packed = documents.select("doc_id", b.alias("_bytes"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    b = F.col("_bytes")
    keyed = packed.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "_key": F.xxhash64(b),
                             "_digest": F.unhex(F.md5(b))})
    long = F.octet_length("_bytes") >= WIDTH
    each = keyed.where(long).groupBy("_digest", "_doc").agg(F.count(F.lit(1)).alias("n"))
    heads = each.groupBy("_digest").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi"), F.min_by("n", "_doc").alias("n"))
    # only groups with a copy: the rest needs no looking up
    shared = kept(heads.where((F.col("lo") < F.col("hi")) | (F.col("n") > 1)).drop("hi"), "heads")
    size = 64 * shared.count()
    looked = keyed.join(F.broadcast(shared) if size <= BROADCAST_BYTES else shared, "_digest", "left")
    marks = looked.withColumn("_copy", F.coalesce(F.col("lo") < F.col("_doc"), F.lit(False)))
    flagged = marks.drop("lo", "n")
    own = long & ~F.col("_copy")
    needed = lambda df: df.select(F.col("_doc").alias("doc_id"), F.col("_key").alias("row_key"), F.col("_bytes").alias("bytes"))
    rows = needed(flagged.where(own))
    if not shared.where(F.col("n") > 1).isEmpty():  # rows that agree in doc_id and text are one
        twice = kept(needed(marks.where(own & (F.col("n") > 1))).dropDuplicates(["doc_id", "row_key"]), "twice")
        rows = needed(marks.where(own & (F.coalesce("n", F.lit(1)) == 1))).unionByName(twice)
    found = kept(merged(spans(rows)), "spans")
    size = found.agg(F.coalesce(F.sum(F.octet_length("spans") + 64), F.lit(0))).first()[0]
    found = found.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), F.col("spans").alias("_spans"))
    return flagged.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["_doc", "_key"], "left")


def _cut(raw: bytes, spans: bytes | None, copy: bool) -> tuple[bytes, int, int]:
    """(kept bytes, removed, spans)."""
    if copy:
        return b"", len(raw), 1
    if not spans:
        return raw, 0, 0
    ends = np.frombuffer(spans, "<u4").tolist()
    parts = [raw[a:b] for a, b in zip([0, *ends[1::2]], [*ends[0::2], len(raw)])]
    out = b"".join(parts)
    return out, len(raw) - len(out), len(ends) // 2


def without_repeats(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the repeated passages cut out of ``text``: a character goes
    if all its bytes do, so the text stays valid.  Rows that lose something and
    keep no more than white space go; all others stay."""
    found = marked(documents, text)
    kind = found.schema["_row"].dataType

    def run(batches):
        for b in batches:
            new, gone = [], []
            for raw, sp, copy in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                raw, sp = raw.as_buffer().to_pybytes(), sp.as_py()
                if sp and not copy:
                    ends = np.frombuffer(sp, "<u4").astype(np.int64)
                    inside = np.r_[(np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False]
                    a, e = ends[0::2].copy(), ends[1::2].copy()
                    for _ in range(3):  # whole characters: at most three bytes further
                        a, e = a + inside[a], e - inside[e]
                    sp = np.stack([a, e], 1)[e > a].astype("<u4").tobytes()
                rest, removed, _ = _cut(raw, sp, copy)
                new.append(rest.decode("utf-8", "surrogatepass"))
                gone.append(removed > 0 and not rest.split())
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array(gone, pa.bool_()), b.column(3)], ["new", "gone", "_row"])

    out_type = StructType([StructField("new", StringType()), StructField("gone", BooleanType()), StructField("_row", kind)])
    out = found.select("_bytes", "_spans", "_copy", "_row").mapInArrow(run, out_type).where(~F.col("gone"))
    value = lambda c: F.col("_row").getField(c)
    return out.select(*(F.when(value(c).isNotNull(), F.col("new")).alias(c) if c == text else value(c).alias(c)
                        for c in documents.columns))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from ``marked``."""
    def run(batches):
        for b in batches:
            out = []
            for raw, sp, copy in zip(b.column(1), b.column(2), b.column(3).to_pylist()):
                raw = raw.as_buffer().to_pybytes()
                rest, removed, n = _cut(raw, sp.as_py(), copy)
                out.append((len(raw), removed, n, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "_bytes", "_spans", "_copy").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(marked(table(spark, sf_dir, "documents").select("doc_id", "text")))
