"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of hashed shingles are split into segments by hash range, their number by size
band.  Two sets that link differ in at most H = floor((r + s) / 9) elements, so at
most H segments differ: a text that asks with more than H of its segments shares one
unchanged with every text it links to.  A segment of a small text may also ask with
its one-deletion neighbourhood; then it stands for two differences.

Allocation by cost: the signatures are counted, and a text asks with its cheapest
ones, as many as the pigeonhole wants; a segment of a small text is bought plain or
with its neighbourhood.  Those that no other text has cost nothing and count too, so
a text with enough of them asks with none, and with some more links with nothing and
isn't there to be found either.  Most texts end here, those that share only a line or
a passage with others among them.  Candidates are verified exactly on their whole
sets.  A text whose shingles fall into too few segments is joined by its shingles.

Equal sets are one class, whatever ids its rows have, and only classes are compared.
In signature groups links to a pivot are tried first; then only pairs across the
components found so far are, and of these only pairs that parity bits of the sets and
the distances to a common pivot leave open.  :func:`similar_pairs` gives every link between classes.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir
from ..sources import bucketed
from .common import LOWER, UPPER, discard, free_name, in_batches, kept, table, tidy
from .components import components
from .shingles import Shingler, mix
from .tokens import chunks

SMALL = 64  # up to so many shingles: one-deletion neighbourhoods
GROUP = 8  # a larger signature group is first tied to pivots
PIVOT_ROUNDS = 2
PER_BUCKET = 1 << 20
SPREAD = 1.5  # segments, as a multiple of those that the pigeonhole wants
PARITY = tuple(f"k{i}" for i in range(8))  # columns of 64 parity bits
BROADCAST_IDS = 1 << 20
CHUNK = 2 << 20  # bytes of text whose words are held at once

_ENDS = []
while not _ENDS or _ENDS[-1] < 1 << 40:
    _ENDS.append(((_ENDS[-1] + 1) if _ENDS else 1) * 5 // 4)
BAND_ENDS = np.array(_ENDS, np.int64)
SEGMENTS = np.ceil(SPREAD * (BAND_ENDS / 4 + 1)).astype(np.int64) + 3


def plan(sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For role 0 (own band) and 1 (the band below): the band of each size (-1:
    none), and its need: differences to a smaller or equal partner, and one."""
    own = np.searchsorted(BAND_ENDS, sizes)
    below = own - 1
    reach = (below >= 0) & (sizes > 0) & (4 * sizes <= 5 * BAND_ENDS[np.maximum(below, 0)])
    return [(np.where(sizes > 0, own, -1), 2 * sizes // 9 + 1),
            (np.where(reach, below, -1), (sizes + BAND_ENDS[np.maximum(below, 0)]) // 9 + 1)]


def reach(sizes: np.ndarray) -> np.ndarray:
    """Differences to any partner of the own band or asked from the band above, and one."""
    return (sizes + 5 * sizes // 4) // 9 + 1


def segments(sets: list[np.ndarray]):
    """Of each role, and of all sets' elements end to end: which are used, and of these the document,
    its band, the segment, where a segment starts, and whether it has a neighbourhood."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    for bands, _ in plan(sizes):
        use = np.repeat(bands >= 0, sizes)
        h, d = flat[use], doc[use]
        band = bands[d]
        seg = ((h >> np.uint64(32)) * SEGMENTS.astype(np.uint64)[band]) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (d[1:] != d[:-1])]) if len(d) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(d)])
        around = (BAND_ENDS[band[first]] <= SMALL) & (n > 1)
        yield use, d, band, seg, first, n, around


def tolerances(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Per role the number of differences that each document's segments stand for."""
    return [np.bincount(d[first], 1 + around, len(sets)).astype(np.int64) for _, d, _, _, first, _, around in segments(sets)]


def signatures(sets: list[np.ndarray]):
    """(document index, kind, unit, signature) arrays of all sets, and per role
    the number of differences that each document's segments stand for.

    A unit is a segment: its number and one in small texts, 0 in others, where a segment
    has one signature.  Kind is the role, plus 2 for a neighbour (one element deleted), plus
    4 where the segment has neighbours, so stands for up to two differences, not one."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    mixed = mix(flat + np.uint64(0x51ED270B7A2C9F35))
    out, tolerance = [], []
    for role, (use, d, band, seg, first, n, around) in enumerate(segments(sets)):
        v = mixed[use]
        total = np.add.reduceat(v, first) if len(first) else np.zeros(0, np.uint64)
        salt = mix(band[first].astype(np.uint64) * np.uint64(1 << 32) + seg[first])
        unit = np.where(BAND_ENDS[band[first]] <= SMALL, seg[first].astype(np.int64) + 1, 0).astype(np.uint8)
        kind = (role + 4 * around).astype(np.uint8)
        tolerance.append(np.bincount(d[first], 1 + around, len(sets)).astype(np.int64))
        out.append((d[first], kind, unit, mix(total ^ salt)))
        short = np.repeat(around, n)
        rest = (np.repeat(total, n) - v)[short]
        out.append((d[short], np.repeat(kind, n)[short] + np.uint8(2), np.repeat(unit, n)[short], mix(rest ^ np.repeat(salt, n)[short])))
    return tuple(np.concatenate(x) for x in zip(*out)), tolerance


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of equal sets alike), and of the document's
    segments the differences they stand for in each role (tol), those to be covered when
    it asks (need0, need1) and those beyond which nothing links with it (reach)."""
    names = ["doc_id", "text_key", "n_shingles", "set_key", "tol0", "tol1", "need0", "need1", "reach"]

    def run(batches):
        sh = Shingler()
        for b in batches:
            for at, texts in chunks(b.column(2), CHUNK):
                sets = sh.sets(texts)
                sizes = np.array([len(s) for s in sets], np.int64)
                t0, t1 = tolerances(sets)
                (_, n0), (b1, n1) = plan(sizes)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(t0),
                     pa.array(t1), pa.array(n0), pa.array(np.where(b1 >= 0, n1, 0)), pa.array(reach(sizes))], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                            F.col(text).alias("text")).mapInArrow(
        tidy(run), "doc_id long, text_key long, n_shingles long, set_key binary, tol0 long, tol1 long, need0 long, need1 long, reach long")


def only(documents: DataFrame, ids: DataFrame, how: str, on: tuple[str, ...] = ("id",)) -> DataFrame:
    """left_semi or left_anti of documents by ``ids`` (a written table): sent to all
    tasks up to ``BROADCAST_IDS`` rows (16 MB), else a shuffled join."""
    ids = ids.select(*on)
    return documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, list(on), how)


def _emitted(documents: DataFrame, n_buckets: int) -> DataFrame:
    """Signature records packed by bucket: a row holds the arrays of one chunk of texts."""
    def run(batches):
        sh = Shingler()
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, texts in chunks(b.column(1), CHUNK):
                # of a repeated row one is enough
                once = set(np.unique(ids[at:at + len(texts)], return_index=True)[1].tolist())
                (doc, kind, unit, sig), _ = signatures(sh.sets([t if i in once else "" for i, t in enumerate(texts)]))
                bucket = ((sig >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                bucket, docs = bucket[order], ids[at + doc].astype("<i8")[order]
                # 32 further bits in a bucket of about PER_BUCKET: an accidental meeting only costs a verification
                low, kind, unit = sig.astype("<u4")[order], kind[order], unit[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(0, np.int64)
                rows = [(int(bucket[i]), docs[i:j].tobytes(), kind[i:j].tobytes(), unit[i:j].tobytes(), low[i:j].tobytes())
                        for i, j in zip(cuts[:-1], cuts[1:])]
                for i in range(0, len(rows), 64):
                    cols = list(zip(*rows[i:i + 64]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                        ["bucket", "docs", "kinds", "units", "low"])

    return documents.select("id", "text").mapInArrow(tidy(run), "bucket long, docs binary, kinds binary, units binary, low binary")


def _repeated(t: pa.Table) -> pa.Table:
    """Of one bucket: the records whose signature occurs more than once, with the count."""
    get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    docs, kinds, units, sig = get("docs", "<i8"), get("kinds", "u1"), get("units", "u1"), get("low", "<u4")
    order = np.argsort(sig)
    s = sig[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.repeat(np.diff(np.r_[first, len(s)]), np.diff(np.r_[first, len(s)]))
    at = order[n > 1]
    bucket = np.int64(t.column("bucket")[0].as_py()) if len(t) else np.int64(0)
    key = (bucket << np.int64(32)) | sig[at].astype(np.int64)
    return in_batches(pa.table({"id": docs[at], "kind": kinds[at].astype(np.int32), "unit": units[at].astype(np.int32), "sig": key, "n": n[n > 1].astype(np.int64)}))


def allocated(batches):
    """Rows of whole texts (id, kind, unit, sig, n, size, tol0, ...), sorted by id, role and unit
    → id, role, sig, size, probes, weight of those that ask or may be found; weight: the sum of
    n over the text, so how common its parts are.

    A unit can be bought plain (its own signature's n) or with its neighbours (the sum of
    all).  What isn't shared is free; then the cheapest are bought until need is covered."""
    def rows(t: pa.Table) -> pa.RecordBatch:
        ids, kind, unit, sig, n, size, *rest = (t.column(c).to_numpy() for c in t.column_names)
        tol0, tol1, need0, need1, most = rest
        role, deleted, around = kind & 1, kind & 2 > 0, kind & 4 > 0
        text = np.cumsum(np.r_[True, (ids[1:] != ids[:-1]) | (role[1:] != role[:-1])]) - 1
        # units without a number have one row each
        start = np.r_[True, (text[1:] != text[:-1]) | (unit[1:] != unit[:-1]) | (unit[1:] == 0)]
        u = np.cumsum(start) - 1
        plain = np.bincount(u, np.where(deleted, 0, n))  # 0: not shared, so free
        whole = np.bincount(u, n)
        of, wide = text[start], around[start]
        has = plain > 0
        head = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        tol, need = (np.where(role[head] == 0, x[head], y[head]) for x, y in ((tol0, tol1), (need0, need1)))
        free = tol - np.bincount(of, has, len(head)) - np.bincount(of, wide, len(head))
        # two things to buy: the plain unit, and what its neighbours add
        cost, buyer = np.r_[plain[has], whole[wide]], np.r_[of[has], of[wide]]
        order = np.lexsort((cost, buyer))
        place = np.arange(len(order)) - np.searchsorted(buyer[order], buyer[order])
        bought = place < (need - free)[buyer[order]]
        price = np.full(len(head), -1.0)  # the dearest thing bought; all that cost no more are
        np.maximum.at(price, buyer[order][bought], cost[order][bought])
        limit = price[text]
        probes = np.where(deleted, whole[u] <= limit, (plain[u] <= limit) | (around & (whole[u] <= limit)))
        stays = np.where(role == 0, free[text] < most, probes)
        weight = np.bincount(of, plain, len(head))[text].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[stays]), pa.array(role[stays].astype(np.int32)), pa.array(sig[stays]), pa.array(size[stays]),
                                           pa.array(probes[stays]), pa.array(weight[stays])], ["id", "role", "sig", "size", "probes", "weight"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None and len(held) else t
        ids = t.column("id").to_numpy()
        cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0  # the last text may go on
        if cut:
            yield rows(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and len(held):
        yield rows(held)


def groups(documents: DataFrame, sizes: DataFrame, n_shingles: int) -> DataFrame:
    """id, role, sig, size, probes, weight of the signatures that a text which asks shares with others."""
    n_buckets = max(1, -(-n_shingles * 6 // (10 * PER_BUCKET)))
    shared = kept(_emitted(documents, n_buckets).groupBy("bucket").applyInArrow(
        _repeated, "id long, kind int, unit int, sig long, n long"), "signatures")
    # a text whose shared signatures leave too many differences on both sides is out before the join
    rows = shared.join(sizes.withColumnRenamed("n_shingles", "size"), "id").select(
        "id", "kind", "unit", "sig", "n", "size", "tol0", "tol1", "need0", "need1", "reach")
    rows = rows.repartition("id").sortWithinPartitions("id", F.col("kind").bitwiseAND(1), "unit").mapInArrow(
        allocated, "id long, role int, sig long, size long, probes boolean, weight long")
    rows = kept(rows, "allocated")
    discard(shared)
    out = kept(rows.join(rows.where("probes").select("sig").distinct(), "sig", "left_semi"), "groups")
    discard(rows)
    return out


def stored_sets(documents: DataFrame) -> DataFrame:
    """id, its set (rising unsigned 64-bit hashes) and parities, in buckets of the id: joins read it as it lies."""
    def run(batches):
        sh, seen = Shingler(), set()
        for b in batches:
            for at, texts in chunks(b.column(1), CHUNK):
                ids = b.column(0).slice(at, len(texts)).to_pylist()
                fresh = [i for i, x in enumerate(ids) if x not in seen]
                seen.update(ids)  # of this task's texts
                found = sh.sets([texts[i] for i in fresh])
                bits = parities(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in fresh], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary()),
                     *(pa.array(bits[:, i]) for i in range(len(PARITY)))], ["id", "elements", *PARITY])

    sets = documents.select("id", "text").mapInArrow(tidy(run), "id long, elements binary, " + ", ".join(f"{k} long" for k in PARITY))
    return bucketed.write(sets, fresh_dir(documents.sparkSession, "sets"), "id")


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set 512 bits: whether the number of its elements in a place is odd.  Where the
    bits of two sets differ, so do the sets: by as many elements at least."""
    place = np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(511)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    odd = np.bincount(doc * 512 + place.astype(np.int64), minlength=len(sets) * 512).reshape(len(sets), 512) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<i8")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, far (the Jaccard distance) of distinct ``pairs`` by the exact sizes of intersection and union."""
    def run(batches):
        for b in batches:
            linked, far = [], []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                linked.append(both > 0 and 100 * both >= percent * union)
                far.append(1.0 - both / union)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "linked", "far"])
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b").select(
        "a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean, far double")


def _close(a: str, b: str):
    """Sizes that can link."""
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b))


def _candidates(asking: DataFrame, found: DataFrame, *apart) -> DataFrame:
    """(a, b), a < b, of rows that ask and rows of their size or less that share a signature and
    whose parities leave it open."""
    x, y = asking.where("probes").alias("x"), found.where("role = 0").alias("y")
    differ = reduce(add, (F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in PARITY))
    met = x.join(y, F.col("x.sig") == F.col("y.sig")).where(
        (F.col("x.id") != F.col("y.id")) & (F.col("x.size") >= F.col("y.size")) & _close("x.size", "y.size")
        & (9 * differ <= F.col("x.size") + F.col("y.size")))
    for condition in apart:
        met = met.where(condition)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def links(documents: DataFrame, sizes: DataFrame, percent: int = 80, every: bool = False) -> DataFrame:
    """(a, b) of verified pairs: of ``every`` link, or of so many that they connect all texts
    that links connect.

    ``documents``: id, text of classes; ``sizes``: their rows of ``measured`` (a written table)."""
    total = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    g = groups(documents, sizes, total)
    sets = stored_sets(only(documents, kept(g.select("id").distinct(), "active"), "left_semi"))
    few = _by_shingle(documents, sizes, percent)
    bits = sets.select("id", *PARITY).dropDuplicates(["id"])
    if every:
        met = kept(g.join(bits, "id"), "met")
        return verified(_candidates(met, met), sets, percent).where("linked").select("a", "b").unionByName(few).distinct()
    none = documents.sparkSession.createDataFrame([], "a long, b long, linked boolean, far double")
    tested, known = none, none.select(F.col("a").alias("id"), F.col("b").alias("component"))

    def try_pairs(pairs):
        nonlocal tested, known
        fresh = kept(pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if not fresh.isEmpty():
            tested = kept(tested.unionByName(verified(fresh, sets, percent)), "tested")
            known = kept(components(tested.where("linked")).withColumnRenamed("node", "id"), "known")

    def labelled():
        return g.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))

    large = kept(g.groupBy("sig").count().where(F.col("count") > GROUP).select("sig"), "large")
    for r in range(PIVOT_ROUNDS if not large.isEmpty() else 0):
        own = labelled().join(large, "sig", "left_semi")
        # pivots: the text whose parts are the commonest, then others by hash, the same for all groups
        order = F.struct("weight", "id") if r == 0 else F.struct(F.xxhash64("id", F.lit(r)), "id")
        pivots = own.groupBy("sig").agg(F.max_by(F.struct("id", "component", "size"), order).alias("p"))
        far = own.join(pivots, "sig").where((F.col("component") != F.col("p.component")) & _close("size", "p.size"))
        try_pairs(far.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")))
    # every pair across components has a member outside the group's main component
    rows = kept(labelled().drop("weight"), "labelled")
    main = rows.groupBy("sig", "component").count().groupBy("sig").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed = rows.join(main.where(F.col("parts") > 1), "sig").where(F.col("probes") | (F.col("role") == 0))
    # what is told of a text joins its rows last: dealt by signature they would carry it along
    mixed = kept(mixed.join(bits, "id").join(_marks(tested), "id", "left"), "mixed")
    discard(rows)
    aside = mixed.where(F.col("component") != F.col("main"))
    # distances are a metric: what a third text tells apart needn't be tried
    apart = (F.col("x.component") != F.col("y.component")) & ~F.coalesce(
        (F.col("x.mark") == F.col("y.mark")) & (F.abs(F.col("x.far") - F.col("y.far")) > 1 - percent / 100 + 1e-9), F.lit(False))
    try_pairs(_candidates(aside, mixed, apart).unionByName(_candidates(mixed.where(F.col("component") == F.col("main")), aside, apart)))
    return tested.where("linked").select("a", "b").unionByName(few)


def _marks(tested: DataFrame) -> DataFrame:
    """id, mark, far: of the texts that a text was compared with, the one compared most often, and the distance to it."""
    both = tested.select(F.col("a").alias("id"), F.col("b").alias("mark"), "far").unionByName(
        tested.select(F.col("b").alias("id"), F.col("a").alias("mark"), "far"))
    often = both.groupBy("mark").count()
    own = often.select(F.col("mark").alias("id"), "mark", F.lit(0.0).alias("far"), "count")
    all_ = both.join(often, "mark").select("id", "mark", "far", "count").unionByName(own)
    return all_.groupBy("id").agg(F.max_by(F.struct("mark", "far"), F.struct("count", "mark")).alias("m")).select("id", "m.mark", "m.far")


def _by_shingle(documents: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links of the texts whose segments are too few for the pigeonhole, to
    texts of their size or less: by each shingle.  Very rare."""
    few = kept(sizes.where((F.col("tol0") < F.col("need0")) | (F.col("tol1") < F.col("need1"))).select("id", "n_shingles"), "few")
    if few.isEmpty():
        return few.select(F.col("id").alias("a"), F.col("id").alias("b"))
    spans = few.select(F.col("n_shingles").alias("most")).distinct()
    fits = sizes.join(spans, (sizes["n_shingles"] <= spans["most"]) & (5 * sizes["n_shingles"] >= 4 * spans["most"]), "left_semi")
    sets = stored_sets(only(documents, kept(fits.select("id"), "fits"), "left_semi"))

    def run(batches):
        for b in batches:
            for d, v in zip(b.column(0).to_pylist(), b.column(1)):
                h = np.frombuffer(v.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d)), pa.array(h)], ["id", "h"])

    each = sets.select("id", "elements").mapInArrow(run, "id long, h long")
    asked = each.join(few.select(F.col("id")), "id", "left_semi").select(F.col("id").alias("p"), "h")
    pairs = each.join(asked, "h").where(F.col("id") != F.col("p")).select(
        F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    return verified(pairs, sets, percent).where("linked").select("a", "b")


def classes(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, text_key, n_shingles, class, representative), the classes (``id`` and their rows of
    :func:`measured`), and one text of each (id, text; maybe several times).

    A class is an equal set; its id is the smallest doc_id with it, or, where a doc_id has several
    sets, a hash of both that is no doc_id.  Rows without doc_id or words have no class."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    m = kept(measured(docs), "measured")
    full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    several = m.where(full).groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi")
    several = kept(m.where(full).join(several, "doc_id", "left_semi").select("doc_id", "text_key", "set_key").distinct(), "several")
    own, salt = None, 0
    while not several.isEmpty():
        own = kept(several.withColumn("id", F.xxhash64("doc_id", "set_key", F.lit(salt))), "ids")
        taken = own.select("id", "doc_id", "set_key").distinct()
        if (taken.groupBy("id").count().where("count > 1").isEmpty()
                and taken.join(m.select(F.col("doc_id").alias("id")), "id", "left_semi").isEmpty()):
            break
        salt += 1

    def with_id(rows):
        if own is None:
            return rows.withColumn("id", F.col("doc_id"))
        return rows.join(own.select("doc_id", "text_key", F.col("id").alias("own")), ["doc_id", "text_key"], "left").withColumn(
            "id", F.coalesce("own", "doc_id")).drop("own")

    cols = ["n_shingles", "tol0", "tol1", "need0", "need1", "reach"]
    heads = with_id(m.where(full)).groupBy("set_key").agg(
        F.min("id").alias("class"), F.min("doc_id").alias("representative"), *(F.min(c).alias(c) for c in cols))
    heads = kept(heads, "heads")
    rows = kept(with_id(m.select("doc_id", "text_key", "n_shingles", "set_key")).join(
        heads.select("set_key", "class", "representative"), "set_key", "left").withColumns(
        {c: F.when(full, F.col(c)) for c in ("class", "representative")}), "classes")
    copies = kept(rows.where(F.col("class") != F.col("id")).select("doc_id", "text_key").distinct(), "copies")
    texts = only(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("text_key", F.xxhash64("text")),
                 copies, "left_anti", ("doc_id", "text_key"))
    return (rows.select("doc_id", "text_key", "n_shingles", "class", "representative"), heads.select(F.col("class").alias("id"), *cols),
            with_id(texts).select("id", "text"))


def join(documents: DataFrame, text: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, representative, text_key (xxhash64 of the text) of every row.

    Texts link when 100 * intersection >= percent * union of their shingle sets
    (percent 80: the segments are made for it).  component_id is the smallest
    doc_id that links reach; representative, the smallest with an equal set.
    A text without words (or null) has n_shingles 0 and is alone; a null doc_id is
    alone with a null component.  Rows of one doc_id with different texts link each by
    its own text; repeated rows get the same answer; an empty table gives no rows.
    """
    if percent < 80:
        raise ValueError("the segments are made for 80 percent and more")
    rows, sizes, texts = classes(documents, text)
    found = kept(components(links(texts, sizes, percent)), "components")
    # a component is named by its smallest doc_id, which its classes' own ids needn't be
    named = rows.where(F.col("class").isNotNull()).join(found.withColumnRenamed("node", "class"), "class", "left")
    least = named.groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("representative").alias("component_id"))
    by_class = found.withColumnRenamed("node", "class").join(least, "component").select("class", "component_id")
    return rows.join(by_class, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "representative", "doc_id").alias("component_id"),
        F.coalesce("representative", "doc_id").alias("representative"), "text_key")


def similar_pairs(documents: DataFrame, text: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link: (doc_id, text_key, n_shingles, class) of all rows, and (a, b), a < b, of all
    classes that link.

    Copies aren't expanded; the second table has a row for each link between different sets, so
    a group of near copies has as many as its size asks for."""
    if percent < 80:
        raise ValueError("the segments are made for 80 percent and more")
    rows, sizes, texts = classes(documents, text)
    return rows.drop("representative"), links(texts, sizes, percent, every=True)


def one_of_each(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are the first (by doc_id) of their group of
    linked texts.  Of rows that agree in doc_id and text one stays; rows without
    doc_id or words all stay."""
    key = free_name(documents, "text_key")
    found = kept(join(documents, text).withColumnRenamed("text_key", key), "joined")
    gone = kept(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id", key).distinct(), "gone")
    out = only(documents.withColumn(key, F.xxhash64(text)), gone, "left_anti", ("doc_id", key))
    twice = kept(found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id", key).count()
                 .where(F.col("count") > 1).select("doc_id", key), "twice")
    if not twice.isEmpty():
        out = only(out, twice, "left_anti", ("doc_id", key)).unionByName(
            only(out, twice, "left_semi", ("doc_id", key)).dropDuplicates(["doc_id", key]))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS h, len(g) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, t.b FROM r JOIN t ON t.a = r.y)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.g)"""
