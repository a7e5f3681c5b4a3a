"""Spelling variants: words that differ by one code point, found by an FM-index.

Two words one edit apart agree on a half of the asking word: the edit lies in the
other.  So words are dealt by halves: a word asks where its own first and where its
own second half lead, and stands to be found where any word of its length or one
more or less would ask.  A half with too many words is parted again by the halves
of what it leaves open, until it is small; at the last only two code points are open.

A bucket of halves has a bidirectional FM-index of its delimited words: an index of
the text and one of its reverse.  A search matches the asked half with its delimiter
exactly, then extends over the rest allowing one error; all words of a bucket step
together through the suffix-rank intervals, in numpy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, kept, table
from .merkle import SQL_CRC, sql_crc32

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many (by its checksum with the document's id) loses a code point.
DAMAGE = 199
#: Rows of one half beyond which it is parted again (more than all words that two
#: open code points can tell apart), rows of a bucket, asking words of a step.
HOT, BUCKET, STEP = 1 << 15, 1 << 15, 1 << 13
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

_LOWER = str.maketrans(UPPER, LOWER)
#: Runs below the least length can't become words.
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)


# ---------------------------------------------------------------- vocabulary
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            if not text:
                continue
            for word, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                if doc_id is not None:
                    h = zlib.crc32(f"{doc_id}:{word}".encode())
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < MIN_LENGTH:
                            continue
                seen[word] += n
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
    if seen:
        yield out()


def vocabulary(documents: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``documents`` (doc_id, text) with ``min_count`` occurrences.

    A null text has no words; the runs of a null doc_id keep all their code points;
    repeated rows count each time; an empty table gives no words."""
    counts = documents.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------- dealing
def _halves(length: Column, least: int) -> tuple[Column, Column]:
    """The first and second halves that words with ``length`` open code points, or one
    more or less (``least`` at least), ask with: (length of the half, is it its own)."""
    def of(half):
        asked = F.array(*(F.struct(half(length + d).alias("half"), (length + d).alias("of")) for d in (0, -1, 1)))
        fits = F.filter(asked, lambda x: (x["of"] >= least) & (x["half"] <= length))
        own = half(length)
        return F.transform(F.array_distinct(F.transform(fits, lambda x: x["half"])),
                           lambda h: F.struct(h.alias("half"), (h == own).alias("own")))

    return of(lambda n: F.floor(n / 2).cast("int")), of(lambda n: (n - F.floor(n / 2)).cast("int"))


def _part(rows: DataFrame, least: int) -> DataFrame:
    """Rows (word, n, a, b, depth, asks): ``a`` first and ``b`` last code points are
    settled.  Each goes on to where one more half of the open ones is settled."""
    first, second = _halves(F.length("word") - F.col("a") - F.col("b"), least)
    ways = F.concat(F.transform(first, lambda h: F.struct(h["half"].alias("x"), F.lit(0).alias("y"), h["own"].alias("own"))),
                    F.transform(second, lambda h: F.struct(F.lit(0).alias("x"), h["half"].alias("y"), h["own"].alias("own"))))
    each = rows.select("word", "n", "a", "b", "depth", "asks", F.explode(ways).alias("w"))
    a, b = (F.col("a") + F.col("w.x")).cast("int"), (F.col("b") + F.col("w.y")).cast("int")
    out = each.select("word", "n", a.alias("a"), b.alias("b"), (F.col("depth") + 1).alias("depth"), (F.col("asks") & F.col("w.own")).alias("asks"))
    return out.withColumn("key", F.xxhash64("depth", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, b)")))


def deal(words: DataFrame, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """The words in ``bucket``s in which all pairs that are one edit apart meet.

    No key keeps more than ``hot`` rows: keys are counted first (a partial
    aggregate), and those above it are parted again."""
    start = words.select("word", "n", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("depth"), F.lit(True).alias("asks"))
    rows = kept(_part(start, MIN_LENGTH), "halves")
    while True:
        many = kept(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot")
        if many.isEmpty():
            break
        rows = kept(rows.join(many, "key", "left_anti").select(*rows.columns).unionByName(_part(rows.join(many, "key", "left_semi"), 0)), "halves")
    n = -(-rows.count() // bucket)
    return rows.withColumn("bucket", F.pmod("key", F.lit(max(1, n))))


# -------------------------------------------------------------------- search
def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Words:
    """Distinct words as codes: 0 is the delimiter, others follow the code points."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        alphabet, codes = np.unique(points, return_inverse=True)
        self.sigma, self.codes = len(alphabet) + 1, codes.astype(np.int64) + 1

    def text(self) -> np.ndarray:
        """The words between delimiters."""
        out = np.zeros(len(self.codes) + len(self.sizes) + 1, np.int64)
        out[_ranges(self.starts + np.arange(len(self.sizes)) + 1, self.sizes)] = self.codes
        return out

    def agree(self, p: np.ndarray, w: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether words ``p`` and ``w`` have the same ``length`` code points from ``at`` on."""
        one, two = _ranges(self.starts[p] + at, length), _ranges(self.starts[w] + at, length)
        pair = np.repeat(np.arange(len(p)), length)
        return np.bincount(pair[self.codes[one] != self.codes[two]], minlength=len(p)) == 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Cyclic suffixes in order, by doubling."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * n + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, k = new, k * 2
        if k >= n or new[order[-1]] == n - 1:
            return order


class FmIndex:
    """Suffix-rank intervals over ``text``, extended to the left."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.order = suffix_array(text)
        self.bwt = text[self.order - 1]
        # (symbol, rank) rising: a search in it counts a symbol's places before a rank
        self.places = np.sort(self.bwt * (self.n + 1) + np.arange(self.n))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.n + 1)
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, lo, hi) for all symbols but the delimiter that extend the intervals."""
        size = hi - lo
        few = np.flatnonzero(size <= sigma)
        seen = np.unique(np.repeat(few, size[few]) * sigma + self.bwt[_ranges(lo[few], size[few])])
        many = np.flatnonzero(size > sigma)
        at = np.concatenate([seen // sigma, np.repeat(many, sigma - 1)])
        symbol = np.concatenate([seen % sigma, np.tile(np.arange(1, sigma), len(many))])
        real = symbol > 0
        at, symbol = at[real], symbol[real]
        lo, hi = self.extend(symbol, lo[at], hi[at])
        real = lo < hi
        return at[real], symbol[real], lo[real], hi[real]


def _search(index: FmIndex, sigma: int, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
            exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, text position) of the words one error away from the patterns, whose
    first ``exact`` symbols match.  A pattern is ``sizes`` codes from ``starts``, in
    the order in which the index extends."""
    def states(*parts):
        return tuple(np.concatenate(x) for x in zip(*parts))

    zero = np.zeros(len(sizes), np.int64)
    q = np.arange(len(sizes))
    lo, hi = index.extend(zero, zero, zero + index.n)  # the delimiter
    none = np.zeros(0, np.int64)
    wrong, found = (none, none, none), []  # states with the error behind them: (pattern, lo, hi)
    for i in range(int(sizes.max(initial=0)) + 1):
        inside = sizes[q] > i
        here = np.where(inside, codes[np.minimum(starts[q] + i, len(codes) - 1)], -1)
        open_ = np.flatnonzero(exact[q] <= i)
        at, symbol, clo, chi = index.children(lo[open_], hi[open_], sigma)
        at = open_[at]
        other = symbol != here[at]  # the pattern's own symbol, put in before itself, is one put in later
        at, clo, chi = at[other], clo[other], chi[other]
        wrong = states(wrong, (q[at], clo, chi))  # a symbol put in
        # patterns that are through: the delimiter must follow
        through = sizes[wrong[0]] == i
        end = wrong[0][through]
        elo, ehi = index.extend(np.zeros(len(end), np.int64), wrong[1][through], wrong[2][through])
        found.append((end[elo < ehi], index.order[elo[elo < ehi]]))
        w, wlo, whi = (x[~through] for x in wrong)
        wlo, whi = index.extend(codes[starts[w] + i], wlo, whi)
        step = (w[wlo < whi], wlo[wlo < whi], whi[wlo < whi])
        replaced = inside[at]
        before = np.where(i > exact[q], codes[np.minimum(starts[q] + i, len(codes) - 1) - (i > 0)], -1)
        left_out = np.flatnonzero(inside & (exact[q] <= i) & (here != before))  # of equal ones, the first
        wrong = states(step, (q[at][replaced], clo[replaced], chi[replaced]), (q[left_out], lo[left_out], hi[left_out]))
        q, lo, hi, here = q[inside], lo[inside], hi[inside], here[inside]
        lo, hi = index.extend(here, lo, hi)
        q, lo, hi = q[lo < hi], lo[lo < hi], hi[lo < hi]
    return tuple(np.concatenate(x) for x in zip(*found))


def _near(words: Words, p: np.ndarray, a: np.ndarray, b: np.ndarray, text: tuple[FmIndex, np.ndarray],
          reverse: tuple[FmIndex, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word): the words one edit from words ``p``, with ``a`` first and ``b`` last code points alike.

    The index of the reverse extends a first half to the right, that of the text a
    second half to the left.  The longer settled side goes first and exactly."""
    rows, near = [], []
    from_end = len(words.codes) - words.starts - words.sizes
    for (index, place), codes, starts, exact, side in (
            (reverse, words.codes, words.starts, a, a >= b), (text, words.codes[::-1], from_end, b, a < b)):
        chosen = np.flatnonzero(side)
        if len(chosen):
            pattern, position = _search(index, words.sigma, codes, starts[p[chosen]], words.sizes[p[chosen]], exact[chosen])
            real = place[position] >= 0  # not the empty word between the text's ends
            pair = np.unique(chosen[pattern[real]] * len(words.sizes) + place[position[real]])
            rows.append(pair // len(words.sizes))
            near.append(pair % len(words.sizes))
    return np.concatenate(rows), np.concatenate(near)


def _due(words: Words, p: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Whether a pair is due at this row and at no other: parting goes by the first half where it agrees."""
    x, y = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    for d in range(int(depth.max(initial=0))):
        on = depth > d
        open_ = words.sizes[p] - x - y
        half = open_ // 2
        fits = words.sizes[w] - x - y >= half
        same = fits & words.agree(p, w, x, np.where(fits & on, half, 0))
        x, y = np.where(on & same, x + half, x), np.where(on & ~same, y + open_ - half, y)
    return (x == a) & (y == b)


def near_words(bucket: pa.Table) -> pa.Table:
    """For each asking row (word, n): the number of near words that are due there, and the one
    with the greatest n (ties: the first in code-point order) with its n."""
    names = sorted(set(bucket["word"].to_pylist()))
    ids = dict(zip(names, range(len(names))))
    row = np.fromiter((ids[x] for x in bucket["word"].to_pylist()), np.int64, len(bucket))
    n = np.zeros(len(names), np.int64)
    n[row] = bucket["n"].to_numpy()
    words = Words(names)
    text = words.text()
    forward, backward = FmIndex(text), FmIndex(text[::-1])
    # the word of a delimiter: the one that opens it in the text, and in its reverse
    opening = words.starts + np.arange(len(names))
    opens, closes = np.full(len(text), -1, np.int64), np.full(len(text), -1, np.int64)
    opens[opening] = np.arange(len(names))
    closes[len(text) - 2 - opening - words.sizes] = np.arange(len(names))
    asks = np.flatnonzero(bucket["asks"].to_numpy())
    p, a, b, depth = (x[asks].astype(np.int64) for x in (row, bucket["a"].to_numpy(), bucket["b"].to_numpy(), bucket["depth"].to_numpy()))
    count, best = np.zeros(len(asks), np.int64), np.full(len(asks), -1, np.int64)
    for lo in range(0, len(asks), STEP):
        s = slice(lo, lo + STEP)
        at, w = _near(words, p[s], a[s], b[s], (forward, opens), (backward, closes))
        due = _due(words, p[s][at], w, a[s][at], b[s][at], depth[s][at])
        at, w = at[due] + lo, w[due]
        count += np.bincount(at, minlength=len(asks))
        order = np.lexsort((w, -n[w], at))
        first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
        best[at[first]] = w[first]
    has = best >= 0
    return pa.table({"word": pa.array([names[i] for i in p], pa.string()), "n": pa.array(n[p], pa.int64()), "n_near": pa.array(count, pa.int64()),
                     "near_n": pa.array(np.where(has, n[best], 0), pa.int64(), mask=~has),
                     "near": pa.array([names[i] if i >= 0 else None for i in best.tolist()], pa.string())})


def variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n; words distinct,
    of ``MIN_LENGTH`` code points at least)."""
    found = deal(words, hot, bucket).groupBy("bucket").applyInArrow(
        near_words, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))))
    per = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    per = kept(per.select("word", "n", "n_near", F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "near")
    # a form's n is ``ratio`` times the word's, so chains are short; each turn doubles what they cover
    links = per.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        joined = kept(joined, "roots")
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    return per.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents (see :func:`vocabulary`) and their forms."""
    return variants(kept(vocabulary(table(spark, sf_dir, "documents")), "vocabulary"))


_CODE_POINTS = "list_transform(string_split({}, ''), lambda x: ord(x))"
#: UTF-8 bytes of ``<doc_id>:<run>``; all its code points are below U+0100.
_BYTES = (f"flatten(list_transform({_CODE_POINTS.format('doc_id || chr(58) || run')}, lambda x: "
          "CASE WHEN x < 128 THEN [CAST(x AS BIGINT)] ELSE [CAST(192 + (x >> 6) AS BIGINT), CAST(128 + (x & 63) AS BIGINT)] END))")

SQL = f"""
  WITH RECURSIVE {SQL_CRC},
  runs AS (SELECT doc_id, run, count(*) AS n FROM (
      SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run
      FROM documents) GROUP BY doc_id, run),
  hashed AS (SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN {sql_crc32(_BYTES)} END AS h FROM runs, crc WHERE length(run) >= {MIN_LENGTH}),
  words AS (SELECT word, sum(n) AS n FROM (
      SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
                     ELSE run END AS word FROM hashed)
    WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
  cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
  pairs AS (
    SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.v
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.v),
  ranked AS (SELECT p.word, p.near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near,
      row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS rn
    FROM pairs p JOIN words w ON w.word = p.near),
  forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= {RATIO} * w.n THEN r.near END AS form,
      CASE WHEN r.n >= {RATIO} * w.n THEN r.n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.rn = 1),
  walk AS (SELECT word, word AS at FROM forms
    UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, walk.at AS root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
  FROM forms f JOIN walk ON walk.word = f.word JOIN forms e ON e.word = walk.at AND e.form IS NULL"""
