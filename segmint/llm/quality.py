"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a ratio of two text statistics with a lower and an upper bound.
The statistics and the verdicts are plain column expressions, so a text is
judged where it is read: no shuffle, no user function.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, table, words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French, Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "was", "for", "on", "as", "with", "by",
    "der", "die", "das", "und", "den", "ein", "eine", "nicht", "sich", "mit", "auf",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "pour", "dans", "que", "en", "du",
    "el", "los", "las", "y", "del", "se", "por", "con", "no", "una", "lo",
)

Rule = namedtuple("Rule", "name over under low high")
#: A text fails a rule when ``over`` is less than floor(low * under) or more
#: than high * under; so a short text isn't failed for a fraction of a word.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.3),
    Rule("exclamation", "n_exclaim", "n_words", None, 0.5),
    Rule("capitals", "n_upper", "word_chars", None, 0.6),
    Rule("stop_words", "n_stop", "n_words", 0.05, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5


def _count(text: Column, one: str) -> Column:
    """Places of a one-character regex."""
    return (F.size(F.split(text, one, -1)) - 1).cast("long")


def with_stats(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` and the text statistics (columns named ``prefix`` + name).

    n_words, word_chars (code points in words), n_symbols, n_exclaim, n_upper
    (A-Z), n_stop, n_lines (lines with a word), n_dup_lines (lines equal to an
    earlier one), n_repeat_words (words inside five-word windows that occur
    twice or more in the text).  A null text counts as empty.
    """
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = df.withColumns({f"{p}_t": t, f"{p}_w": words(t),
                             f"{p}_l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w, lines, t = F.col(f"{p}_w"), F.col(f"{p}_l"), F.col(f"{p}_t")
    n = F.size(w)
    counted = spaced.withColumns({
        f"{p}n_words": n.cast("long"),
        f"{p}word_chars": F.length(F.array_join(w, "")).cast("long"),
        f"{p}n_symbols": _count(t, f"[{SYMBOLS}]"),
        f"{p}n_exclaim": _count(t, "!"),
        f"{p}n_upper": F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long"),
        f"{p}n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}_h": F.transform(w, lambda x: F.xxhash64(x)),
    })
    h = F.col(f"{p}_h")
    # hashes of the windows: only texts in which two agree go on
    windows = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
    counted = counted.withColumn(f"{p}_h", F.slice(windows, 1, F.greatest(F.lit(0), F.size(h) - (WINDOW - 1))))
    dup = F.size(F.array_distinct(h)) < F.size(h)
    # the windows themselves, sorted, so that equal ones are neighbours
    windows = F.sort_array(F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(
        F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))
    sorted_ = counted.withColumn(f"{p}_s", F.when(dup, windows))
    s = F.col(f"{p}_s")
    same = lambda a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
    at = F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
        lambda k: F.get(s, k)["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
        lambda a: a["n"])
    out = sorted_.withColumn(f"{p}n_repeat_words", F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered))
    return out.drop(*(f"{p}{c}" for c in ("_t", "_w", "_l", "_h", "_s")))


def verdict(rules=RULES, prefix: str = "") -> tuple[Column, Column]:
    """(base_failed, kept) as expressions over the statistics."""
    c = lambda name: F.col(prefix + name)
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    passed = F.lit(True)
    for r in rules:
        if r.low is not None:
            passed &= c(r.over) >= F.floor(r.low * c(r.under))
        if r.high is not None:
            passed &= c(r.over) <= r.high * c(r.under)
    return failed, ~failed & passed


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept.

    A null or empty text has no words and fails.  Repeated rows are judged
    alike, one result row each; other columns of ``df`` are not looked at.
    """
    stats = with_stats(df.select("doc_id", F.col(text).alias("text")))
    failed, kept = verdict(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), kept.alias("kept"))


def keep(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns."""
    p = "_quality_"
    while any(c.lower().startswith(p) for c in df.columns):
        p = "_" + p
    # a one-row generator instead of a filter: the optimizer would push a filter below the
    # statistics and repeat their expressions for every mention
    passed = F.explode(F.filter(F.array(verdict(rules, p)[1]), lambda x: x))
    return with_stats(df, text, p).withColumn(f"{p}kept", passed).select(*[F.col(f"`{c}`") for c in df.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = [f"{r.over} >= floor({r.low} * {r.under})" for r in RULES if r.low is not None]
    tests += [f"{r.over} <= {r.high} * {r.under}" for r in RULES if r.high is not None]
    gone = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    return rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS g FROM a),
d AS (
  SELECT *, list_transform(list_filter(map_entries(found), lambda e: e.value > 1), lambda e: e.key) AS dup
  FROM (SELECT *, list_histogram(g) AS found FROM g)),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         {gone(SYMBOLS)}::BIGINT AS n_symbols, {gone('!')}::BIGINT AS n_exclaim,
         {gone(UPPER)}::BIGINT AS n_upper,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         CASE WHEN len(dup) = 0 OR dup IS NULL THEN 0 ELSE len(list_distinct(flatten(list_transform(
           list_filter(range(1, len(w) - 3), lambda i: list_contains(dup, g[i])), lambda i: range(i, i + 5))))) END::BIGINT
           AS n_repeat_words
  FROM d),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(tests)} AS kept
FROM f"""


SQL = _sql()
