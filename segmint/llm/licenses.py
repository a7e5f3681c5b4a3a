"""License scans: ordered signature rules over normalised words.

A text becomes one string of words, each after a space.  A rule is a regex with
a keyword; only rules whose keyword occurs in the text are run.  Detections are
word intervals.  A detection inside another's interval is dropped unless its
priority is better.  Everything is a column expression: no shuffle, no UDF.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, table

#: What stands between words, before lower-casing (A-Z belong to words).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword (in every match of the name), regex of the name (words after single spaces),
#: identifiers (empty: those of the row before).
FAMILIES = (
    ("mit", "mit", "(?:the )?mit", "mit"),
    ("apache", "apache", "(?:the )?apache(?: software)?", "apache 2 0"),
    ("agpl", "affero", "(?:the )?(?:gnu )?affero general public", "agpl 3 0"),
    ("lgpl", "lesser general public", "(?:the )?(?:gnu )?lesser general public", "lgpl [23] \\d"),
    ("lgpl", "library general public", "(?:the )?(?:gnu )?library general public", ""),
    ("gpl", "general public", "(?:the )?(?:gnu )?general public", "gpl [23] 0"),
    ("bsd", "bsd", "(?:the )?(?:(?:new|modified|simplified|revised|original) )?(?:[0234] clause )?bsd", "bsd [0234] clause"),
    ("mpl", "mozilla", "(?:the )?mozilla public", "mpl [12] \\d"),
    ("epl", "eclipse", "(?:the )?eclipse public", "epl [12] 0"),
    ("cddl", "common development", "(?:the )?common development and distribution", "cddl 1 \\d"),
    ("isc", "isc", "(?:the )?isc", "isc"),
    ("zlib", "zlib", "(?:the )?zlib", "zlib"),
    ("boost", "boost", "(?:the )?boost software", "bsl 1 0"),
    ("artistic", "artistic", "(?:the )?(?:perl )?artistic", "artistic [12] 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl", "wtfpl"),
    ("eupl", "european union", "(?:the )?european union public", "eupl 1 \\d"),
    ("osl", "open software", "(?:the )?open software", "osl 3 0"),
    ("afl", "academic free", "(?:the )?academic free", "afl 3 0"),
    ("ms-pl", "microsoft public", "(?:the )?microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "(?:the )?microsoft reciprocal", "ms rl"),
    ("python", "python", "(?:the )?python(?: software foundation)?", "psf 2 0"),
    ("php", "php", "(?:the )?php", "php 3 01"),
    ("ruby", "ruby", "(?:the )?ruby", "ruby"),
    ("openssl", "openssl", "(?:the )?openssl", "openssl"),
    ("postgresql", "postgresql", "(?:the )?postgresql", "postgresql"),
    ("ofl", "open font", "(?:the )?(?:sil )?open font", "ofl 1 1"),
    ("ncsa", "ncsa", "(?:the )?(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("x11", "x11", "(?:the )?x11", "x11"),
    ("cpl", "common public", "(?:the )?common public", "cpl 1 0"),
    ("ipl", "ibm public", "(?:the )?ibm public", "ipl 1 0"),
    ("apsl", "apple public", "(?:the )?apple public source", "apsl 2 0"),
    ("cecill", "cecill", "(?:the )?cecill", "cecill [12] \\d"),
    ("gfdl", "free documentation", "(?:the )?(?:gnu )?free documentation", "gfdl 1 \\d"),
    ("odbl", "open database", "(?:the )?open database", "odbl 1 0"),
    ("beerware", "beerware", "(?:the )?beerware", "beerware"),
    ("qpl", "q public", "(?:the )?q public", "qpl 1 0"),
    ("cc-by-nc-nd", "nc nd", "(?:the )?(?:cc|creative commons) by nc nd(?: \\d \\d)?", "cc by nc nd \\d 0"),
    ("cc-by-nc-sa", "nc sa", "(?:the )?(?:cc|creative commons) by nc sa(?: \\d \\d)?", "cc by nc sa \\d 0"),
    ("cc-by-nc", "by nc", "(?:the )?(?:cc|creative commons) by nc(?: \\d \\d)?", "cc by nc \\d 0"),
    ("cc-by-nd", "by nd", "(?:the )?(?:cc|creative commons) by nd(?: \\d \\d)?", "cc by nd \\d 0"),
    ("cc-by-sa", "by sa", "(?:the )?(?:cc|creative commons) by sa(?: \\d \\d)?", "cc by sa \\d 0"),
    ("cc-by", "cc by", "(?:the )?cc by(?: \\d \\d)?", "cc by \\d 0"),
    ("cc-by", "creative commons by", "(?:the )?creative commons by(?: \\d \\d)?", ""),
    ("cc0", "cc0", "(?:the )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
)
#: regex with the family's name (N) or identifier (I), priority (0 is best), weight of the evidence.
FORMS = (
    ("spdx license identifier I", 0, 1.0),
    ("(?:dual |re)?licen[sc]ed under N(?: licen[sc]e)?(?: version)?(?: v?\\d+){0,2}", 1, 0.95),
    ("(?:released|distributed|published|available|provided) under N(?: licen[sc]e)?(?: version)?(?: v?\\d+){0,2}", 1, 0.95),
    ("under the (?:terms|conditions) of N(?: licen[sc]e)?(?: version)?(?: v?\\d+){0,2}", 1, 0.9),
    ("N licen[sc]e(?: version)?(?: v?\\d+){0,2}", 2, 0.8),
    ("N (?:style|type|like) licen[sc]e", 3, 0.5),
)
#: label, keyword, regex, priority, weight.
NOTICES = (
    ("all-rights-reserved", "rights reserved", "all rights reserved", 3, 0.5),
    ("proprietary", "proprietary", "proprietary(?: and confidential)?", 4, 0.3),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", 2, 0.7),
    ("no-warranty", "warranty", "without (?:any )?warranty(?: of any kind)?", 4, 0.2),
    ("as-is", "as is", "provided as is", 4, 0.2),
    ("permission-notice", "permission", "permission is hereby granted free of charge", 2, 0.7),
    ("redistribution-notice", "redistribution", "redistribution and use in source and binary forms", 2, 0.7),
)
LEVELS = 5
#: Every rule and base phrase has one of these inside a word; texts without any are done.
TRIGGERS = ("license", "licence", "spdx", "reserved", "proprietary", "domain", "warranty", "provided", "permission",
            "redistribution", "released", "distributed", "published", "available", "terms", "conditions")


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, regex, label, priority, weight), in order: every form of every family, then the notices."""
    out = [(key if " I" not in form else "spdx", form.replace("N", name).replace("I", ident), label, level, weight)
           for label, key, name, ident in FAMILIES for form, level, weight in FORMS if ident or " I" not in form]
    return out + [(key, regex, label, level, weight) for label, key, regex, level, weight in NOTICES]


def _rules_literal() -> Column:
    rows = [{"key": k, "regex": f" {r}(?= |\\z)", "label": lb, "level": p, "weight": w} for k, r, lb, p, w in rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<key:string,regex:string,label:string,level:int,weight:double>>")


def _words_in(text: Column) -> Column:
    """Number of words, without making them."""
    n = F.size(F.split(text, SEPARATORS, -1))
    ends = lambda side: F.when(text.rlike(side), 1).otherwise(0)
    return F.when(F.length(text) == 0, 0).otherwise(
        F.greatest(F.lit(0), n - ends(f"^{SEPARATORS}") - ends(f"{SEPARATORS}\\z"))).cast("long")


def normalised(text: Column) -> Column:
    """The words, each after one space; empty for a text without words."""
    t = F.trim(F.regexp_replace(ascii_lower(text), SEPARATORS, " "))
    return F.when(F.length(t) > 0, F.concat(F.lit(" "), t)).otherwise("")


def n_words(norm: Column) -> Column:
    """Words of a normalised text."""
    return (F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))).cast("long")


_DETECTION = "array<struct<start:bigint,stop_back:bigint,level:int,label:string,weight:double>>"


def _detect(norm: Column, r: Column) -> Column:
    """The places of one rule: word intervals [start, stop), in order."""
    hits = F.regexp_extract_all(norm, r["regex"], F.lit(0))
    between = F.slice(F.split(norm, r["regex"], -1), 1, F.size(hits))
    def step(a, x):
        start = a["at"] + n_words(x["between"])
        stop = start + n_words(x["hit"])
        one = F.array(F.struct(start.alias("start"), (-stop).alias("stop_back"), r["level"].alias("level"),
                               r["label"].alias("label"), r["weight"].alias("weight")))
        return F.struct(stop.alias("at"), F.concat(a["out"], one.cast(_DETECTION)).alias("out"))
    return F.aggregate(F.arrays_zip(between.alias("between"), hits.alias("hit")),
                       F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_DETECTION).alias("out")),
                       step, lambda a: a["out"])


def with_detections(df: DataFrame, norm: str, out: str) -> DataFrame:
    """``df`` and ``out``: the kept detections (start, stop, level, label, weight)
    of the normalised text ``norm``, by start."""
    literal = _rules_literal()
    text = F.col(norm)
    fired = F.when(F.length(text) > 0, F.filter(literal, lambda r: F.contains(text, r["key"])))
    found, ordered = free_name(df, "_fired"), free_name(df, "_found")
    df = df.withColumn(found, fired)
    # by start, the longer one first, then priority: what may contain a detection stands before it
    df = df.withColumn(ordered, F.sort_array(F.flatten(F.transform(found, lambda r: _detect(text, r)))))

    def step(a, x):
        stop = -x["stop_back"]
        inside = F.exists(F.slice(a["ends"], 1, x["level"] + 1), lambda e: e >= stop)
        ends = F.transform(a["ends"], lambda e, i: F.when(i == x["level"], F.greatest(e, stop)).otherwise(e))
        return F.struct(ends.alias("ends"),
                        F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(x))).alias("out"))

    kept = F.aggregate(F.col(ordered), F.struct(F.array_repeat(F.lit(0).cast("long"), LEVELS).alias("ends"),
                                                F.array().cast(_DETECTION).alias("out")), step, lambda a: a["out"])
    empty = F.array().cast(_DETECTION)
    return df.withColumn(out, F.transform(F.coalesce(kept, empty), lambda x: F.struct(
        x["start"].alias("start"), (-x["stop_back"]).alias("stop"), x["level"].alias("level"),
        x["label"].alias("label"), x["weight"].alias("weight")))).drop(found, ordered)


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, base columns, labels, score and the kept ``detections``.

    A null or empty text has no words, no place and score 0.  Each row is
    scanned by itself, repeated rows alike; other columns are not read.
    """
    df = documents.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.select("doc_id", "t", F.lower("t").alias("low"))
    triggered = F.contains(F.col("low"), F.lit(TRIGGERS[0]))
    for t in TRIGGERS[1:]:
        triggered |= F.contains(F.col("low"), F.lit(t))
    df = df.select("doc_id", _words_in(F.col("t")).alias("n_words"),
                   F.when(triggered, normalised(F.col("t"))).otherwise("").alias("norm"))
    norm = F.col("norm")
    gated = lambda p: F.when(F.contains(norm, F.lit(f" {p}")), F.split(norm, f" {p}(?= |\\z)", -1))
    df = df.withColumns({f"b{i}": gated(p) for i, (p, _) in enumerate(PHRASES)})
    df = with_detections(df, "norm", "detections")
    firsts, lasts, counts, labels = [], [], [], []
    for i, (p, label) in enumerate(PHRASES):
        b = F.col(f"b{i}")
        there = F.size(b) > 1
        firsts.append(F.when(there, n_words(b[0])))
        lasts.append(F.when(there, F.col("n_words") - n_words(F.element_at(b, -1)) - len(p.split())))
        counts.append(F.when(there, F.size(b) - 1).otherwise(0).cast("long"))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    own = F.transform("detections", lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0))
    return df.select("doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"),
                     F.greatest(*lasts).alias("last_word"), joined(base).alias("base_labels"),
                     joined(F.concat(base, own)).alias("labels"),
                     F.when(F.size(base) > 0, F.greatest(best, F.lit(0.8))).otherwise(best).alias("score"), "detections")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
