"""Manifest, spelling variants and language id against brute force, on small hard cases: nulls in
any column, empty and very long texts, ties and repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmint.llm import language, merkle, spelling

DOC = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string, block string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def documents(spark, tmp_path, rows):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(*r, 1, "t", None) for r in rows], DOC).write.parquet(path)
    return str(tmp_path)


def on_duckdb(sf_dir, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    res = con.execute(sql)
    return [dict(zip([d[0] for d in res.description], r)) for r in res.fetchall()]


def content(rows, columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


R = random.Random(5)
HARD = ([(i, f"s{i % 3}", R.choice(["en", "de", "é", None]), i * 7, f"text {i} ü") for i in range(1, 60)]
        + [(7, "s", "en", None, "n_chars is null"), (None, None, None, None, None), (None, "s", "en", 3, "no id"), (None, "s", "en", 3, "no id"),
           (61, "", "", 0, ""), (62, "s", "xx", 5, None), (63, "s", "yy", 9, "lone"), (64, "s", "en", 1, "漢字 " * 30_000)]
        + [(70, "s", "en", 4, "same")] * 9)


# ------------------------------------------------------------------ op11
def brute_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        p = levels[-1]
        levels.append([sha("".join(p[i:i + fanout])) for i in range(0, len(p), fanout)])
    return levels


def brute_steps(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        run = level[first:first + fanout]
        out.append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
        i //= fanout
    return out


@pytest.mark.parametrize("fanout,height", [(2, 10), (2, 1), (3, 2), (5, 1)])
def test_manifest_against_brute_force(spark, fanout, height):
    rows = [(R.choice(["a", "b", None, "ä", "z"] if n else ["a"]), R.choice([None, *range(40)]), sha(str(R.randrange(60))), "x") for n in range(90)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, steps string").withColumn("block", F.lit(1)).withColumn("d0", F.lit("c"))
    got = merkle.manifest(df, "lang", "doc_id", fanout, height)
    assert got.columns == ["lang", "doc_id", "leaf", "block", "d0", "subroot", "root", "steps"]
    groups = defaultdict(list)
    for lang, doc, leaf, _ in rows:
        groups[lang].append((doc is not None, doc or 0, leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [brute_levels([x[2] for x in sorted(groups[g])], fanout) for g in names]
    top = brute_levels([t[-1][0] for t in trees], fanout)
    want = [(g, leaf, t[-1][0], top[-1][0], tuple(brute_steps(t, i, fanout) + brute_steps(top, k, fanout)))
            for k, (g, t) in enumerate(zip(names, trees)) for i, leaf in enumerate(t[0])]
    have = [(r.lang, r.leaf, r.subroot, r.root, tuple((s.l, s.r) for s in r.steps)) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    proved = got.select(merkle.fold(F.col("leaf"), F.col("steps")).alias("f"), merkle.fold(F.lit("0"), F.col("steps")).alias("g"), "root")
    assert proved.where("f <> root or g = root").isEmpty()


def test_manifest_query_on_hard_rows(spark, tmp_path):
    sf = documents(spark, tmp_path, HARD)
    got = merkle.op11_merkle_manifest(spark, sf)
    rows = [r.asDict() for r in got.collect()]
    assert content(rows, got.columns) == content(on_duckdb(sf, merkle.SQL), got.columns)
    hit = {d for d, _, _, n, _ in HARD if d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0}
    assert hit and {r["doc_id"] for r in rows if not r["verified"]} == hit


def test_manifest_of_one_row_and_none(spark, tmp_path):
    one = documents(spark, tmp_path / "one", [(5, "s", "en", 1, "t")])
    r = merkle.op11_merkle_manifest(spark, one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
    assert merkle.op11_merkle_manifest(spark, documents(spark, tmp_path / "none", [])).count() == 0


# ------------------------------------------------------------------ op12
def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("hot,bucket", [(1 << 15, 1 << 15), (150, 100), (60, 40)])
def test_variants_against_brute_force(spark, hot, bucket):
    """Few letters, one first half in a third of all words, one long pair; small bounds part the halves again and again."""
    r = random.Random(hot)
    words = {"".join(r.choice("aaab") for _ in range(r.randint(6, 10))) for _ in range(300)}
    words |= {"öffnen" + "".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(200)}
    words |= {"x" * 3000, "x" * 1500 + "y" + "x" * 1499, "x" * 3001, "x" * 2999}
    n = {w: r.choice([5, 6, 30, 30, 200, 4000]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), hot=hot, bucket=bucket)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(x) for x in got.collect()} == brute_variants(n)


def test_search_finds_all_at_any_split():
    r = random.Random(3)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(250)})
    n = np.arange(len(names)) % 7 + 5
    bucket = pa.table({"word": names, "n": n, "a": np.zeros(len(names), np.int32), "b": np.zeros(len(names), np.int32),
                       "depth": np.zeros(len(names), np.int32), "asks": [True] * len(names)})
    for x in spelling.near_words(bucket).to_pylist():
        near = [v for v in names if is_near(x["word"], v)]
        best = min(near, key=lambda v: (-n[names.index(v)], v), default=None)
        assert (x["n_near"], x["near"]) == (len(near), best)


def test_every_near_pair_is_due_once(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(150)})
    dealt = spelling.deal(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), hot=30, bucket=25)
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] <= 30 and dealt.select("bucket").distinct().count() > 3


def test_spelling_query_on_hard_rows(spark, tmp_path):
    r = random.Random(4)
    pool = ["liefern", "liefenr", "LIEFERN", "Éclair", "éclair", "éclaire", "strasse", "straße", "a×b÷cde", "kurz", "x" * 50]
    text = lambda: " ".join(r.choice(pool) + r.choice(["", ".", "1"]) for _ in range(60))
    rows = [(r.choice([None, i, 3]), "s", "en", 1, text()) for i in range(50)] + [(None, None, None, None, None), (51, "s", "en", 0, "")]
    rows += [(52, "s", "en", 1, "wiederholung " * 20_000)] + [(53, "s", "en", 1, "gleicher gleicher")] * 4
    sf = documents(spark, tmp_path, rows)
    got = spelling.op12_spelling_variants(spark, sf)
    out = [x.asDict() for x in got.collect()]
    assert content(out, got.columns) == content(on_duckdb(sf, spelling.SQL), got.columns)
    assert {"wiederholung", "gleicher"} <= {x["word"] for x in out}
    words = Counter()
    for doc, _, _, _, t in rows:
        for w in spelling._RUN.findall((t or "").translate(spelling._LOWER)):
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            words[w] += 1
    assert {x["word"]: x["n"] for x in out} == {w: n for w, n in words.items() if n >= 5 and len(w) >= 6}


def test_spelling_of_no_documents(spark, tmp_path):
    assert spelling.op12_spelling_variants(spark, documents(spark, tmp_path, [])).count() == 0


# ------------------------------------------------------------------ op13
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return language.fit(docs.where(~language.held_out(F.col("doc_id"))))


def test_language_of_held_out_rows(spark, model):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.predict(docs.where(language.held_out(F.col("doc_id"))), model).select((F.col("lang") == F.col("lang_pred")).alias("ok"), "rejected")
    r = got.agg(F.count("*"), F.avg(F.col("ok").cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert r[0] > 200 and r[1] >= 0.99 and r[2] < 0.05
    assert len(set(model.of)) == 4 and len(model.of) > 8  # several centroids a language


def test_language_hard_rows(spark, model):
    schema = "doc_id long, text string, lang string, row string, score string, rejected int"
    texts = [None, "", " \n 123 !!", "漢字仮名", "the", "THE AND OF " * 40_000, "Å", "💥", "\0", "der die das und nicht " * 9]
    df = spark.createDataFrame([(i, t, None, "r", "s", 1) for i, t in enumerate(texts)] * 2 + [(None, "the and of that", "en", None, None, None)], schema)
    got = language.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "row", "lang_pred", "score", "distance", "rejected"] and got.count() == 2 * len(texts) + 1
    said = defaultdict(set)
    for r in got.collect():
        said[r.doc_id].add((r.lang_pred, r.score, r.rejected))
        assert 0.0 <= r.score <= 1.0 and (r.score < 0.5) == r.rejected
    assert all(len(x) == 1 for x in said.values())
    said = {k: next(iter(v)) for k, v in said.items()}
    for i, t in enumerate(texts):
        assert (said[i][0] == "und") == (not any(c.isalpha() for c in t or ""))
    assert said[9][0] == "de" and said[3][2] and said[3][0] in model.languages
    assert language.predict(df.limit(0), model).count() == 0


def test_nearest_centroid_against_brute_force(spark, model):
    """Counts, weights and distances as plain Python says them."""
    texts = ["Die Straße, im\nRegen", "a", "el niño y la", "ﬀ x" * 5, "ou est-ce que" * 3]
    have = language.counts(texts)
    mask = (1 << 64) - 1
    p = [int(x) for x in language._P]

    def slot(h, n):
        return int(language.mix(np.array([(h + n) & mask], np.uint64))[0] >> np.uint64(64 - language.BITS))

    for text, row, said in zip(texts, have, zip(*model.judge(texts))):
        c = [0, *(ord(x) if x.isalpha() else 0 for x in text.lower()), 0]
        want = Counter()
        for i in range(1, len(c) - 1):
            if c[i]:
                want[slot(c[i], 1)] += 1
                want[slot(((c[i - 1] * p[0] + c[i]) * p[1] + c[i + 1] * p[2]) & mask, 3)] += 1
        for i in range(len(c) - 1):
            if c[i] or c[i + 1]:
                want[slot((c[i] * p[0] + c[i + 1]) & mask, 2)] += 1
        assert {i: n for i, n in enumerate(row.tolist()) if n} == dict(want)
        x = {i: np.log1p(n) * model.idf[i] for i, n in want.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        distances = [1 - sum(v * centre[i] for i, v in x.items()) / norm for centre in model.centroids]
        best = int(np.argmin(distances))
        assert abs(distances[best] - said[2]) < 1e-4 and said[0] == model.languages[model.of[best]]


def test_language_fits_with_little(spark):
    rows = spark.createDataFrame([("nur ein Text", "de"), (None, "en"), ("no language", None), ("123", "zz"), ("le seul", "fr"), ("le seul", "fr")],
                                 "text string, lang string")
    m = language.fit(rows)
    assert m.languages == ["fr", "de"]
    assert [r.lang_pred for r in language.predict(rows.select("text"), m).where("text = 'le seul'").collect()] == ["fr"] * 2
    none = language.fit(rows.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(rows.select("text"), none).collect()} == {("und", 0.0)}


def test_clusters_part_two_kinds():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(0, 0.05, (60, 20)))
    x[:30, 0] += 1
    x[30:, 1] += 1
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    centres, member = language.cluster(x, 2)
    assert len(centres) == 2 and len(set(member[:30])) == len(set(member[30:])) == 1 and member[0] != member[-1]
