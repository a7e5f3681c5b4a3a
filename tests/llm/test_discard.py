"""Tables that a join no longer needs don't lie there until its end (op2)."""

import random

from pyspark.sql import functions as F

from segmint.llm import common, jaccard_join
from segmint.session import shared_root
from segmint.sources import fs


def test_discard(spark):
    t = common.kept(spark.range(3).toDF("id"), "discarded")
    assert t.count() == 3 and fs.exists(spark, t.kept_at)
    common.discard(t)
    assert not fs.exists(spark, t.kept_at)


def test_join_leaves_no_dead_tables(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):  # threes of near copies, and a line that all texts have
        words = [f"w{random.Random(i // 3).randrange(10 ** 6)}x{j}" for j in range(120)]
        words[r.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(words + [f"c{j}" for j in range(100)])))
    before = set(fs.list_dirs(spark, shared_root(spark)))
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    made = {d.split("-")[0] for d in set(fs.list_dirs(spark, shared_root(spark))) - before}
    assert "groups" in made and "mixed" in made and not made & {"signatures", "allocated", "labelled"}
    assert found.where(F.col("component_id") != F.floor(F.col("doc_id") / 3) * 3).isEmpty()
