"""Merkle manifest of a table: a hash tree per group, one root over the groups.

A leaf is the hash of a row's fields.  Nodes of a group stand in one order; while
a group has several, every ``fanout`` consecutive ones (the last run: fewer) become
their hash.  Per level, lag and lead columns of fixed offset, masked by the node's
slot and the length of its run, are its siblings, and the first child of a run
hashes the parent.

A group of any size is cut into blocks of ``fanout ** height`` consecutive nodes.
A block's levels are windows over one partition and one order, so they share one
shuffle and one sort; the blocks' own nodes are the leaves of the next round.  So a
task holds one block of a group, never a group, and there are log(n) / height rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table
from .shards import prefixed

FANOUT = 2
#: Levels of a block: 2 ** 10 nodes of the binary tree.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step of a proof: the digests left and right of the path's node, concatenated.
STEPS = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return digest(*(field(c) for c in columns))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos`` (the row's place in its group, from 0), and the groups
    (their columns, ``first`` and ``n``), both written.  Nulls stand first; rows
    alike in all of ``order`` are split over partitions like others."""
    placed = kept(prefixed(rows, [*group, *order], {}).drop("part"), "numbered")
    return placed, kept(placed.groupBy(*group).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "groups")


def _levels(n: Column, fanout: int, height: int) -> list[Column]:
    """The number of nodes of a group of ``n`` at each level of a block, and above it."""
    return [F.ceil(n / F.lit(fanout ** level)).cast("long") for level in range(height + 1)]


def _round(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """One round: (tree, pos, n, digest) with ``steps``, the siblings of the row's
    path up to its block's node, and ``top``, that node's digest."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(fanout ** height)).cast("long"))
    block = Window.partitionBy("tree", "block").orderBy("pos")
    counts = _levels(F.col("n"), fanout, height)
    rows = rows.withColumn("d0", F.col("digest"))
    for level in range(height):
        # the row of a node is its first leaf's; nodes of a level stand ``step`` rows apart
        step = fanout ** level
        of_node = F.col("pos") % step == 0
        index = F.floor(F.col("pos") / step).cast("long")
        slot = index % fanout
        run = F.least(F.lit(fanout).cast("long"), counts[level] - (index - slot))
        d = F.col(f"d{level}")
        before = [F.when(slot >= k, F.lag(d, k * step).over(block)) for k in range(fanout - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead(d, k * step).over(block)) for k in range(1, fanout)]
        real = of_node & (counts[level] > 1)
        rows = rows.withColumns({f"l{level}": F.when(real, F.concat_ws("", *before)),
                                 f"r{level}": F.when(real, F.concat_ws("", *after))})
        # the first child hashes its run; a group's only node stays as it is
        parent = digest(d, F.col(f"r{level}"))
        rows = rows.withColumn(f"d{level + 1}", F.when(F.col("pos") % (step * fanout) == 0,
                                                       F.when(counts[level] > 1, parent).otherwise(d)))
    # a path's node at a level is the last one at or before the row
    path = block.rowsBetween(Window.unboundedPreceding, 0)
    sides = {f"{s}{level}": F.last(f"{s}{level}", ignorenulls=True).over(path) for level in range(height) for s in "lr"}
    rows = rows.select(*nodes.columns, "block", F.first(f"d{height}").over(path).alias("top"),
                       *(c.alias(name) for name, c in sides.items()))
    # one column a level: neighbours share siblings, which the files store once
    return rows


def _steps(height: int, keep: Column | None = None) -> Column:
    each = F.array(*(F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(height)))
    return F.filter(each, lambda s: s["l"].isNotNull()).cast(STEPS)


def tree(leaves: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The trees over ``leaves`` (tree long, pos long, n long, digest string, and
    others): positions from 0 without gaps in each tree of ``n`` leaves.

    Returns the leaves with ``steps`` (their proofs, bottom up) and ``root``, and
    (tree, root).  A lone leaf is its root, with no steps."""
    rounds = []
    nodes = leaves
    while True:
        here = kept(_round(nodes, fanout, height), f"merkle-{len(rounds)}", compression="zstd")
        rounds.append(here)
        size = fanout ** height
        nodes = here.where(F.col("pos") % size == 0).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("digest"))
        if here.where(F.col("n") > size).isEmpty():
            break
    roots = nodes.select("tree", F.col("digest").alias("root"))
    above = roots.select("tree", F.lit(0).cast("long").alias("pos"), "root", F.array().cast(STEPS).alias("upper"))
    for i, here in enumerate(reversed(rounds)):
        last = i == len(rounds) - 1
        joined = here.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
        steps = F.concat(_steps(height), F.col("upper"))
        if not last:
            above = joined.select("tree", "pos", "root", steps.alias("upper"))
    return joined.select(*leaves.columns, "root", steps.alias("steps")), roots


def fold(start: Column, steps: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``steps``."""
    return F.aggregate(steps, start, lambda acc, s: digest(s["l"], acc, s["r"]))


def proof(steps: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(rows: DataFrame, group: str, order: str, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``rows`` (``leaf`` and others) with ``subroot`` (of the tree over their group),
    ``root`` (of the tree over the subroots, groups in bytewise order, null first)
    and ``steps``, the siblings from the leaf to the root; columns of ``rows`` that
    have these names are replaced.

    Leaves of a group ascend by ``order``, null first; rows of one ``order`` value by
    their leaf, so repeated rows are leaves of their own.  An empty table gives no rows."""
    inner = rows.select(F.struct(*rows.columns).alias("row"), F.col(group).alias("of"), F.col(order).alias("at"), F.col("leaf").alias("digest"))
    placed, groups = numbered(inner, ["of"], ["at", "digest"])
    ranked, _ = numbered(groups.select(F.col("of").alias("name"), "first", F.col("n").alias("leaves")), [], ["name"])
    total = ranked.agg(F.count(F.lit(1)).alias("n"))  # one row
    names = ranked.select("name", "first", "leaves", F.col("pos").alias("tree"))
    at = placed.join(names, placed["of"].eqNullSafe(names["name"])).select(
        "row", "tree", (placed["pos"] - names["first"]).alias("pos"), F.col("leaves").alias("n"), "digest")
    proved, subroots = tree(at, fanout, height)
    subroots = kept(subroots, "subroots")
    upper, _ = tree(subroots.join(F.broadcast(total)).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "n", F.col("root").alias("digest")), fanout, height)
    upper = upper.select(F.col("pos").alias("tree"), F.col("root").alias("all"), F.col("steps").alias("more"))
    own = [c for c in rows.columns if c.lower() not in ("subroot", "root", "steps")]
    return proved.join(upper, "tree").select(*(F.col("row")[c].alias(c) for c in own), F.col("root").alias("subroot"),
                                             F.col("all").alias("root"), F.concat("steps", "more").alias("steps"))


def tampered(documents: DataFrame) -> tuple[Column, Column]:
    """Which rows are tampered with, and ``n_chars`` there: one more, null stays."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return hit, F.col("n_chars").cast("decimal(38,0)") + 1


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and the root that the tampered
    (else the original) leaf folds to with the original siblings.

    Null fields are ``-``; a null doc_id stands first in its language and isn't
    tampered with; a null ``n_chars`` stays null, so that row still verifies."""
    docs = table(spark, sf_dir, "documents")
    hit, more = tampered(docs)
    changed = leaf(*(more if c == "n_chars" else F.col(c) for c in FIELDS))
    leaves = docs.select("doc_id", "lang", leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(hit, changed).alias("altered"))
    out = manifest(kept(leaves, "leaves"), "lang", "doc_id")
    folded = fold(F.coalesce("altered", "leaf"), F.col("steps"))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_tree(name: str, leaves: str) -> str:
    """CTE ``name`` (tree, level, idx, n, digest) over (tree, idx, n, digest) ``leaves``."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, idx, n, digest FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
    FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 2)"""


def _sql_path(name: str, nodes: str, start: str) -> str:
    """CTE ``name`` (row_id, tree, level, idx, cur, proof): ``start`` carried to the top of ``nodes``."""
    return f"""{name} AS (
    SELECT row_id, tree, 0 AS level, idx, cur, proof FROM {start}
    UNION ALL
    SELECT p.row_id, p.tree, p.level + 1, p.idx // 2,
           sha256(CASE WHEN p.idx % 2 = 1 THEN coalesce(s.digest, '') || p.cur ELSE p.cur || coalesce(s.digest, '') END),
           p.proof || coalesce(s.digest, '')
    FROM {name} p JOIN {nodes} own ON own.tree = p.tree AND own.level = p.level AND own.idx = p.idx
    LEFT JOIN {nodes} s ON s.tree = p.tree AND s.level = p.level AND s.idx = xor(p.idx, 1)
    WHERE own.n > 1)"""


def _sql_leaf(n_chars: str) -> str:
    each = (f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
            for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(each)})"


#: One step of the reflected CRC-32 polynomial per bit, a table of 256 bytes.
SQL_CRC = """crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))"""


def sql_crc32(list_of_bytes: str) -> str:
    """The unsigned crc32 of a BIGINT[] of bytes, beside ``SQL_CRC``'s ``t``."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {list_of_bytes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"

SQL = f"""
  WITH RECURSIVE {SQL_CRC},
  rows_ AS (SELECT row_number() OVER () AS row_id, doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
      {_sql_leaf(f"CASE WHEN doc_id IS NOT NULL AND {sql_crc32(_BYTES)} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS altered
    FROM documents, crc),
  langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees
    FROM (SELECT DISTINCT lang FROM documents)),
  leaves AS (SELECT r.row_id, r.doc_id, l.tree, r.leaf AS digest, r.altered AS cur, '' AS proof, count(*) OVER (PARTITION BY l.tree) AS n,
      row_number() OVER (PARTITION BY l.tree ORDER BY r.doc_id NULLS FIRST, r.leaf) - 1 AS idx
    FROM rows_ r JOIN langs l ON l.lang IS NOT DISTINCT FROM r.lang),
  {_sql_tree("nodes", "leaves")},
  subroots AS (SELECT 0 AS tree, nodes.tree AS idx, n_trees AS n, digest FROM nodes JOIN langs USING (tree) WHERE nodes.n = 1),
  {_sql_tree("upper", "subroots")},
  {_sql_path("climb", "nodes", "leaves")},
  there AS (SELECT c.row_id, 0 AS tree, c.tree AS idx, c.cur, c.proof
    FROM climb c JOIN nodes o ON o.tree = c.tree AND o.level = c.level AND o.idx = c.idx WHERE o.n = 1),
  {_sql_path("climb2", "upper", "there")}
  SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, top.digest AS root, sha256(p.proof) AS proof_sha256,
         p.cur AS folded_root, p.cur = top.digest AS verified
  FROM leaves l JOIN subroots s ON s.idx = l.tree
  JOIN upper top ON top.n = 1
  JOIN climb2 p ON p.row_id = l.row_id AND p.level = top.level"""
