"""Keyed tables (SNK-1, SNK-2) on Parquet.

A table's rows lie in buckets by the low bits of their key's hash.  A commit is one
small file that names each bucket, the version directory with its rows and their
bytes; it appears by a rename, so a reader sees a whole version or none.  An upsert
reads and rewrites only the buckets that its keys fall into, one task a bucket: its
cost follows the batch.  A bucket that has outgrown ``bucket_bytes`` is split in two,
four, ... by further bits of the hash in the write that rewrites it anyway, so buckets
and write tasks grow with the table and no other bucket is touched.

Versions only rise.  A version below the newest committed one is refused (a
stream restarted with a new checkpoint would lose its rows silently); an equal
one is a replay, starts from the version before and gives the same rows.

On a cluster with a table format the same call is a ``MERGE INTO``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs

BUCKET, CELL = "_bucket", "_cell"
#: Buckets hold about so many bytes of Parquet (at most twice as many after a write).
BUCKET_BYTES = 256 << 20


class StaleVersion(ValueError):
    """A write below the newest committed version."""


def last_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str], *rank) -> DataFrame:
    """The row of each key with the greatest ``rank``: a partial aggregate, so a
    hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*rank)).alias("_r")).select("_r.*")


class KeyedTable:
    """A table with a unique ``key`` (null is a key like others), updated by upserts."""

    def __init__(self, spark: SparkSession, root: str, key: str | Sequence[str],
                 schema: T.StructType | None = None, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.root, self.schema, self.bucket_bytes = spark, root.rstrip("/"), schema, bucket_bytes
        self.keys = [key] if isinstance(key, str) else list(key)

    # -- reading ---------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n) for n in fs.list_files(self.spark, f"{self.root}/_commits") if n.isdigit())

    def latest(self, before: int | None = None) -> int | None:
        """Newest committed version (below ``before``)."""
        return max((v for v in self.versions() if before is None or v < before), default=None)

    def commit_of(self, version: int | None) -> dict:
        """``schema``, and ``buckets``: [n, b, version, bytes] for the keys whose hash modulo n (a power of two) is b."""
        if version is None:
            return {"schema": None, "buckets": [[1, 0, None, 0]]}
        return json.loads(fs.read_text(self.spark, f"{self.root}/_commits/{version}"))

    def _load(self, commit: dict, buckets: Sequence[Sequence[int]]) -> DataFrame:
        schema = T.StructType.fromJson(commit["schema"]) if commit["schema"] else self.schema
        if schema is None:
            raise ValueError(f"keyed table {self.root} has no committed version")
        paths = [f"{self.root}/v{v}/{BUCKET}={n}-{b}" for n, b, v, _ in buckets if v is not None]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, before: int | None = None) -> DataFrame:
        """The rows at ``version`` (default: latest committed, or latest below ``before``)."""
        commit = self.commit_of(version if version is not None else self.latest(before))
        return self._load(commit, commit["buckets"])

    def read_for(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The stored rows of the buckets that the keys of ``rows`` fall into."""
        commit = self.commit_of(self.latest(before))
        return self._load(commit, [commit["buckets"][i] for i in self._touched(rows, commit["buckets"])])

    def lookup(self, *keys) -> DataFrame:
        """Point reads (PRJ-8): the rows of these keys, from their buckets only."""
        stored = self.read()
        wanted = self.spark.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], stored.select(*self.keys).schema)
        return self.read_for(wanted).join(F.broadcast(wanted.distinct()), self.keys, "left_semi")

    # -- buckets ---------------------------------------------------------
    def _located(self, rows: DataFrame, buckets: Sequence[Sequence[int]]) -> DataFrame:
        """``rows`` with ``CELL``, the place in ``buckets`` of the one they fall into, and ``BUCKET``, its name.

        A broadcast of one short row a bucket: the table's bytes / ``bucket_bytes``."""
        cells = self.spark.createDataFrame([(b[0], b[1], i) for i, b in enumerate(buckets)], "_n long, _b long, _cell int")
        h = F.xxhash64(*self.keys)
        at = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("_n"), F.pmod(h, F.lit(n)).alias("_b")) for n in sorted({b[0] for b in buckets}))))
        return rows.select("*", at.alias("_at")).select(*rows.columns, "_at.*").join(F.broadcast(cells), ["_n", "_b"]).select(
            *rows.columns, CELL, F.concat_ws("-", "_n", "_b").alias(BUCKET))

    def _touched(self, rows: DataFrame, buckets: Sequence[Sequence[int]]) -> dict[int, int]:
        """Place in ``buckets`` → number of ``rows``: one entry a bucket at most."""
        return {r[0]: r[1] for r in self._located(rows, buckets).groupBy(CELL).count().collect()}

    # -- writing ---------------------------------------------------------
    def _base(self, version: int) -> int | None:
        newest = self.latest()
        if newest is not None and version < newest:
            raise StaleVersion(f"version {version} of {self.root} is below the newest, {newest}")
        return self.latest(before=version)

    def _staged(self, rows: DataFrame, version: int) -> tuple[DataFrame, int]:
        """``rows`` written once (a lost executor can't change a batch half way), and their bytes."""
        path = f"{self.root}/_staged-{version}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), sum(fs.sizes(self.spark, path).values())

    def _split(self, bucket: Sequence[int], size: float) -> list[list[int]]:
        n, b = bucket[:2]
        parts = 1
        while size > 2 * self.bucket_bytes * parts:
            parts *= 2
        return [[n * parts, b + n * i] for i in range(parts)]

    def _write(self, image: DataFrame, version: int, commit: dict, touched: dict[int, float], schema: T.StructType) -> int:
        """``touched``: place of a bucket → bytes it may have; they are replaced by ``image``."""
        cells = [c for i, size in touched.items() for c in self._split(commit["buckets"][i], size)]
        if cells:
            (self._located(image, cells).repartitionById(len(cells), F.col(CELL)).drop(CELL).sortWithinPartitions(*self.keys)
             .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/v{version}"))
        there = fs.sizes(self.spark, f"{self.root}/v{version}")
        new = [[n, b, version if f"{BUCKET}={n}-{b}" in there else None, there.get(f"{BUCKET}={n}-{b}", 0)] for n, b in cells]
        buckets = [b for i, b in enumerate(commit["buckets"]) if i not in touched] + new
        fs.write_text(self.spark, f"{self.root}/_commits/{version}", json.dumps({"schema": json.loads(schema.json()), "buckets": buckets}))
        fs.delete(self.spark, f"{self.root}/_staged-{version}")
        return version

    def overwrite(self, df: DataFrame, version: int = 0) -> int:
        """Write ``df`` (one row per key) as the whole table."""
        self._base(version)
        staged, size = self._staged(df, version)
        return self._write(staged, version, self.commit_of(None), {0: size}, df.schema)

    def upsert(self, rows: DataFrame, version: int, order: Sequence[str] | None = None) -> int:
        """SNK-1: last write per key wins.

        With ``order`` (columns of the table, greatest wins) repeated keys are
        reduced by it and a stored row newer than the incoming one stays.
        Without, ``rows`` must have one row per key (else ``ValueError``), which
        replaces the stored one.  Returns the version.
        """
        commit = self.commit_of(self._base(version))
        buckets = commit["buckets"]
        schema = T.StructType.fromJson(commit["schema"]) if commit["schema"] else rows.schema
        cols = schema.names
        new = rows.select(*cols)
        new, size = self._staged(last_rows(new, self.keys, cols, *order) if order else new, version)
        if not order and not new.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError("repeated keys need an order")
        touched = self._touched(new, buckets)
        total = sum(touched.values())
        image = new
        if any(buckets[i][2] is not None for i in touched):
            both = self._load(commit, [buckets[i] for i in touched]).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            image = last_rows(both, self.keys, cols, *(order or ()), "_new")
        return self._write(image, version, commit, {i: buckets[i][3] + size * k / total for i, k in touched.items()}, schema)

    def vacuum(self, older_than_s: float) -> None:
        """Drop commits older than this (the newest two stay, for readers and
        replays) and the directories that no commit names any more."""
        limit = time.time() - older_than_s
        for v in self.versions()[:-2]:
            if fs.modified(self.spark, f"{self.root}/_commits/{v}") < limit:
                fs.delete(self.spark, f"{self.root}/_commits/{v}")
        left = self.versions()
        named = {b[2] for c in left for b in self.commit_of(c)["buckets"]} | set(left)
        for n in fs.list_dirs(self.spark, self.root):
            if n[0] == "v" and n[1:].isdigit() and int(n[1:]) not in named and left and int(n[1:]) < left[-1]:
                fs.delete(self.spark, f"{self.root}/{n}")
