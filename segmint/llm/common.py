"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir
from ..sources import fs

#: ASCII white space: the only word separators of the white-space word rule.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch between Spark and Python, where the cluster doesn't say otherwise.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def bounded(spark: SparkSession) -> SparkSession:
    """``spark`` with Arrow batches bounded by bytes: 10,000 rows of long texts are no bound."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    survives lost executors and is computed once however often it is used."""
    path = fresh_dir(bounded(df.sparkSession), name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete what ``kept`` has written (``table`` as it came from there), once all that reads it is
    itself kept: a long job's tables would else lie there together until its end."""
    fs.delete(table.sparkSession, table.kept_at)


def tidy(run: Callable[[Iterator], Iterator], tokens: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` (a function of Arrow batches) that hands freed memory back when its task ends:
    Python workers stay, and would hold it while later stages need it.  A task that doesn't
    use ``tokens`` drops the tokenizer's pieces that an earlier stage has left in its worker."""
    def tidied(batches):
        left = sys.modules.get("segmint.llm.tokens")
        if left is not None and not tokens:
            left.encoder.cache_clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)
    return tidied


def in_batches(t: pa.Table, rows: int = 1 << 15) -> pa.Table:
    """``t`` in batches of ``rows``: a group's result would else go to Spark as one buffer a
    column, which the executor holds, rounded up, beside its heap."""
    return pa.Table.from_batches(t.combine_chunks().to_batches(max_chunksize=rows), t.schema)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.array_remove(F.split(c, SPACE_RE), "")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
