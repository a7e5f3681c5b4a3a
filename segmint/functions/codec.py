"""Message codecs (FN-7 .. FN-11).

Messages carry JSON text (in place of the reference's EDN) parsed with an
explicit schema, or raw bytes.  All conversions are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse(text: str | Column, schema: T.StructType | str) -> Column:
    """FN-7: message text to a record (a struct with ``schema``'s fields).

    Malformed text yields a struct of nulls rather than an error; use
    :func:`parse_checked` to keep the bad rows visible.
    """
    return F.from_json(_c(text), schema)


def parse_checked(df: DataFrame, text: str, schema: T.StructType | str,
                  out: str = "record") -> DataFrame:
    """FN-7 with error routing: adds ``out`` (the record) and ``bad`` (true when
    the text did not parse as a JSON object of the schema)."""
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_corrupt = T.StructType(list(st.fields) + [T.StructField(CORRUPT, T.StringType())])
    rec = F.from_json(F.col(text), with_corrupt,
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (df.withColumn("_rec", rec)
              .withColumn("bad", F.col("_rec").isNull() | F.col(f"_rec.{CORRUPT}").isNotNull())
              .withColumn(out, F.struct(*[F.col(f"_rec.{f.name}").alias(f.name) for f in st.fields]))
              .drop("_rec"))


def render(*cols: str | Column) -> Column:
    """FN-8: a record (the given columns) to JSON message text."""
    return F.to_json(F.struct(*[_c(c) for c in cols]))


def bytes_to_text(x: str | Column) -> Column:
    """FN-9: UTF-8 bytes to text."""
    return F.decode(_c(x), "UTF-8")


def text_to_bytes(x: str | Column) -> Column:
    """FN-10: text to UTF-8 bytes."""
    return F.encode(_c(x), "UTF-8")


def number_text(n: str | Column, suffix: str) -> Column:
    """FN-11: a number's decimal text followed by a literal."""
    return F.concat(_c(n).cast("string"), F.lit(suffix))
