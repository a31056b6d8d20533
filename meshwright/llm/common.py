"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_dir, written

__all__ = ["WORD", "documents", "flagged", "free", "present", "shared_dir", "words", "written"]

#: A word: a run of anything but space and the ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"

def words(text: str | None) -> list[str]:
    """The words of a text, as WORD finds them; none for null."""
    return [w.decode() for w in text.encode().split()] if text else []  # bytes.split cuts at just these characters


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The table `documents`, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


FILTER_BITS = 1 << 23


def flagged(rows: DataFrame, ids: DataFrame, key: str, into: str = "_maybe") -> DataFrame:
    """rows with a boolean column: whether the key may be among ids (a table with that column). True for all that are, and for few others.

    A bitmap of fixed size, 1 MB, which is broadcast, spares most rows the join that must follow; the more ids, the fewer it spares. Null keys: false.
    """
    code = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    # Spark's bitmap functions number values from 1: value v is bit (v - 1) % 32768 of bucket 1 + (v - 1) div 32768.
    bits = ids.select((code + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    at, bucket, found = (free(rows, c) for c in ("at", "bucket", "bits"))
    known = rows.withColumn(at, F.when(F.col(key).isNotNull(), code)).join(F.broadcast(bits.select(F.col("k").alias(bucket), F.col("bits").alias(found))), F.expr(f"1 + `{at}` div 32768") == F.col(bucket), "left")
    byte = f"cast(conv(hex(substring(`{found}`, cast(`{at}` % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return known.select(*(F.col(f"`{c}`") for c in rows.columns), F.expr(f"coalesce(shiftright({byte}, cast(`{at}` % 8 as int)) & 1 = 1, false)").alias(into))


def present(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those rows whose key may be among ids: see flagged."""
    maybe = free(rows, "maybe")
    return flagged(rows, ids, key, maybe).filter(F.col(maybe)).drop(maybe)
