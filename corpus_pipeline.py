"""A corpus pipeline: quality, repeated lines, near copies, the mixture, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, the next stage's docs; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.bpe import bpe_round_trip
from meshwright.llm.common import documents, written
from meshwright.llm.jaccard import jaccard_components, one_of_each
from meshwright.llm.lines import dedup_lines
from meshwright.llm.mixing import mix, mixed_rows
from meshwright.llm.quality import judge


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is not above the threshold of their language."""
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("keep").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; rows of which no line is left go."""
    out = dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines").select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each class linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return one_of_each(docs, jaccard_components(docs, width=5, percent=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix of sources takes, in as many shards as the session shuffles to, up to a power of two."""
    shards = 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    return mixed_rows(mix(docs, shards=shards), docs.columns, shards)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its token count and digests of its ids and of the decoded text."""
    return bpe_round_trip(docs, keep=("lang", "source"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the perplexities, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
