"""The training-data pipeline: quality, near duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet
and read again as the next stage's docs. The quality stage drops what the
classifier rejects, the next keeps one document of each group of near copies,
the third replaces secrets in place, the fourth repeats and leaves out
documents as the mix takes them, and the last packs all that is left.

Cases: all stages but the last keep the columns of their input, whatever their
names, and read doc_id, text and source alone. A null or blank text has no
words, so the quality stage drops it; a null doc_id is never a near copy; a
null source is a source of its own. Rows that share a doc_id or a text count
one by one, but for the near duplicates, where one of equal texts stays. Very
long texts pass whole. Without labels the quality stage keeps every text with
words; from an empty table every stage gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import documents, materialize
from siltstone.llm.mixing import mixed_documents
from siltstone.llm.neardup import without_near_duplicates
from siltstone.llm.packing import pack
from siltstone.llm.quality import resample
from siltstone.llm.secrets import redacted


#: Near copies share 80 % of their shingles; op2's contract has a threshold of its own.
NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs, NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("packing", packing)]

#: No SQL can express the hashed models, MinHash or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
