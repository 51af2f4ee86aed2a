"""The corpus pipeline: documents through five training-data operators, stage by stage.

Every stage takes what its predecessor kept, as written and read again, and all but the last
return the columns of ``documents``. Rows are told apart by doc_id and text, so rows without
an id, or with a repeated one, pass like any other; what is written goes when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import toxicity as toxic
from symgraph.llm.common import crc_mod, read_table, shared_dir
from symgraph.llm.decontaminate import decontaminate
from symgraph.llm.line_dedup import dedup_lines
from symgraph.llm.packing import pack_documents
from symgraph.llm.queries import tokenizer_path
from symgraph.llm.simhash import one_of_each
from symgraph.session import with_package


@with_package
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = read_table(spark, sf_dir, "labels")
    return toxic.drop_toxic(docs, toxic.train(docs, labels, training=crc_mod(F.col("doc_id"), 5) != 0))


@with_package
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the runs of lines that occur earlier; one whose lines all go has an empty text."""
    return dedup_lines(docs).select(*docs.columns)


@with_package
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: SimHash index, exact check by shingles of five words, completion."""
    return one_of_each(docs)


@with_package
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


@with_package
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every kept document, placed in training sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Learned scores and token ids are not expressible in SQL; tests compare stage by stage.
ORACLE_SQL = None
