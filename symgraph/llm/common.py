"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of a table's rows on, so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh path under the folder that all executors share (``spark.checkpoint.dir``); it goes when the driver ends.

    Where that setting is unset and everything runs in one process, as in tests, a temporary
    folder is made and stored in the setting; on a cluster its absence is an error.
    """
    path = f"{_shared_root(spark)}/{kind}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def _shared_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there."""
    path = shared_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(names: DataFrame, order: Sequence[str], kind: str) -> DataFrame:
    """``names``, sorted and written, with ``rank``: numbers that rise with the order."""
    return written(names.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()), kind)


def join_classes(rows: DataFrame, classes: DataFrame, keys: Sequence[str], copies: str = "copies") -> DataFrame:
    """``rows`` joined with ``classes``, which has one row for each of some keys and how many ``rows`` have it.

    Keys with over a thousandth of the counted rows number fewer than a thousand: they are
    broadcast, so their rows stay where they are. The others meet by exchange. Both tables
    should be written ones, as they are read more than once.
    """
    total = classes.agg(F.sum(copies)).first()[0] or 0
    hot = classes.where(F.col(copies) > max(total * HOT_SHARE, 1000))
    if hot.isEmpty():
        return rows.join(classes, list(keys))
    hot = written(hot, "hot-keys")
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    rest = rest.join(classes.where(F.col(copies) <= max(total * HOT_SHARE, 1000)), list(keys))
    return rows.join(F.broadcast(hot), list(keys)).unionByName(rest)


def text_key(text: Column) -> Column:
    """A hash that tells texts under one doc_id apart (null for a null text)."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def as_rows(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with each row as one struct, beside ``doc_id`` and ``text``: no other column can clash."""
    return docs.select(F.struct("*").alias(name), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus`` (null for a null value)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)
