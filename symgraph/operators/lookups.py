"""Named lookups over the engine's tables: each a filter that reaches the scan, in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.schemas import SYMBOL_KINDS


def chunks_of_file(manifest: DataFrame, file: str) -> DataFrame:
    return manifest.where(F.col("file") == file)


def manifest_files(manifest: DataFrame) -> DataFrame:
    return manifest.select("file").distinct()


def node_by_id(nodes: DataFrame, identity: str) -> DataFrame:
    return nodes.where(F.col("id") == identity)


def nodes_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """By kind, then file."""
    return nodes.where(F.col("name") == name).orderBy("kind", "file", "id")


def nodes_in_file(nodes: DataFrame, file: str) -> DataFrame:
    return nodes.where(F.col("file") == file)


def symbol_nodes(nodes: DataFrame) -> DataFrame:
    """Functions, methods, types and constants by file, then line."""
    return nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).orderBy("file", "line", "id")


def file_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file'").orderBy("file")


def packages(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'package'").orderBy("name", "id")


def edges_from(edges: DataFrame, identity: str) -> DataFrame:
    return edges.where(F.col("src") == identity).orderBy("kind", "dst")


def edges_to(edges: DataFrame, identity: str) -> DataFrame:
    return edges.where(F.col("dst") == identity).orderBy("kind", "src")


def languages_seen(symbols: DataFrame, language: str = "language", order: str = "ord") -> DataFrame:
    """``(language, first)``: the languages of symbols in the order in which they first occur."""
    told = symbols.where(F.coalesce(language, F.lit("")) != "")
    return told.groupBy(language).agg(F.min(order).alias("first")).orderBy("first")


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def readme_source(symbols: DataFrame, budget: int = 200_000, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """``(ord..., section)``: the leading sections of code whose bytes fit the budget, as evidence for a README.

    A section names file, symbol and type and has the code; the first always stays. A section
    has five bytes at least, so only as many rows as could fit are ever brought together.
    """
    head = F.format_string("// %s — %s (%s)\n", "file", "symbol", "type")  # the form of the heading is a fixed value
    told = symbols.select(*order, F.concat(head, F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("section"))
    few = told.orderBy(*order).limit(max(budget // 10, 1))
    by = Window.partitionBy(F.lit(0)).orderBy(*order)
    size = F.sum(F.octet_length("section")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return few.withColumn("_n", F.row_number().over(by)).withColumn("_size", size).where((F.col("_n") == 1) | (F.col("_size") <= budget)).drop("_n", "_size")
