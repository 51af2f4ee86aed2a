"""Budgeted text digests of the graph and of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.functions.text import cap_chars, package_dir
from symgraph.operators.graph import is_local_package, top_fan_in
from symgraph.schemas import SYMBOL_KINDS

SUMMARY_CHARS, STRUCTURE_CHARS = 4_000, 32_000


# The counts "(n symbols)" and "(n callers)" are fixed formats.


def ordered_lines(df: DataFrame, line: Column, *order: str) -> DataFrame:
    """One row with the lines joined in order; empty without rows."""
    keyed = df.select(F.struct(*order, line.alias("_line")).alias("_x"))
    listed = F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_line"])
    return keyed.agg(F.array_join(listed, "\n").alias("text"))


def one_liners(symbols: DataFrame, group: str, most: int = 2) -> DataFrame:
    """``(group, about)``: the first summaries of each group, ``name: summary`` joined by ``; ``."""
    order = Window.partitionBy(group).orderBy("file", "line", "id")
    told = symbols.where(F.coalesce("summary", F.lit("")) != "").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(": ", "name", "summary").alias("t"))))
    return told.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("about"))


def package_lines(nodes: DataFrame) -> DataFrame:
    """``(package, symbols, about, line)`` of every local package, those without symbols too."""
    symbols = nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).withColumn("package", package_dir(F.col("file")))
    packages = nodes.where((F.col("kind") == "package") & is_local_package(F.col("id"))).select(F.col("name").alias("package"))
    counted = symbols.groupBy("package").agg(F.count(F.lit(1)).alias("symbols"))
    out = packages.join(counted, "package", "left").join(one_liners(symbols, "package"), "package", "left")
    n, about = F.coalesce("symbols", F.lit(0)), F.coalesce("about", F.lit(""))
    line = F.concat(F.format_string("- %s (%d symbols)", "package", n), F.when(about != "", F.concat(F.lit(" — "), about)).otherwise(""))
    return out.select("package", n.alias("symbols"), about.alias("about"), line.alias("line"))


def summary(nodes: DataFrame, edges: DataFrame, title: str = "# The code at a glance") -> DataFrame:
    """One row: packages, entry points and the most called symbols, cut to 4000 code points."""
    packages = ordered_lines(package_lines(nodes), F.col("line"), "package").select(F.col("text").alias("packages"))
    entry = nodes.where((F.col("kind") == "func") & (F.lower("name") == "main"))
    entries = ordered_lines(entry, F.format_string("- %s:%d %s", "file", "line", "name"), "file", "line").select(F.col("text").alias("entries"))
    top = top_fan_in(edges, nodes, 10).withColumn("n", F.row_number().over(Window.orderBy(F.desc("callers"), "name", "id")))  # ten rows
    called = ordered_lines(top, F.format_string("%d. %s (%d callers) — %s:%d", "n", "name", "callers", "file", "line"), "n").select(F.col("text").alias("called"))
    parts = packages.crossJoin(entries).crossJoin(called)  # single rows
    section = lambda head, c: F.when(F.col(c) != "", F.concat(F.lit(f"\n{head}\n"), F.col(c), F.lit("\n"))).otherwise("")
    none = F.when(F.col("packages") == "", "nothing yet\n").otherwise(F.concat("packages", F.lit("\n")))
    text = F.concat(F.lit(f"{title}\n\n## Folders\n"), none, section("## Starts at", "entries"), section("## Called most", "called"))
    return parts.select(cap_chars(text, SUMMARY_CHARS).alias("digest"))


def structure_lines(nodes: DataFrame) -> DataFrame:
    """``(package, file, line)``: a line for each local package and each of its files."""
    symbols = nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).groupBy("file").agg(F.count(F.lit(1)).alias("symbols"))
    packages = nodes.where((F.col("kind") == "package") & is_local_package(F.col("id"))).select(F.col("name").alias("package"))
    heads = packages.select("package", F.lit("").alias("file"), F.concat(F.when(F.col("package") == ".", "(root)").otherwise(F.col("package")), F.lit("/")).alias("line"))
    files = nodes.where("kind = 'file'").join(symbols, "file", "left").withColumn("package", package_dir(F.col("file"))).join(packages, "package", "left_semi")
    named = F.concat(F.lit("  "), "name", F.when(F.col("symbols") > 0, F.format_string(" (%d symbols)", "symbols")).otherwise(""))
    return heads.unionByName(files.select("package", "file", named.alias("line")))


def structure(nodes: DataFrame, title: str = "# Files by folder") -> DataFrame:
    """One row: packages and their files with symbol counts, cut to 32000 code points."""
    lines = ordered_lines(structure_lines(nodes), F.col("line"), "package", "file")
    body = F.when(F.col("text") == "", "nothing yet\n").otherwise(F.concat("text", F.lit("\n")))
    return lines.select(cap_chars(F.concat(F.lit(f"{title}\n\n"), body), STRUCTURE_CHARS).alias("digest"))


def session_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = summary(nodes, edges).crossJoin(structure(nodes).withColumnRenamed("digest", "structure"))  # single rows
    return both.select(F.concat_ws("\n\n", F.rtrim("digest", F.lit("\n")), "structure").alias("digest"))


def within_budget(sections: DataFrame, group: list[str], order: list[str], section: str, budget: int | Column, overhead: int | Column = 0) -> DataFrame:
    """The leading sections of each group whose bytes fit the budget; the first always stays."""
    by = Window.partitionBy(*group).orderBy(*order)
    total = F.sum(F.octet_length(section)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = sections.withColumn("_n", F.row_number().over(by)).withColumn("_bytes", total)
    budget, overhead = (F.lit(x) if isinstance(x, int) else x for x in (budget, overhead))
    return numbered.where((F.col("_n") == 1) | (F.col("_bytes") + overhead <= budget))


def result_section(number: Column, score: Column, symbol: Column, kind: Column, file: Column, layer: Column, purpose: Column, code: Column) -> Column:
    optional = lambda c, shape: F.when(F.coalesce(c, F.lit("")) != "", F.format_string(shape, c)).otherwise("")
    return F.concat(
        F.format_string("## %d. %s (%s) in %s, score %.2f\n", number, symbol, kind, file, score),
        optional(layer, "part of: %s\n"),
        optional(purpose, "%s\n"),
        optional(code, "```\n%s\n```\n"),
    )


def context_block(results: DataFrame, project: str, query: str, max_tokens: int = 4000, tag: str = "context") -> DataFrame:
    """One row: the leading results that fit ``max_tokens`` of four bytes, between tags.

    ``results(position, score, symbol, type, file, layer, purpose, code)``.
    """
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    header, footer = f"<{tag} project={quoted(project)} query={quoted(query)}>\n", f"</{tag}>"
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position"))  # a query's top results
    told = results.withColumn("_number", number)
    told = told.withColumn("_section", result_section(F.col("_number"), F.col("score"), F.col("symbol"), F.col("type"), F.col("file"), F.col("layer"), F.col("purpose"), F.col("code")))
    told = told.withColumn("_all", F.lit(0))
    fit = within_budget(told, ["_all"], ["_number"], "_section", max_tokens * 4, len(header.encode()) + len(footer))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_number", "_section"))), lambda x: x["_section"])
    return fit.agg(F.concat(F.lit(header), F.array_join(listed, ""), F.lit(footer)).alias("block"))
