"""Components of similar sets, by posting lists of some elements of each set.

A set is filed under its first ``n - ceil(t * n) + 1`` of ``n`` elements in an order common to
all sets, so two sets of a Jaccard similarity of ``t`` share one of them: they meet in a
posting list, and no pair is missed. Lists of one member, most of them where rare elements
come first, are dropped by a pre-aggregated count before any member is moved.

A list's members are first compared with two of them, the one of the smallest id and the one
of the smallest hash, which lists of the same members have in common: that joins dense
groups by few comparisons. Pairs that links known before join are not compared again. What is left are lists whose members are then still in different
components. The caller finds the links between those (``cross``), as forests, so that dense
groups are never expanded into their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import join_classes, written
from symgraph.llm.components import connected_components

#: Rows of a join's small side (some 40 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 500_000


def filed_elements(n: Column, threshold: float) -> Column:
    """How many of ``n`` elements a set is filed under."""
    return n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1


def near_sizes(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - 1e-9


def jaccard(one: Column, other: Column) -> Column:
    """Jaccard similarity of two arrays without repeats."""
    shared = F.size(F.array_intersect(one, other))
    return shared / (F.size(one) + F.size(other) - shared)


def jaccard_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose ``sets(set_id, elements)`` are alike."""
    for end in ("src", "dst"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(end), F.col("elements").alias(f"of_{end}")), end)
    return pairs.where(jaccard(F.col("of_src"), F.col("of_dst")) >= threshold - 1e-9).select("src", "dst")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` that are not in one of the ``classes(id, component)``."""
    for end in ("src", "dst"):
        pairs = pairs.join(classes.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return pairs.where(F.coalesce("of_src", "src") != F.coalesce("of_dst", "dst")).select("src", "dst")


def similar_sets(nodes: DataFrame, alike: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame], DataFrame], threshold: float, known: DataFrame) -> DataFrame:
    """Components ``(id, component)`` of the links that ``alike(pairs)`` confirms; unlinked sets are not listed.

    ``nodes(set_id, n, filed)`` has distinct sets with their sizes and the posting lists they
    are in; it should be a written table. ``known(src, dst)`` are confirmed links, written. ``cross(members(key, set_id, n, component))`` gives
    ``(src, dst)``, confirmed links that join all components with links in a list.
    """
    listed = nodes.select("set_id", "n", F.explode("filed").alias("key"))
    counted = listed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    index = written(join_classes(listed, written(counted, "posting-keys"), ["key"]).select("key", "set_id", "n"), "postings")
    member = F.struct("set_id", "n")
    chance = F.struct(F.xxhash64("set_id").alias("chance"), "set_id", "n")
    lists = index.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(member).alias("first"), F.min(chance).alias("other"))
    lists = lists.select("key", "copies", "first", F.struct("other.set_id", "other.n").alias("other"))
    stars = join_classes(index, written(lists, "posting-lists"), ["key"]).select("set_id", "n", F.explode(F.array("first", "other")).alias("with"))
    stars = stars.where((F.col("set_id") != F.col("with.set_id")) & near_sizes(F.col("n"), F.col("with.n"), threshold))
    stars = stars.select(F.least("set_id", "with.set_id").alias("src"), F.greatest("set_id", "with.set_id").alias("dst")).distinct()
    stars = written(_apart(stars, connected_components(known)), "star-pairs")
    found = written(alike(stars).unionByName(known), "star-links")
    joined = connected_components(found)
    placed = index.join(joined.withColumnRenamed("id", "set_id"), "set_id", "left")
    placed = written(placed.select("key", "set_id", "n", F.coalesce("component", "set_id").alias("component")), "placed-members")
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a <> z").select("key")
    open_ = written(placed.join(mixed, "key"), "open-members")
    more = written(cross(open_), "rest-links")
    return joined if more.isEmpty() else connected_components(written(found.unionByName(more), "links"))
