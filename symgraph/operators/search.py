"""Vector top-k, branch precedence, exact lookups and their merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.functions.text import query_identifiers
from symgraph.schemas import SYMBOL_KINDS


def dot(one: Column, other: Column) -> Column:
    """Inner product in double precision, JVM-side."""
    pairs = F.zip_with(one, other, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(one: Column, other: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return F.try_divide(dot(one, other), F.sqrt(dot(one, one)) * F.sqrt(dot(other, other)))


def score_points(points: DataFrame, query: Sequence[float], embedding: str = "embedding") -> DataFrame:
    """``points`` with ``score``, the cosine to a query vector.

    The query's norm is folded into the literal, so a row costs one product and its own norm.
    """
    norm = sum(x * x for x in query) ** 0.5
    if not norm:
        return points.withColumn("score", F.lit(None).cast("double"))
    unit = F.array(*(F.lit(float(x / norm)) for x in query))
    own = F.sqrt(dot(F.col(embedding), F.col(embedding)))
    return points.withColumn("score", F.try_divide(dot(F.col(embedding), unit), own))


def search(
    points: DataFrame,
    query: Sequence[float],
    k: int,
    threshold: float = 0.0,
    filters: dict[str, object] | None = None,
    chain: Sequence[str] = (),
    ties: Sequence[str] = (),
    embedding: str = "embedding",
    fanout: int = 0,
) -> DataFrame:
    """The ``k`` points (all if not positive) of the highest cosine to ``query``.

    Equality ``filters`` and the branch ``chain`` apply before scoring, so they reach the
    scan; ``threshold`` applies if positive. ``fanout`` widens k for a later collapse.
    """
    for name, value in (filters or {}).items():
        points = points.where(F.col(name) == value)
    if chain:
        points = points.where(F.col("branch").isin(list(chain)))
    hits = score_points(points, query, embedding).where(F.col("score").isNotNull())
    if threshold > 0:
        hits = hits.where(F.col("score") >= threshold)
    return top(hits, over_fetch(k, len(chain)) if fanout else k, ties)


def over_fetch(k: int, branches: int) -> int:
    return k * 4 * max(1, branches) if k > 0 else k


def top(hits: DataFrame, k: int, ties: Sequence[str] = ()) -> DataFrame:
    ordered = hits.orderBy(F.desc("score"), *ties)
    return ordered.limit(k) if k > 0 else ordered


def branch_rank(branch: Column, chain: Sequence[object]) -> Column:
    """Position in the chain; its length for branches that are not in it."""
    out = F.lit(len(chain))
    for rank, name in reversed(list(enumerate(chain))):
        out = F.when(branch == name, rank).otherwise(out)
    return out


def collapse(hits: DataFrame, chain: Sequence[object], key: Sequence[str] = ("file_path", "symbol"), branch: str = "branch", ties: Sequence[str] = ()) -> DataFrame:
    """One hit for each key: of the nearest branch, then of the highest score."""
    order = Window.partitionBy(*key).orderBy(branch_rank(F.col(branch), chain), F.desc("score"), *ties)
    return hits.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def exact(nodes: DataFrame, query: str | Column, limit: int = 0) -> DataFrame:
    """Symbols whose names a query mentions, in order of mention, each with score 1."""
    spark = nodes.sparkSession
    text = F.lit(query) if isinstance(query, str) else query
    tokens = spark.range(1).select(F.posexplode(query_identifiers(text)).alias("position", "name"))
    found = nodes.where(F.col("kind").isin(*SYMBOL_KINDS)).join(F.broadcast(tokens), "name")  # one query's tokens
    found = found.withColumn("score", F.lit(1.0)).orderBy("position", "kind", "file", "id")
    return found.limit(limit) if limit > 0 else found


def exact_each(nodes: DataFrame, queries: DataFrame, key: str, text: str, limit: int = 0) -> DataFrame:
    """``exact`` for every row of ``queries(key, text)``: ``key, position`` and the columns of the symbols found.

    Tokens that name no symbol go with the join; ``limit`` counts for each query.
    """
    tokens = queries.select(key, F.posexplode(query_identifiers(F.col(text))).alias("position", "name"))
    found = tokens.join(nodes.where(F.col("kind").isin(*SYMBOL_KINDS)), "name").withColumn("score", F.lit(1.0))
    order = Window.partitionBy(key).orderBy("position", "kind", "file", "id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n") if limit > 0 else found


def merge(first: DataFrame, then: DataFrame, k: int, key: Sequence[str] = ("file", "symbol")) -> DataFrame:
    """Exact hits, then as many others as are left of ``k``, less those already there.

    ``first`` and ``then`` have the same columns with ``position``. Slots that the
    duplicates leave are not filled again.
    """
    own = first.count() if k > 0 else 0
    room = max(k - own, 0)
    ordered = then.orderBy("position")
    others = (ordered.limit(room) if k > 0 else ordered).join(first.select(*key).distinct(), list(key), "left_anti")
    parts = first.withColumn("source", F.lit(0)).unionByName(others.withColumn("source", F.lit(1)))
    return parts.orderBy("source", "position")
