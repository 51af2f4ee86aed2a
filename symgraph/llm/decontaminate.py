"""Benchmark decontamination: short test items found inside long documents.

Shingles are runs of five words (letters and digits, lower-cased); an item of fewer words is
one shingle of them all, which is looked for among the documents' runs of as many words. An
item leaks into a document that holds at least ``threshold`` of the item's distinct
shingles, however long the document is.

The search is containment MinHash: items are partitioned by size (powers of two of their
shingle counts), each partition has a sketch length for its largest size, and an item's
sketch is that many of its smallest shingle hashes. A document that holds 80 percent of an
item misses at most a fifth of its shingles, so it must hold at least (sketch - that fifth)
of the sketch: no leak can be missed, and documents of any length are tested against the
sketches as they are scanned, without a signature of their own. The documents that remain
are read again and compared shingle by shingle, as text.

Only the sketches are broadcast, behind a check of their size; beyond it the same join is
shuffled. DataFrame functions throughout.

Defined cases: null, empty and wordless texts hold nothing and, as items, are in nothing.
Rows that agree in id and text count once; rows that share an id only, or have none, are
told apart by their texts. Extra columns, whatever their names, pass through
``decontaminate`` and are ignored by ``find_leaks``. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import as_rows, text_key, written

#: Rows of a join's small side (some 40 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


_DOC, _ITEM = ("doc_id", "doc_key"), ("item_id", "item_key")


def _texts(source: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(id, key, text)``: rows by id and text."""
    text = F.col("text").cast("string")
    return source.select(F.col(names[0]).cast("long").alias(names[0]), text_key(text).alias(names[1]), text.alias("text"))


def _shingled(texts: DataFrame, names: Sequence[str], widths: Sequence[int], as_text: bool) -> DataFrame:
    """``(id, key, shingle)``, repeats included: every run of each width, as text or as a hash of its words."""

    def runs(width: int) -> Column:
        if as_text:
            make = lambda i: F.array_join(F.slice(F.col("_words"), i + 1, width), " ")
        else:
            make = lambda i: F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(width)))
        n, none = F.size("_words"), F.array().cast("array<string>" if as_text else "array<bigint>")
        return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), make)).otherwise(none)

    listed = texts.select(*names, words_of(F.col("text")).alias("_words"))
    return listed.select(*names, F.explode(F.concat(*map(runs, widths))).alias("shingle"))


def _of_items(items: DataFrame, words: int, widths: Sequence[int], as_text: bool) -> DataFrame:
    """Distinct shingles of the items, each of the one width that its item has."""
    sized = items.withColumn("_width", F.least(F.size(words_of(F.col("text"))), F.lit(words)))
    out = None
    for width in widths:
        own = _shingled(sized.where(F.col("_width") == width), _ITEM, [width], as_text)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """``(item, at_least, shingle)`` of the items' distinct hashed ``shingles``: the smallest of each, by size partition."""
    sized = shingles.groupBy(*_ITEM).agg(F.array_sort(F.collect_list("shingle")).alias("hashes"))
    n = F.size("hashes")
    largest = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n))) - 1  # of the partition: sizes with as many binary digits
    missing = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int")
    sketch = F.least(n, 2 * (largest - F.ceil(largest * F.lit(threshold) - 1e-9).cast("int")) + 1)
    out = sized.select(*_ITEM, (sketch - missing).alias("at_least"), F.slice("hashes", 1, sketch).alias("sketch"))
    return out.select(*_ITEM, "at_least", F.explode("sketch").alias("shingle"))


def _leaks(docs: DataFrame, items: DataFrame, words: int, threshold: float) -> DataFrame:
    """``(doc_id, doc_key, item_id, item_key, n_item, n_shared)`` of ``docs`` and ``items`` by id and text."""
    widths = items.select(F.least(F.size(words_of(F.col("text"))), F.lit(words)).alias("n")).where("n > 0").distinct().collect()
    widths = sorted(r["n"] for r in widths)  # at most ``words`` of them
    if not widths:
        return docs.crossJoin(items.select(*_ITEM)).select(*_DOC, *_ITEM, F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    hashed = _of_items(items, words, widths, as_text=False)
    sketches = written(item_sketches(hashed, threshold), "sketches")
    hits = _shingled(docs, _DOC, widths, as_text=False).join(_small(sketches, sketches.count()), "shingle")
    tallied = hits.groupBy(*_DOC, *_ITEM, "at_least", "shingle").agg(F.lit(1)).groupBy(*_DOC, *_ITEM, "at_least").count()
    candidates = written(tallied.where("count >= at_least").select(*_DOC, *_ITEM), "candidates")
    found = _small(candidates.select(*_DOC).distinct(), candidates.count())
    held = docs.alias("d").join(found.alias("f"), _same("d", "f", _DOC), "left_semi")
    wanted = written(_of_items(items.alias("d").join(candidates.select(*_ITEM).distinct().alias("f"), _same("d", "f", _ITEM), "left_semi"), words, widths, as_text=True), "item-shingles")
    sizes = wanted.groupBy(*_ITEM).agg(F.count(F.lit(1)).alias("n_item"))
    shared = _shingled(held, _DOC, widths, as_text=True).join(_small(wanted, wanted.count()), "shingle").distinct()
    shared = shared.groupBy(*_DOC, *_ITEM).agg(F.count(F.lit(1)).alias("n_shared"))
    out = shared.alias("d").join(sizes.alias("f"), _same("d", "f", _ITEM)).select("d.*", "f.n_item")
    return out.where(F.col("n_shared") / F.col("n_item") >= threshold - 1e-9)


def _same(one: str, other: str, names: Sequence[str]) -> Column:
    key, text = names
    return F.col(f"{one}.{key}").eqNullSafe(F.col(f"{other}.{key}")) & (F.col(f"{one}.{text}") == F.col(f"{other}.{text}"))


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` of every document and item it holds."""
    found = _leaks(_texts(docs, _DOC), _texts(items, _ITEM), words, threshold)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay."""
    leaked = written(_leaks(_texts(docs, _DOC), _texts(items, _ITEM), words, threshold).select(*_DOC).distinct(), "leaked")
    rows = as_rows(docs).withColumn("doc_key", text_key(F.col("text")))
    kept = rows.alias("d").join(_small(leaked, leaked.count()).alias("f"), _same("d", "f", _DOC), "left_anti")
    return kept.select(*(F.col("d.row").getField(c).alias(c) for c in docs.columns))
