"""Line dedup: maximal repeated runs of lines, of which all copies but the first are deleted.

A document is a sequence of line ids, numbers that rise with the order of the lines' hashes.
Suffixes of these sequences are sorted by distributed prefix doubling: at level j a suffix
has the rank of its first 2**j lines among all that occur more than once, and the pair of its
own rank and that of the suffix 2**j lines on is ranked for the level above. Pairs are counted
with pre-aggregation and sorted by range, so a line or run that a third of all rows share is
one small row from each task, and nothing is ranked in one place. A suffix leaves the array
where its prefix occurs only there (no repeat can reach further), and it need be sorted no
deeper than the runs that are asked for.

A run counts if it has ``min_words`` words or more. The suffixes that share a prefix that
deep are a common-prefix interval of the array. Two ranks name it: those of the first and the
last 2**j lines of the prefix, which overlap. The first suffix of an interval in the order of
documents is the first copy; the prefixes of all others go. Prefixes are the shortest ones
with ``min_words`` from a line on; a run's last lines, from which fewer words follow, are
reached by the shortest stretches that end at them. What overlaps or touches is merged to
the maximal run.

DataFrame functions throughout.

Defined cases: lines end at line feeds. A null text stays null. Earlier means a smaller
(doc_id, hash of the text, line number), null ids first; rows that agree in doc_id (or lack
one) and in text are one document, all treated alike, and rows that share a doc_id only are
different documents. A text whose lines all go becomes empty. Extra columns pass through,
whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.llm.common import as_rows, join_classes, ranked, text_key, written

_DOC = ("doc_id", "key")


def line_ids(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, pos, words, copies, rank)`` of the lines of ``docs(doc_id, text)`` that occur more than once."""
    split = docs.where("text is not null").select("doc_id", text_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.regexp_count("line", F.lit(r"[^ \t\r]+")).cast("long")
    lines = written(split.select(*_DOC, "pos", words.alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b")), "lines")
    repeated = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return join_classes(lines, ranked(repeated, ("a", "b"), "line-ids"), ("a", "b")).drop("a", "b")


def repeatable(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines in unbroken stretches of repeated lines that have ``min_words``, with what runs could hold them.

    ``before`` and ``past`` are the stretch's words before the line and through it. ``n`` lines
    from the line on, and ``m`` lines up to it, are the fewest with ``min_words`` (null: none).
    """
    own = lines.repartition(*_DOC).groupBy(*_DOC, "pos").agg(F.first("words").alias("words"), F.first("rank").alias("rank"))
    placed = own.withColumn("part", F.col("pos") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("pos")))
    part = Window.partitionBy(*_DOC, "part")
    past = F.sum("words").over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("past", past).withColumn("before", F.col("past") - F.col("words"))
    placed = placed.withColumn("whole", F.max("past").over(part)).where(F.col("whole") >= min_words)
    # The last line before which fewer words come than are asked for, and its mirror image.
    last = F.max(F.struct("pos", "past")).over(part.orderBy("before").rangeBetween(0, min_words - 1))
    first = F.min(F.struct("pos", "before")).over(part.orderBy("past").rangeBetween(1 - min_words, 0))
    placed = placed.withColumn("last", last).withColumn("first", first)
    n = F.when(F.col("last.past") - F.col("before") >= min_words, F.col("last.pos") - F.col("pos") + 1)
    m = F.when(F.col("past") - F.col("first.before") >= min_words, F.col("pos") - F.col("first.pos") + 1)
    return written(placed.select(*_DOC, "pos", "before", "past", "rank", n.alias("n"), m.alias("m")), "repeatable-lines")


def suffix_levels(lines: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, key, level, pos, rank)``: the ranks of suffixes by their first ``2**level`` lines.

    A suffix whose prefix is unique has no rank. One whose prefix, its first line apart, has
    ``min_words`` is sorted no deeper.
    """
    at, levels, level = lines.select(*_DOC, "pos", "before", "past", "rank"), [], 0
    while True:
        levels.append(at.select(*_DOC, F.lit(level).alias("level"), "pos", "rank"))
        width = 1 << level
        there = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(width, width)
        pairs = at.withColumn("next", F.max("rank").over(there)).withColumn("_reached", F.max("before").over(there))
        pairs = pairs.where(F.col("next").isNotNull() & (F.col("_reached") - F.col("past") < min_words)).drop("_reached")
        pairs = written(pairs.withColumnRenamed("rank", "own"), "suffix-pairs")
        classes = pairs.groupBy("own", "next").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        classes = ranked(classes, ("own", "next"), "suffix-ranks")
        if classes.isEmpty():
            break
        at, level = written(join_classes(pairs, classes, ("own", "next")).select(*at.columns), "suffixes"), level + 1
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out


def repeated_runs(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``(doc_id, key, first, past)``: maximal runs of lines (from ``first`` to before ``past``) that occur earlier."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = repeatable(line_ids(docs), min_words)
    levels = suffix_levels(lines, min_words)
    ahead = lines.where("n is not null").select(*_DOC, F.col("pos").alias("start"), "n")
    behind = lines.where("m is not null").select(*_DOC, (F.col("pos") - F.col("m") + 1).alias("start"), F.col("m").alias("n"))
    stretches = ahead.unionByName(behind).distinct().withColumn("level", F.length(F.bin("n")) - 1)
    half = F.col("start") + F.col("n") - F.call_function("shiftleft", F.lit(1), F.col("level"))
    stretches = stretches.withColumn("half", half)
    levels = levels.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("level").alias("l"), F.col("pos").alias("p"), "rank")
    for place, name in (("start", "head"), ("half", "tail")):
        there = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("level") == F.col("l")) & (F.col(place) == F.col("p"))
        stretches = stretches.join(levels, there).drop("d", "k", "l", "p").withColumnRenamed("rank", name)
    held = written(stretches.select(*_DOC, "start", "n", "head", "tail"), "intervals")
    suffix = F.struct(*_DOC, "start")
    classes = held.groupBy("n", "head", "tail").agg(F.count(F.lit(1)).alias("copies"), F.min(suffix).alias("earliest")).where("copies > 1")
    later = join_classes(held, written(classes, "interval-classes"), ("n", "head", "tail")).where(~suffix.eqNullSafe(F.col("earliest")))
    gone = later.select(*_DOC, F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("past"))
    order = Window.partitionBy(*_DOC).orderBy("first", "past")
    reached = F.max("past").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("new", F.when(F.col("first") <= reached, 0).otherwise(1))
    gone = gone.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return gone.groupBy(*_DOC, "run").agg(F.min("first").alias("first"), F.max("past").alias("past")).drop("run")


def dedup_lines(docs: DataFrame, min_words: int = 20, runs: str | None = None) -> DataFrame:
    """``docs`` with ``text`` less its repeated runs; ``runs`` names a column for the runs that went.

    ``n_chars``, where there is one, follows the text.
    """
    found = repeated_runs(docs, min_words).groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("first", "past"))).alias("runs"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"), "runs")
    rows = as_rows(docs).withColumn("key", text_key(F.col("text")))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    joined = joined.withColumn("lines", F.when(F.col("runs").isNotNull(), F.split("text", "\n", -1)))
    kept = """array_join(flatten(transform(sequence(0, size(runs)), i -> slice(lines,
        if(i = 0, 0, get(runs, i - 1).past) + 1,
        if(i = size(runs), size(lines), get(runs, i).first) - if(i = 0, 0, get(runs, i - 1).past)))), '\n')"""
    joined = joined.withColumn("left", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.expr(kept)))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length("left")).cast(kind)
    columns = [changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]
    return joined.select(*columns, *([F.col("runs").alias(runs)] if runs else []))
