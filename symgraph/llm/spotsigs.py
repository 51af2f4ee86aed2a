"""SpotSigs document fingerprints: chains of content words that follow common words.

A text's anchors are the common words of several languages, and its first word. Each anchor
(the last of a row of them) starts a signature: the next three content words, common words
skipped. Where anchors are missing or far apart (a text with fewer than ``FEW_ANCHORS``, or
more than ``LONG_ROW`` content words without one), every content word that no anchor's
chain holds starts a signature too. In shorter rows the words after an anchor's chain stay
outside the fingerprint, as usual for such signatures. The set of a text's signatures is its
fingerprint; sets are likened by Jaccard similarity.

``near_pairs`` finds all pairs above a threshold: sets are partitioned by length, a set can
only be near sets of its own and the neighbouring partition, each set is filed under its
rarest signatures only (as many as a near set cannot all miss), and a pair whose lengths
alone rule it out is pruned before any sets are compared. Equal sets are collapsed first.

DataFrame functions throughout.

Defined cases: a null text is empty. A text without content words has one signature, of the
text itself. Equal texts have equal fingerprints. Repeated rows are documents of their own,
in order of doc_id, then text. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from symgraph.llm.common import written

#: Common words of English, French, German and Spanish.
COMMON_WORDS = tuple(
    dict.fromkeys(
        """a an and are as at be by for from has he in is it its of on or that the this to was were which will with
        au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas pour que qui sa
        se ses son sur un une auf aus bei das dem den der des die ein eine einem einen einer es hat ich im in ist
        mit nach nicht noch sich sie sind so und von war wie wird zu zum zur al como con del el ella ellos era esta
        este fue ha hay las lo los mas no para pero por sin sobre su sus una uno y""".split()
    )
)

#: A text with fewer anchors has signatures over all its content words.
FEW_ANCHORS = 4
#: Content words from an anchor to the next common word, beyond which the later ones start signatures.
LONG_ROW = 8

_MARK = "\u0001"


def signature_columns(df: DataFrame, chain: int = 3, **texts: str) -> DataFrame:
    """``df`` with a sorted set of signatures, hashes of its chains, for each ``name=text column``.

    The word list of a text is a projection of its own, so that it is made once.
    """
    for name, text in texts.items():
        spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        # Looked up one by one: as a pattern, a list of words is tried word by word at each place.
        shown = F.transform(F.split(spaced, " "), lambda w: F.when(w.isin(*COMMON_WORDS), _MARK).otherwise(w))
        joined = F.replace(F.array_join(shown, " "), F.lit(f"{_MARK} "), F.lit(_MARK))
        marked = F.concat(F.lit(_MARK), F.ltrim(joined))
        df = df.withColumn("_words", F.filter(F.split(marked, " "), lambda w: F.ltrim(w, F.lit(_MARK)) != ""))
        df = df.withColumn("_plain", F.transform("_words", lambda w: F.ltrim(w, F.lit(_MARK))))
        starts = F.filter(F.transform("_words", lambda w, i: F.when(w.startswith(_MARK), i)), lambda i: i.isNotNull())
        df = df.withColumn("_starts", starts)
        longest = F.when(F.size("_starts") < FEW_ANCHORS, chain).otherwise(LONG_ROW)
        ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts") - 1, F.lit(0))), F.array(F.size("_words")))
        rows = F.filter(F.zip_with("_starts", ends, lambda a, z: F.struct(a.alias("a"), z.alias("z"))), lambda r: r["z"] - r["a"] > longest)
        further = F.flatten(F.transform(rows, lambda r: F.sequence(r["a"] + chain, r["z"] - 1)))
        df = df.withColumn("_starts", F.concat("_starts", further))
        hashed = F.transform("_starts", lambda i: F.xxhash64(*(F.get(F.col("_plain"), i + k) for k in range(chain))))
        df = df.withColumn("_found", F.array_sort(F.array_distinct(hashed)))
        df = df.withColumn(name, F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.xxhash64(text))))
        df = df.drop("_words", "_plain", "_starts", "_found")
    return df


def fingerprint(signatures: Column) -> Column:
    """The set as a string: its signatures in order, 16 hexadecimal digits each. Its likeness to another can be told from both."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def signatures_of(fingerprint: Column) -> Column:
    """The signatures of a fingerprint, as strings."""
    return F.regexp_extract_all(fingerprint, F.lit("[0-9a-f]{16}"), F.lit(0))


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(one, other))
    return shared / (F.size(one) + F.size(other) - shared)


def with_next_text(docs: DataFrame, rows_per_range: int = 4000, most_ranges: int = 2048) -> DataFrame:
    """``(doc_id, text, next_text)``: each document with the text of the next, the last with the first's.

    Documents are dealt once, by ranges of doc_id that quantiles give; the first document of
    a range is also sent, as a tail, to the range before it. The driver sees one id a range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.count()
    ranges = min(most_ranges, -(-total // rows_per_range))
    cuts: list[int] = []
    if ranges > 1:
        at = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 10 * most_ranges)).first()[0]))
    range_of = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
    placed = docs.withColumn("_range", range_of)
    firsts = sorted((r["_range"], r["first"]) for r in placed.groupBy("_range").agg(F.min("doc_id").alias("first")).collect() if r["first"] is not None)
    if not firsts:
        return docs.withColumn("next_text", F.col("text"))
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    target = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    tails = docs.where(F.col("doc_id").isin(list(before))).withColumn("_range", target[F.col("doc_id")])
    both = placed.withColumn("_tail", F.lit(0)).unionByName(tails.withColumn("_tail", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_tail", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(order)).where("_tail = 0").select("doc_id", "text", "next_text")


def edited_half(docs: DataFrame) -> DataFrame:
    """``docs(text, next_text)`` with ``edited``: the second half replaced by the next text's beginning."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return docs.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and how near they and the next document's are."""
    sets = signature_columns(edited_half(with_next_text(docs)), own="text", changed="edited", following="next_text")
    return sets.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(pairs(a, b, similarity), members(doc_id, set_id))``: near pairs of distinct sets, and who has which.

    A set is named by its smallest doc_id.
    """
    own = signature_columns(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), own="text").drop("text")
    named = written(own.groupBy("own").agg(F.min("doc_id").alias("set_id")), "signature-sets")
    members = own.join(named, "own").select("doc_id", "set_id")
    listed = named.select("set_id", F.size("own").alias("n"), F.explode("own").alias("signature"))
    held = listed.groupBy("signature").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("sets", "signature"))
    # Of n signatures a near set misses fewer than n - ceil(threshold * n) + 1; those seen
    # once come first in the order and cannot be shared.
    alone = (F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("set_id"))).cast("int")
    filed = listed.join(held, "signature").withColumn("_rank", rank + alone)
    filed = filed.where(F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold))).cast("int")
    filed = written(filed.select("set_id", "n", "signature", part.alias("part")), "filed-signatures")
    left = filed.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), "signature", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = filed.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), "signature", "part")
    close = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    pairs = left.join(right, ["signature", "part"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    sides = [named.select(F.col("set_id").alias(c), F.col("own").alias(f"_{c}")) for c in ("a", "b")]
    scored = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", likeness(F.col("_a"), F.col("_b")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold - 1e-9), members
