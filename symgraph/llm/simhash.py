"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has one bit for each bit position of the shingles' 64-bit hashes (and of
``lanes - 1`` remixes of them), set where more than half of the hashes have it. Its bytes,
each with its position, are what the index holds. Two fingerprints of 8 bytes that differ
in at most 3 bits share at least 5 positional bytes, so they share one of the 14 quadruples
of positions whose numbers XOR to zero: any three positions lie in exactly one of those, and
its complement is one too. Posting lists are therefore kept by quadruple, not by single
byte; in each list the shared positional bytes of a pair are tallied, pairs below the
guaranteed minimum go, and the rest are verified by their differing bits.

Fingerprints that many documents share are collapsed first. A long posting list is dealt out
as pairs of blocks; a task gets one pair of blocks, compares it in memory, and emits only a
spanning forest of the verified links, so links between dense groups are never expanded.

For the pipeline's looser likeness, ``wide_near_duplicates`` searches by the same index and
checks what it finds by the Jaccard similarity of the shingles. Pairs that differ in more
bits than the index guarantees are left to a completion: documents that are not linked yet
are also filed under some of their shingles, so that no pair can be missed, with wide
fingerprints as a sieve and the same check.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links
like any other. Repeated rows and ties share a component; rows without a doc_id link like
any other, and a component of them alone has none. Extra columns are ignored, or pass
through ``one_of_each``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import as_rows, join_classes, text_key, written
from symgraph.llm.components import connected_components
from symgraph.llm.set_join import BROADCAST_ROWS, jaccard_links, similar_sets
from symgraph.llm.xxh import majority_bits, remix, xxh64_slices

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 21  # bytes of text hashed together
_BLOCK = 2048  # members of a posting list that are compared with one another in a task
_ELEMENTS = 1 << 20  # shingles of a block whose sets are compared
_SMALL = 12  # posting lists up to this length are compared together

#: Quadruples of the eight byte positions whose numbers XOR to zero.
QUADRUPLES = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)


def fingerprints_of(texts: Sequence[bytes], words: int, lanes: int, seed: int = 42) -> np.ndarray:
    """Fingerprints, one row of ``lanes`` unsigned integers for each text."""
    return _signed(len(texts), *_shingle_hashes(texts, words, seed), lanes)


def _signed(rows: int, full: np.ndarray, held: np.ndarray, h: np.ndarray, lanes: int) -> np.ndarray:
    out = np.zeros((rows, lanes), dtype=np.uint64)
    for lane in range(lanes if len(full) else 0):
        out[full, lane] = majority_bits(remix(h, lane) if lane else h, held)
    return out


def _shingle_hashes(texts: Sequence[bytes], words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have words, how many shingles each has, and the shingles' hashes, one text after the other."""
    parts = [t.translate(_LOWER).split() for t in texts]
    n_words = np.fromiter(map(len, parts), np.int64, len(parts))
    full = np.flatnonzero(n_words)
    if not len(full):
        return full, full, np.zeros(0, np.uint64)
    flat = [w for p in parts for w in p]
    data = b" ".join(flat)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    n = n_words[full]
    base = np.cumsum(n) - n
    held = np.maximum(n - words + 1, 1)
    first = np.repeat(base - (np.cumsum(held) - held), held) + np.arange(held.sum())
    last = first + np.repeat(np.minimum(n, words) - 1, held)
    return full, held, xxh64_slices(data, begins[first], ends[last] - begins[first], seed)


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """``(doc_id, fp array<long>)`` of every document, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo, size = batch.column(1), 0, 0
            held: list[bytes] = []
            for i in range(len(texts)):
                held.append(texts[i].as_py() or b"")
                size += len(held[-1])
                if size >= _CHUNK or i == len(texts) - 1:
                    fp = fingerprints_of(held, words, lanes).view(np.int64)
                    offsets = pa.array(np.arange(0, fp.size + 1, lanes, dtype=np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(fp.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(held)), lists], names=["doc_id", "fp"])
                    lo, size, held = i + 1, 0, []

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp array<long>")


def fingerprint_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _posting_keys(fp: Column, sets: Sequence[Sequence[int]]) -> Column:
    """One number for each set of positions: which set it is, then the bytes it has there."""

    def octet(position: int) -> Column:
        return F.shiftrightunsigned(fp[position // 8], 8 * (position % 8)).bitwiseAND(F.lit(255).cast("long"))

    def key(number: int, positions: Sequence[int]) -> Column:
        value = F.lit(number).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(octet(p))
        return value

    return F.array(*(key(i, s) for i, s in enumerate(sets)))


def _linked(one: np.ndarray, many: np.ndarray, min_shared: int, max_bits: int) -> np.ndarray:
    """Whether each pair of fingerprints shares enough positional bytes and is then verified."""
    diff = one ^ many
    shared = (diff.view(np.uint8).reshape(len(diff), 8 * diff.shape[1]) == 0).sum(axis=1)
    near = shared >= min_shared
    near[near] = np.bitwise_count(diff[near]).sum(axis=1, dtype=np.int64) <= max_bits
    return near


def _forest(fp: np.ndarray, split: int, min_shared: int, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fp``, or between its first ``split`` rows and the rest."""
    edges: list[tuple[int, int]] = []
    fresh = np.arange(len(fp))
    while len(fresh):
        queue, fresh = [int(fresh[0])], fresh[1:]
        while queue and len(fresh):
            at = queue.pop()
            open_ = fresh if not split else fresh[(fresh >= split) == (at < split)]
            hit = open_[_linked(fp[at], fp[open_], min_shared, max_bits)]
            if len(hit):
                edges += [(at, int(x)) for x in hit]
                queue += hit.tolist()
                fresh = np.setdiff1d(fresh, hit, assume_unique=True)
    return edges


def links(nodes: DataFrame, sets: Sequence[Sequence[int]], min_shared: int, max_bits: int) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all verified pairs.

    ``nodes(id, fp)`` has distinct fingerprints. Posting lists of one member are dropped by
    a pre-aggregated count before any fingerprint is moved.
    """
    index = written(nodes.select("id", F.explode(_posting_keys(F.col("fp"), sets)).alias("key")), "postings")
    lists = index.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / _BLOCK).cast("int").alias("blocks"))
    lists = written(lists, "posting-lists")  # so that the join can split a hot key's rows
    members = index.join(lists, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each block meets every other one and itself: (lower, upper) names the task's share.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.select("key", "id", "block", other.alias("_other")).select(
        "key", "id", F.least("block", "_other").alias("lower"), F.greatest("block", "_other").alias("upper"), "block"
    )
    dealt = dealt.join(nodes, "id").repartition("key", "lower", "upper").sortWithinPartitions("key", "lower", "upper", "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def edges_of(table: pa.Table) -> pa.RecordBatch:
            cols = {c: table.column(c).to_numpy() for c in ("key", "lower", "upper", "block", "id")}
            flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("fp").chunks])
            fp = flat.view(np.uint64).reshape(table.num_rows, -1)
            key, lower, upper, block, ids = (cols[c] for c in ("key", "lower", "upper", "block", "id"))
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lower[1:] != lower[:-1]) | (upper[1:] != upper[:-1])])
            sizes = np.diff(np.r_[new, len(key)])
            group = np.repeat(np.arange(len(new)), sizes)
            src, dst = [], []
            small = sizes <= _SMALL
            for lag in range(1, _SMALL):
                a = np.flatnonzero((group[:-lag] == group[lag:]) & small[group[:-lag]])
                a = a[_linked(fp[a], fp[a + lag], min_shared, max_bits)] if len(a) else a
                src.append(ids[a])
                dst.append(ids[a + lag])
            for g in np.flatnonzero(~small).tolist():
                lo, hi = int(new[g]), int(new[g] + sizes[g])
                split = 0 if lower[lo] == upper[lo] else int((block[lo:hi] == lower[lo]).sum())
                found = np.array(_forest(fp[lo:hi], split, min_shared, max_bits), dtype=np.int64).reshape(-1, 2)
                src.append(ids[lo:hi][found[:, 0]])
                dst.append(ids[lo:hi][found[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            key, lower, upper = (table.column(c).to_numpy() for c in ("key", "lower", "upper"))
            whole = int(np.flatnonzero((key != key[-1]) | (lower != lower[-1]) | (upper != upper[-1]))[-1]) + 1 if len(key) and (key[0], lower[0], upper[0]) != (key[-1], lower[-1], upper[-1]) else 0
            if whole:
                yield edges_of(table.slice(0, whole))
            carry = table.slice(whole)
        if carry is not None and carry.num_rows:
            yield edges_of(carry)

    return dealt.select("key", "lower", "upper", "block", "id", "fp").mapInArrow(run, "src long, dst long")


def fingerprint_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(src, dst)`` of all pairs of distinct 64-bit fingerprints ``nodes(id, fp)`` that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("an index of quadruples finds all pairs of at most 3 differing bits")
    return links(nodes, QUADRUPLES, 8 - max_bits, max_bits)


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every document under 64-bit fingerprints.

    Exact for ``max_bits`` up to 3: every pair within that distance is linked, directly or
    through others.
    """
    found = written(fingerprints(docs, words, 1).withColumn("id", F.col("fp")[0]), "fingerprints")
    nodes = found.groupBy("id", "fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "distinct-fingerprints")
    classes = connected_components(fingerprint_links(nodes.select("id", "fp"), max_bits))
    placed = nodes.join(classes, "id", "left").select("id", "doc", "copies", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "placed-fingerprints")
    named = placed.join(placed.groupBy("component").agg(F.min("doc").alias("component_id")), "component")
    return join_classes(found, written(named.select("id", "copies", "component_id"), "components"), ["id"]).select("doc_id", "fp", "component_id")


def _frequent(docs: DataFrame, words: int, sample: int = 20_000, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of ``docs``, sorted, and how often: only the order of filing follows from it."""
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    listed = shingle_sets(some.select(F.lit(0).cast("long").alias("set_id"), "text"), words).select(F.explode("elements").alias("shingle"))
    rows = listed.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(most).collect()
    rows.sort(key=lambda r: r["shingle"])
    return np.array([r["shingle"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)


def _sets_of(texts: list[bytes], words: int, lanes: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles (64-bit hashes) of each text, and the fingerprints."""
    full, held, h = _shingle_hashes(texts, words, 42)
    sets = [np.zeros(0, np.int64)] * len(texts)
    starts = np.cumsum(held) - held
    for row, start, size in zip(full.tolist(), starts.tolist(), held.tolist(), strict=True):
        sets[row] = np.unique(h[start : start + size].view(np.int64))
    return sets, _signed(len(texts), full, held, h, lanes).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _in_chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with some megabytes of text each, and their texts."""
    for batch in batches:
        lo = size = 0
        held: list[bytes] = []
        for i in range(batch.num_rows):
            held.append(batch.column(text)[i].as_py() or b"")
            size += len(held[-1])
            if size >= _CHUNK or i == batch.num_rows - 1:
                yield batch.slice(lo, len(held)), held
                lo, size, held = i + 1, 0, []


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``(set_id, elements)`` of ``docs(set_id, text)``: the distinct shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _in_chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_sets_of(texts, words, 0)[0])], names=["set_id", "elements"])

    return docs.select("set_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "set_id long, elements array<long>")


def _filed(rows: DataFrame, words: int, lanes: int, threshold: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of ``rows(doc_id, key, text)``: a hash of the set of shingles, its size, the fingerprint, and the shingles it is filed under.

    These come first in an order common to all documents, rare ones first.
    """
    names = ["doc_id", "key", "set_id", "n", "fp", "filed"]

    def filed(own: np.ndarray) -> np.ndarray:
        order = np.arange(len(own))
        if len(frequent[0]):
            at = np.minimum(np.searchsorted(frequent[0], own), len(frequent[0]) - 1)
            order = np.argsort(np.where(frequent[0][at] == own, frequent[1][at], 0), kind="stable")
        return own[order[: len(own) - math.ceil(threshold * len(own) - 1e-9) + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _in_chunks(batches, 2):
            sets, fp = _sets_of(texts, words, lanes)
            named = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(named), pa.array(sizes), _lists(list(fp)), _lists([filed(x) for x in sets])], names=names)

    source = rows.select("doc_id", "key", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, key long, set_id long, n int, fp array<long>, filed array<long>")


def indexed_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``(src, dst)``: sets of ``nodes(set_id, fp)`` that the index of their first 64 bits links, by the first set of each fingerprint."""
    held = nodes.select("set_id", F.col("fp")[0].alias("id"))
    prints = written(held.groupBy("id").agg(F.min("set_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    near = fingerprint_links(prints.select("id", F.array("id").alias("fp")), max_bits).distinct()
    for end in ("src", "dst"):
        near = near.join(prints.select(F.col("id").alias(end), F.col("first").alias(f"first_{end}")), end)
    same = join_classes(held, written(prints.where("copies > 1"), "shared-fingerprints"), ["id"]).where("set_id <> first")
    near = near.select(F.least("first_src", "first_dst").alias("src"), F.greatest("first_src", "first_dst").alias("dst"))
    return near.unionByName(same.select(F.col("first").alias("src"), F.col("set_id").alias("dst")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _same_row(one: str, other: str) -> Column:
    """Rows that agree in id and text, nulls included."""
    return F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & F.col(f"{one}.key").eqNullSafe(F.col(f"{other}.key"))


def _crossing(size: np.ndarray, part: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, most: int) -> np.ndarray:
    """Whether pairs of rows are of different components, of near sizes, and differ in at most so many bits."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    near = (part[a] != part[b]) & (small >= threshold * large - 1e-9)
    near[near] = np.bitwise_count(fp[a[near]] ^ fp[b[near]]).sum(axis=1, dtype=np.int64) <= most
    return near


_CELL = ["key", "lower", "upper", "block", "set_id", "n", "component"]


def _dealt(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``members(key, set_id, n, component)`` with fingerprints, each list as pairs of blocks of bounded size."""
    size = F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK), F.ceil(F.sum("n") / _ELEMENTS))
    blocks = members.groupBy("key").agg(size.cast("int").alias("blocks"))
    placed = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lower"), F.greatest("block", "other").alias("upper"), "block", "set_id", "n", "component")
    return dealt.join(nodes.select("set_id", "fp"), "set_id")


def _in_cells(dealt: DataFrame, columns: list[str], links_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(src, dst)`` that ``links_of`` gives for runs of whole cells: the members of a pair of blocks."""
    rows = dealt.repartition("key", "lower", "upper").sortWithinPartitions("key", "lower", "upper", "block", "set_id")

    def batch_of(table: pa.Table) -> pa.RecordBatch:
        src, dst = links_of(table)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            key, lower, upper = (table.column(c).to_numpy() for c in _CELL[:3])
            other = np.flatnonzero((key != key[-1]) | (lower != lower[-1]) | (upper != upper[-1])) if len(key) else np.zeros(0, int)
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield batch_of(table.slice(0, whole))
            carry = table.slice(whole)
        if carry is not None and carry.num_rows:
            yield batch_of(carry)

    return rows.select(*_CELL, *columns).mapInArrow(run, "src long, dst long")


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(column).chunks])


def _cells_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where cells begin, and how many rows they have."""
    key, lower, upper = (table.column(c).to_numpy() for c in _CELL[:3])
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lower[1:] != lower[:-1]) | (upper[1:] != upper[:-1])])
    return new, np.diff(np.r_[new, len(key)])


def _spanning(part: np.ndarray, block: np.ndarray, split: bool, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Fewest links by which ``near`` pairs of a cell join its parts; pairs that are joined already are not looked at."""
    root, found = part.copy(), []
    for at in range(len(root) - 1):
        others = np.arange(at + 1, len(root))
        # Of two blocks, members meet those of the other one.
        others = others[(root[others] != root[at]) & ((block[others] != block[at]) if split else True)]
        hit = others[near(at, others)] if len(others) else others
        if len(hit):
            joined, pick = np.unique(root[hit], return_index=True)
            found += [(at, int(x)) for x in hit[pick]]
            root[np.isin(root, joined)] = root[at]
    return found


def possible_links(members: DataFrame, nodes: DataFrame, threshold: float, most: int) -> DataFrame:
    """``(src, dst)``: components of ``members(key, set_id, n, component)`` that share a key and could be alike, as forests.

    Components are joined where two of their sets pass the sieve of sizes and fingerprints.
    What leaves a task grows with the members of a list, not with their pairs.
    """

    def links_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lower, upper, block, _, size, part = (table.column(c).to_numpy() for c in _CELL[1:])
        fp = _flat(table, "fp").view(np.uint64).reshape(table.num_rows, -1)
        new, sizes = _cells_of(table)
        group = np.repeat(np.arange(len(new)), sizes)
        src, dst = [], []
        for lag in range(1, _SMALL):
            a = np.flatnonzero((group[:-lag] == group[lag:]) & (sizes <= _SMALL)[group[:-lag]])
            a = a[_crossing(size, part, fp, a, a + lag, threshold, most)]
            src.append(part[a])
            dst.append(part[a + lag])
        for g in np.flatnonzero(sizes > _SMALL).tolist():
            lo, hi = int(new[g]), int(new[g] + sizes[g])
            near = lambda at, others, lo=lo: _crossing(size, part, fp, np.full(len(others), lo + at), lo + others, threshold, most)
            found = np.array(_spanning(part[lo:hi], block[lo:hi], lower[lo] != upper[lo], near), dtype=np.int64).reshape(-1, 2)
            src.append(part[lo + found[:, 0]])
            dst.append(part[lo + found[:, 1]])
        return np.concatenate(src), np.concatenate(dst)

    return _in_cells(_dealt(members, nodes), ["fp"], links_of)


def verified_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """``(src, dst)``: sets of ``members(key, set_id, n, component)`` by whose Jaccard similarity components of a key are joined."""

    def links_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lower, upper, block, ids, size, part = (table.column(c).to_numpy() for c in _CELL[1:])
        fp = _flat(table, "fp").view(np.uint64).reshape(table.num_rows, -1)
        elements = _flat(table, "elements")
        ends = np.cumsum(size.astype(np.int64))
        begins = ends - size
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, held in zip(*(x.tolist() for x in _cells_of(table)), strict=True):

            def near(at: int, others: np.ndarray, lo: int = lo) -> np.ndarray:
                could = _crossing(size, part, fp, np.full(len(others), lo + at), lo + others, threshold, most)
                rows = lo + others[could]
                if len(rows):
                    own = elements[begins[lo + at] : ends[lo + at]]
                    starts = np.cumsum(size[rows], dtype=np.int64) - size[rows]
                    theirs = elements[np.repeat(begins[rows] - starts, size[rows]) + np.arange(size[rows].sum())]
                    shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, starts, dtype=np.int64)
                    could[could] = shared >= (threshold - 1e-9) * (len(own) + size[rows] - shared)
                return could

            found = np.array(_spanning(part[lo : lo + held], block[lo : lo + held], lower[lo] != upper[lo], near), dtype=np.int64).reshape(-1, 2)
            src.append(ids[lo + found[:, 0]])
            dst.append(ids[lo + found[:, 1]])
        return np.concatenate(src), np.concatenate(dst)

    return _in_cells(_dealt(members, nodes).join(sets, "set_id"), ["fp", "elements"], links_of)


def wide_near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 8, threshold: float = 0.8, max_differing: float = 0.3, max_bits: int = 3) -> DataFrame:
    """``(doc_id, key, component)``: rows linked by a Jaccard similarity of ``threshold`` of their shingles.

    Every such pair is found, and no other links. Pairs whose first 64 bits differ in at most
    ``max_bits`` come from the index of fingerprints, the others from that of shingles, where
    fingerprints of ``64 * lanes`` bits spare most comparisons: at s = 0.8 a share acos(2s / (1 + s)) / pi = 0.15 of the bits differs
    (at most 0.19, for sets of 4 and 5), and ``max_differing`` is over six standard
    deviations above that. Only the texts of pairs that pass are read again, to be compared.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    found = written(_filed(rows, words, lanes, threshold, _frequent(rows, words)), "filed-documents")
    nodes = written(found.dropDuplicates(["set_id"]), "distinct-sets")
    most = int(64 * lanes * max_differing)

    def sets_of(ids: DataFrame) -> DataFrame:
        """The shingles of the sets in ``ids(set_id)``, from their texts."""
        ends = written(nodes.join(ids, "set_id").select("set_id", "doc_id", "key"), "close-sets")
        texts = rows.alias("r").join(_small(ends, ends.count()).alias("e"), _same_row("r", "e")).select("e.set_id", "r.text")
        return written(shingle_sets(texts, words), "shingles").dropDuplicates(["set_id"])

    def alike(pairs: DataFrame) -> DataFrame:
        for end in ("src", "dst"):
            pairs = pairs.join(nodes.select(F.col("set_id").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        bits = F.aggregate(F.zip_with("fp_src", "fp_dst", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
        close = written(pairs.where(bits <= most).select("src", "dst"), "close-pairs")
        return jaccard_links(close, sets_of(close.select(F.explode(F.array("src", "dst")).alias("set_id")).distinct()), threshold)

    def cross(members: DataFrame) -> DataFrame:
        possible = written(possible_links(members, nodes, threshold, most).distinct(), "possible-links")
        families = connected_components(possible).select(F.col("id").alias("component"), F.col("component").alias("key"))
        meeting = members.select("set_id", "n", "component").distinct().join(families, "component")
        meeting = written(meeting.select("key", "set_id", "n", "component"), "families")
        return verified_links(meeting, nodes, sets_of(meeting.select("set_id")), threshold, most)

    known = written(alike(written(indexed_pairs(nodes, max_bits), "indexed-pairs")), "indexed-links")
    classes = similar_sets(nodes, alike, cross, threshold, known).withColumnRenamed("id", "set_id")
    return found.select("doc_id", "key", "set_id").join(classes, "set_id", "left").select("doc_id", "key", F.coalesce("component", "set_id").alias("component"))


def one_of_each(docs: DataFrame, **likeness: float) -> DataFrame:
    """``docs`` less all but the first row of each class of ``wide_near_duplicates``.

    The first is the one of the smallest doc_id (rows without one come last), then of the
    smallest hash of its text. Of rows that agree in both, one stays.
    """
    classes = written(wide_near_duplicates(docs, **likeness), "near-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    first = written(classes.groupBy("component").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "near-groups")
    gone = join_classes(classes, first, ["component"]).where(~rank.eqNullSafe(F.col("first"))).select("doc_id", "key").distinct()
    gone = written(gone, "near-copies")
    rows = as_rows(docs).withColumn("key", text_key(F.col("text"))).alias("r")
    kept = rows.join(_small(gone, gone.count()).alias("g"), _same_row("r", "g"), "left_anti")
    if not classes.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "key"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
