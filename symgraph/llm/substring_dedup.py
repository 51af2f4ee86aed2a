"""Suffix-array deduplication: bytes covered by strings of ``length`` bytes that start elsewhere too.

The suffix array is sparse. In every window of ``length`` bytes the leftmost smallest hash
(by its upper 32 bits) of its ``gram``-byte substrings is the window's anchor; equal windows have equal anchors at
equal offsets, wherever they lie. Windows of a document that follow one another and share an
anchor make a block, so a block's text starts at its first window and ends with its last.

1. A scan task cuts its documents into blocks: the anchor's hash, the block's hash, where.
2. Anchor hashes seen once (pre-aggregated counts) are dropped: none of their windows repeats.
3. Equal blocks under an anchor repeat as a whole; every window in them does.
4. Anchors with different blocks are what is left: edges of repeats, mostly. One text of
   each different block is dealt out by anchor; a task joins the blocks it gets to one text,
   builds its enhanced suffix array, and scans the common-prefix interval tree. A node of
   depth ``length`` or more whose occurrences follow different bytes is a maximal repeat,
   and all of its occurrences are covered.
5. An anchor with more than ``max_blocks`` different blocks is split: windows whose anchor
   lies at nearby offsets share a core of bytes, and the core's hash replaces the anchor.
   Where that is still too many, the ranges of offsets are narrowed, down to one offset,
   where the core is the window itself and equal hashes are equal windows.

Nothing is pairwise, no group is gathered whole, and no window is skipped. Blocks count as
equal if they agree in the 64-bit hashes of block and anchor; in the tree, as in step 5 down
to single windows, bytes are compared as such or by 64-bit hashes of the same strings.

Defined cases: a null text is empty. Strings never cross documents; positions are bytes of
UTF-8. Rows that repeat, doc_id included, are documents of their own and repeat each other.
Texts under ``length`` bytes keep everything. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import join_classes, written
from symgraph.llm.esa import EnhancedSuffixArray
from symgraph.llm.xxh import remix

_CHUNK = 1 << 21  # bytes of text scanned at once
_ESA_BYTES = 1 << 21  # bytes of block text in one suffix array
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Widths of the ranges of anchor offsets into which an anchor with too many blocks is split.
SPLITS = (32, 6, 1)


def gram_hashes(octets: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes from each position (the last ones run over the end), by doubling."""
    power = remix(octets.astype(np.uint64) + np.uint64(1), 1)  # of 1 byte, then 2, 4, ...
    width, total, covered = 1, None, 0
    n = len(octets)
    while width <= gram:
        if gram & width:
            if total is None:
                total = power.copy()
            else:
                # What is covered so far follows these ``width`` bytes.
                joined = power * np.uint64(pow(int(_BASE), covered, 1 << 64))
                joined[: n - width] += total[width:]
                total = joined
            covered += width
        if width * 2 <= gram:
            doubled = power * np.uint64(pow(int(_BASE), width, 1 << 64))
            doubled[: n - width] += power[width:]
            power = doubled
        width *= 2
    return remix(total, 2)


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of the ``size`` values from each position on (for whole windows only)."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cut_blocks(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each block: text number, first window, number of windows, anchor, anchor hash, block hash."""
    data = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.int64),) * 2
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    low = np.uint64((1 << 32) - 1)  # the anchor is the leftmost of the smallest upper halves, whatever else is in the batch
    best = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.repeat(ends - sizes, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = (best[first] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[new, len(anchor)])
    begin, view = first[new], memoryview(data)
    spans = zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)
    block = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(new)).view(np.int64)
    shift = (ends - sizes)[owner[new]]
    return owner[new], begin - shift, count, anchor[new] - shift, h[anchor[new]].view(np.int64), block


_BLOCKS = "doc_id long, text_key long, first int, windows int, anchor int, anchor_hash long, block_hash long"
_SPANS = "doc_id long, text_key long, from int, to int"


def _blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            held: list[bytes] = []
            lo = size = 0
            for i in range(len(texts)):
                held.append(texts[i].as_py())
                size += len(held[-1])
                if size >= _CHUNK or i == len(texts) - 1:
                    owner, first, count, anchor, anchor_hash, block = cut_blocks(held, length, gram)
                    rows = pa.array(owner + lo)
                    ints = [pa.array(x.astype(np.int32)) for x in (first, count, anchor)]
                    yield pa.RecordBatch.from_arrays([ids.take(rows), keys.take(rows), *ints, pa.array(anchor_hash), pa.array(block)], names=["doc_id", "text_key", "first", "windows", "anchor", "anchor_hash", "block_hash"])
                    held, size, lo = [], 0, i + 1

    return docs.mapInArrow(run, _BLOCKS)


_UNITS = "group long, doc_id long, text_key long, first int, windows int, anchor int, body binary, wanted boolean"


def _split(unit: dict, width: int, length: int) -> Iterator[dict]:
    """Parts of a unit by ranges of ``width`` anchor offsets, each under its core's hash."""
    first, anchor, body = unit["first"], unit["anchor"], unit["body"]
    last = first + unit["windows"] - 1
    for part in range((anchor - last) // width, (anchor - first) // width + 1):
        begin, end = max(first, anchor - (part + 1) * width + 1), min(last, anchor - part * width)
        # All windows of the range, of this unit or another, hold the bytes of the core.
        core = body[anchor - part * width - first : anchor - (part + 1) * width + 1 - first + length]
        yield unit | {
            "group": xxhash.xxh3_64_intdigest(core, part & 0xFFFF) - (1 << 63),
            "first": begin,
            "windows": end - begin + 1,
            "body": body[begin - first : end - first + length],
        }


def _units(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The texts of the blocks in ``wanted``, taken from their documents."""
    listed = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor_hash", "first", "windows", "anchor", "wanted")).alias("blocks"))
    joined = docs.join(listed, (docs["doc_id"].eqNullSafe(listed["doc_id"])) & (docs["text_key"] == listed["text_key"])).select(docs["doc_id"], docs["text_key"], "body", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for row in range(batch.num_rows):
                doc, key, body = (batch.column(c)[row].as_py() for c in range(3))
                for b in batch.column(3)[row].as_py():
                    first, windows = b["first"], b["windows"]
                    text = body[first : first + windows - 1 + length]
                    size += len(text)
                    rows.append({"group": b["anchor_hash"], "doc_id": doc, "text_key": key, "first": first, "windows": windows, "anchor": b["anchor"], "body": text, "wanted": b["wanted"]})
                    if size > _CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, _arrow_units())
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _arrow_units())

    return joined.mapInArrow(run, _UNITS)


def _arrow_units() -> pa.Schema:
    kinds = {"group": pa.int64(), "doc_id": pa.int64(), "text_key": pa.int64(), "first": pa.int32(), "windows": pa.int32(), "anchor": pa.int32(), "body": pa.binary(), "wanted": pa.bool_()}
    return pa.schema(list(kinds.items()))


def _split_units(units: DataFrame, width: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for unit in batch.to_pylist():
                rows += _split(unit, width, length)
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_pylist(rows, _arrow_units())
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _arrow_units())

    return units.mapInArrow(run, _UNITS)


def covered_spans(bodies: list[bytes], windows: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Body number, begin and end of what maximal repeats of ``length`` bytes or more cover, merged."""
    data = b"".join(bodies)
    octets = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(bodies)), sizes)
    starts = np.flatnonzero(np.arange(len(data)) - begins[owner] < windows[owner])
    before = np.r_[-1, octets[:-1].astype(np.int64)]
    before[begins] = -1  # what a body's first window follows is in another block
    array = EnhancedSuffixArray(octets, ends[owner], starts, length)
    reach = np.zeros(len(data), np.int64)
    for depth, places in array.maximal_repeats(length, before):
        reach[places] = np.maximum(reach[places], depth)
    at = np.flatnonzero(reach)
    past = np.maximum.accumulate(at + reach[at])
    new = np.flatnonzero(np.r_[True, (at[1:] > past[:-1]) | (owner[at[1:]] != owner[at[:-1]])]) if len(at) else at
    for lo, hi in zip(at[new].tolist(), past[np.r_[new[1:] - 1, len(at) - 1]].tolist() if len(at) else [], strict=True):
        o = int(owner[lo])
        yield o, lo - int(begins[o]), hi - int(begins[o])


def _found(units: DataFrame, length: int) -> DataFrame:
    """Spans of the wanted units that maximal repeats among units of a group cover."""
    dealt = units.repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def scan(rows: list[dict]) -> pa.RecordBatch:
            bodies = [r["body"] for r in rows]
            windows = np.array([r["windows"] for r in rows])
            spans = []
            for o, begin, end in covered_spans(bodies, windows, length):
                r = rows[o]
                if r["wanted"]:
                    spans.append((r["doc_id"], r["text_key"], r["first"] + begin, r["first"] + end))
            columns = list(zip(*spans, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "text_key", "from", "to"])

        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["group"] != group[0]["group"]:
                    if len(group) > 1:
                        held += group
                    group = []
                    if size >= _ESA_BYTES:
                        yield scan(held)
                        held, size = [], 0
                group.append(row)
                size += len(row["body"])
        if len(group) > 1:
            held += group
        if held:
            yield scan(held)

    return dealt.mapInArrow(run, _SPANS)


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 50, max_blocks: int = 4000) -> DataFrame:
    """Byte spans ``(doc_id, text_key, from, to)`` of ``docs(doc_id, text_key, body)`` covered by repeats."""
    blocks = written(_blocks(docs, length, gram), "blocks")
    many = F.count(F.lit(1)).alias("copies")
    seen = written(blocks.groupBy("anchor_hash").agg(many).where("copies > 1"), "anchors")
    kept = written(join_classes(blocks, seen, ["anchor_hash"]).drop("copies"), "repeated-anchors")
    one = F.struct("doc_id", "text_key", "first", "windows", "anchor")
    classes = written(kept.groupBy("anchor_hash", "block_hash").agg(many, F.min(one).alias("one")), "block-classes")
    copied = join_classes(kept, classes.where("copies > 1").select("anchor_hash", "block_hash", "copies"), ["anchor_hash", "block_hash"])
    spans = copied.select("doc_id", "text_key", F.col("first").alias("from"), (F.col("first") + F.col("windows") + (length - 1)).alias("to"))
    mixed = written(classes.groupBy("anchor_hash").count().where("count > 1").select("anchor_hash"), "mixed-anchors")
    wanted = classes.join(mixed, "anchor_hash").select("anchor_hash", "one.*", (F.col("copies") == 1).alias("wanted"))
    units = written(_units(docs, wanted, length), "units")
    for width in (*SPLITS, 0):
        large = units.groupBy("group").count().where(F.col("count") > max_blocks).select("group")
        if width == 0 or large.isEmpty():
            break
        large = written(large, "large-groups")
        spans = spans.unionByName(_found(units.join(large, "group", "left_anti"), length))
        units = written(_split_units(units.join(large, "group", "left_semi"), width, length), "units")
    if width == 0:
        # One offset: the group's hash is the window's.
        again = units.groupBy("group").count().where("count > 1").select("group")
        left = units.where("wanted").join(again, "group").select("doc_id", "text_key", F.col("first").alias("from"), (F.col("first") + length).alias("to"))
        return spans.unionByName(left)
    return spans.unionByName(_found(units, length))


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 50, with_text: bool = False) -> DataFrame:
    """What is left of every document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    ``with_text`` adds ``kept binary``, the bytes that stay, and ``removed``, the spans that go.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    source = source.select("doc_id", F.xxhash64("body").alias("text_key"), "body")
    spans = repeated_spans(source, length, gram)
    listed = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    joined = source.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select("doc_id", "body", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, removed array<struct<from:int,to:int>>" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                body, spans = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or ()
                merged: list[list[int]] = []
                for lo, hi in sorted((s["from"], s["to"]) for s in spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                cuts = [0, *(x for m in merged for x in m), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if merged else body
                row = [batch.column(0)[i].as_py(), len(body), len(body) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()]
                rows.append(row + ([kept, [{"from": a, "to": b} for a, b in merged]] if with_text else []))
            kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))] if with_text else [])
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names[: len(kinds)])

    return joined.mapInArrow(run, schema)
