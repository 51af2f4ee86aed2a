"""Cost-balanced packing of tokenised documents into training sequences.

Each scan task tokenises its own rows, gathers about ``block_tokens`` tokens, and packs that
block: a piece of n tokens costs ``linear * n + quadratic * n**2`` (the attention inside a
piece), pieces are taken by descending length, and each goes to the lowest-cost sequence of
the block that has room. A document longer than a sequence is cut into whole sequences and
a rest. Where no sequence has room for a piece, the piece is cut to fill the lowest-cost
ones that have any. What a block leaves over after its whole sequences is carried to the
next block; the task's last tokens go to sequences whose lengths are powers of two, so
nothing is padded. There is no shuffle, and memory is bounded by the block and the longest
document.

Token ids are those of the ``tokenizers`` vocabulary file. Byte-pair merging by a text's
pre-tokens makes them independent of one another, so ids are looked up by space-separated
chunks in a bounded cache, and chunks not seen before are merged by the same vocabulary's
ranks; texts whose white space does not split that way are tokenised whole.

Defined cases: a null or empty text is a document of only the end id. Repeated rows are
packed as documents of their own. Extra columns are ignored. An empty table gives no rows.
Sequence ids are ``task << 40 | running number``; they follow the scan's partitions.
"""

from __future__ import annotations

import array
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Chunks whose ids a worker remembers (about 200 bytes each).
CACHED_CHUNKS = 150_000

#: The pre-token pattern of byte-level BPE vocabularies of this kind (a fixed value).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids of a chunk, a space and what follows it up to the next, as little-endian bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.odd = False

    def __missing__(self, chunk: str) -> bytes:
        # White space on both sides of a space joins it to its neighbours: not separable.
        if chunk == " " or chunk[1:2].isspace():
            self.odd = True
            return b""
        ids = array.array("I", self.encode(chunk)).tobytes()
        if len(self) < CACHED_CHUNKS:
            self[chunk] = ids
        return ids


class TokenIds:
    """Texts to the ids that ``tokenizers`` gives with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        to_byte = _byte_alphabet()
        ranks = {bytes(to_byte[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        self._special = list(special)
        self._chunks = _Chunks(self._bpe._core_bpe.encode_ordinary)

    def __call__(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian integers, one after the other."""
        if not any(s in text for s in self._special):
            chunks = self._chunks
            chunks.odd = False
            head, *rest = text.replace(" ", "\0 ").split("\0") if "\0" not in text else (text,)
            if rest or not head:
                # The head has no space before it; its ids are kept under a key of its own.
                ids = array.array("I", self._bpe.encode_ordinary(head)).tobytes() + b"".join(map(chunks.__getitem__, rest))
                if not chunks.odd:
                    return ids
        return array.array("I", self._bpe.encode(text, allowed_special="all")).tobytes()


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


class _Packer:
    """Packs pieces, given block by block, into sequences of ``capacity`` tokens."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first_id: int):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic
        self.next_id = first_id
        self.pieces: list[tuple[int, int, int]] = []  # document number, start, length

    def _cost(self, length: int) -> float:
        return self.linear * length + self.quadratic * length * length

    def add(self, number: int, length: int) -> None:
        start = 0
        while length - start > self.capacity:
            self.pieces.append((number, start, self.capacity))
            start += self.capacity
        self.pieces.append((number, start, length - start))

    def pack(self, sizes: list[int], pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Fill sequences of ``sizes``, whose sum is that of the pieces, to the last token.

        Gives document number, start, length, sequence id and offset.
        """
        room = np.array(sizes, dtype=np.int64)
        spent = np.zeros(len(sizes))
        out: list[tuple[int, int, int, int, int]] = []
        for number, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
            while length:
                fits = np.where(room >= length, spent, np.inf)
                at = int(fits.argmin())
                if fits[at] == np.inf:
                    at = int(np.where(room > 0, spent, np.inf).argmin())
                put = min(length, int(room[at]))
                out.append((number, start, put, self.next_id + at, sizes[at] - int(room[at])))
                room[at] -= put
                spent[at] += self._cost(put)
                start, length = start + put, length - put
        self.next_id += len(sizes)
        return out

    def block(self) -> list[tuple[int, int, int, int, int]]:
        """Pack as many whole sequences as the gathered pieces fill; the shortest pieces stay."""
        whole = sum(p[2] for p in self.pieces) // self.capacity
        left = sum(p[2] for p in self.pieces) - whole * self.capacity
        pieces, kept = sorted(self.pieces, key=lambda p: (p[2], p[0], p[1])), []
        while left:
            number, start, length = pieces.pop(0)
            keep = min(length, left)
            kept.append((number, start + length - keep, keep))
            if keep < length:
                pieces.append((number, start, length - keep))
            left -= keep
        self.pieces = kept
        return self.pack([self.capacity] * whole, pieces)

    def rest(self) -> list[tuple[int, int, int, int, int]]:
        """The last tokens, in sequences as long as the powers of two that sum to them."""
        total = sum(p[2] for p in self.pieces)
        sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        pieces, self.pieces = self.pieces, []
        return self.pack(sizes, pieces)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    block_tokens: int = 2_000_000,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence.

    ``with_ids`` adds the ids themselves (``ids array<int>``), from which the sequences of a
    training set are made.
    """
    end = array.array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer_path)
        packer = _Packer(capacity, linear, quadratic, TaskContext.get().partitionId() << 40)
        ids: dict[int, tuple[int, bytes]] = {}
        held = count = 0

        def placed(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[3], r[4]))
            cut = [memoryview(ids[n][1])[4 * s : 4 * (s + k)] for n, s, k, _, _ in rows]
            columns = {
                "doc_id": [ids[n][0] for n, *_ in rows],
                "start": [r[1] for r in rows],
                "length": [r[2] for r in rows],
                "ids_crc32": [zlib.crc32(c) for c in cut],
                "doc_tokens": [len(ids[n][1]) // 4 for n, *_ in rows],
                "sequence_id": [r[3] for r in rows],
                "offset": [r[4] for r in rows],
            }
            data = {k: pa.array(v, pa.int64()) for k, v in columns.items()}
            if with_ids:
                data["ids"] = pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(data)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = encode(text.as_py() or "") + end
                ids[count] = (doc_id, coded)
                packer.add(count, len(coded) // 4)
                count += 1
                held += len(coded) // 4
                if held >= block_tokens:
                    yield placed(packer.block())
                    ids = {n: ids[n] for n, _, _ in packer.pieces}
                    held = sum(p[2] for p in packer.pieces)
        if packer.pieces:
            whole = packer.block()
            yield placed(whole + packer.rest())

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sequence_cost(pieces: DataFrame, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """Tokens, pieces and estimated cost of every sequence."""
    n = F.col("length").cast("double")
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(n * linear + n * n * quadratic).alias("cost")
    )


def padding(lengths: pd.Series, capacity: int = 2048) -> pd.Series:
    """Padding of sequences of these lengths: none at a power of two."""
    n = lengths.astype("int64")
    return (capacity - n).where((n & (n - 1)) != 0, 0)
