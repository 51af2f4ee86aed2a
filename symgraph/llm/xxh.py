"""XXH64 of many slices of one buffer at once, and sign fingerprints of their hashes."""

from __future__ import annotations

import numpy as np
import xxhash

# The primes of XXH64 (fixed values of the published algorithm).
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_slices(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[s : s + n]`` for each start and length, as unsigned 64-bit integers.

    Slices under 32 bytes, which need no stripes, are hashed together; the others one by one.
    """
    padded = data + bytes(8)
    octets = np.frombuffer(padded, np.uint8)
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    h = lengths.astype(np.uint64) + (_P5 + np.uint64(seed))
    for lane in range(3):
        at = np.flatnonzero(lengths >= 8 * lane + 8)
        k = _rotl(eights[starts[at] + 8 * lane] * _P2, 31) * _P1
        h[at] = _rotl(h[at] ^ k, 27) * _P1 + _P4
    at = np.flatnonzero(lengths & 4)
    k = fours[starts[at] + (lengths[at] & ~7)].astype(np.uint64) * _P1
    h[at] = _rotl(h[at] ^ k, 23) * _P2 + _P3
    for tail in range(3):
        at = np.flatnonzero((lengths & 3) > tail)
        k = octets[starts[at] + (lengths[at] & ~3) + tail].astype(np.uint64) * _P5
        h[at] = _rotl(h[at] ^ k, 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    view = memoryview(data)
    for i in np.flatnonzero(lengths >= 32).tolist():
        s = int(starts[i])
        h[i] = xxhash.xxh64_intdigest(view[s : s + int(lengths[i])], seed)
    return h


def remix(h: np.ndarray, lane: int) -> np.ndarray:
    """Independent hashes from hashes: the 64-bit finaliser of MurmurHash3 over ``h`` and ``lane``."""
    x = h ^ np.uint64(lane * int(_P1) % 2**64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: For each byte value, its bits spread over the eight bytes of a word.
_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of ``counts`` (positive) hashes, the bits set in more than half of them."""
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    parts = (counts + 254) // 255  # sums of 255 single bits fit in a byte
    owner = np.repeat(np.arange(len(counts)), parts)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = firsts[owner] + 255 * order
    heads = np.cumsum(parts) - parts
    out = np.zeros(len(counts), dtype=np.uint64)
    for octet in range(8):
        spread = _SPREAD[((hashes >> np.uint64(8 * octet)) & np.uint64(255)).astype(np.intp)]
        sums = np.add.reduceat(spread, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(sums, heads, axis=0)
        for bit in range(8):
            out |= (2 * total[:, bit] > counts).astype(np.uint64) << np.uint64(8 * octet + bit)
    return out
