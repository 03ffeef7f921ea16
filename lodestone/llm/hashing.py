"""Hashes, packed arrays and Bloom filters of fixed size."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

U = np.uint64
HASHES = 4
BITS_EACH = 10


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shard_of(spread: np.ndarray, bits: int) -> np.ndarray:
    return (spread >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(spread), np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bases of two word hashes that know nothing of each other.
BASES = (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F)
#: Bytes that are hashed at once, up to the next white space.
CHUNK = 1 << 19


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_table(base, CHUNK + 1)


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2^64, below the n-th."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(x))])) for x in (base, pow(base, -1, 1 << 64)))


def _hash_chunk(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of data, where each starts)."""
    space = np.append(_SPACE[data], True)
    before = np.append(True, space[:-1])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    up, down = _powers(base) if len(data) <= CHUNK else _power_table(base, len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.append(U(0), np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)]))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def hash_bytes(data: bytes, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a text, where each starts).

    A word's hash is a polynomial in its bytes modulo 2^64, mixed; prefix sums
    give all words of a chunk at once, with no object for a word.  Chunks end at
    white space, so a text of any length takes the memory of a chunk and its words.
    """
    whole, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(whole):
        end = min(at + CHUNK, len(whole))
        if end < len(whole):
            tail = np.flatnonzero(_SPACE[whole[at:end]])
            if len(tail):
                end = at + int(tail[-1]) + 1
            else:  # one word fills the chunk: up to where it ends
                while end < len(whole) and not _SPACE[whole[end]]:
                    more = np.flatnonzero(_SPACE[whole[end : end + CHUNK]])
                    end = end + int(more[0]) if len(more) else min(end + CHUNK, len(whole))
        h, starts = _hash_chunk(whole[at:end], base)
        out.append((h, starts + at))
        at = end
    if len(out) == 1:
        return out[0]
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def bloom_add(bits: np.ndarray, size: int, members: np.ndarray) -> None:
    """Set the bits of members (64-bit hashes) in one segment of size bits."""
    step = mix(members ^ U(0xA5A5A5A5A5A5A5A5)) | U(1)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            at = ((members + U(i) * step) >> U(8)) % U(size)
            np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), (U(1) << (at & U(7))).astype(np.uint8))


def members_of(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Members (gram, 1..level) of all grams."""
    total = np.repeat(grams, levels)
    first = np.repeat(np.cumsum(levels) - levels, levels)
    return member(total, (np.arange(len(total)) - first + 1).astype(np.uint64))


def member(grams: np.ndarray, level) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(grams + U(level) * U(0xD1342543DE82EF95) if np.isscalar(level) else grams + level * U(0xD1342543DE82EF95))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter in 2^shard_bits segments of size bits each."""

    bits: np.ndarray
    shard_bits: int
    size: int

    def levels(self, grams: np.ndarray, shards: np.ndarray, most: int = 90) -> np.ndarray:
        """Level of each gram, by probing its members one after the other."""
        out = np.zeros(len(grams), np.int64)
        live = np.arange(len(grams))
        for level in range(1, most):
            g = member(grams[live], level)
            step = mix(g ^ U(0xA5A5A5A5A5A5A5A5)) | U(1)
            base = shards[live] * (self.size // 8)
            for i in range(HASHES):
                with np.errstate(over="ignore"):
                    at = ((g + U(i) * step) >> U(8)) % U(self.size)
                hit = np.flatnonzero((self.bits[base + (at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1)
                live, g, step, base = live[hit], g[hit], step[hit], base[hit]
                if not len(live):
                    return out
            out[live] = level
        return out


def segment_size(members: int, bits: int, most: int) -> int:
    """Bits of a segment: BITS_EACH for each member, within the largest size; whole bytes."""
    whole = min(most, max(64, BITS_EACH * members))
    return max(64, -(-whole // (1 << bits)) // 64 * 64 + 64)


def collected(segments: DataFrame, size: int, bits: int) -> tuple[Filter, list]:
    """The filter of rows (shard, bits, ...), whose total size its caller has bounded, and the rows."""
    got = segments.collect()
    whole = np.zeros((size // 8) << bits, np.uint8)
    for r in got:
        whole[r["shard"] * (size // 8) : (r["shard"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return Filter(whole, bits, size), got
