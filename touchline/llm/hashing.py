"""Words, shingles and their hashes, over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
# The primes of XXH64.
_P1 = _U(0x9E3779B185EBCA87)
_P2 = _U(0xC2B2AE3D27D4EB4F)
_P3 = _U(0x165667B19E3779F9)
_P4 = _U(0x85EBCA77C2B2AE63)
_P5 = _U(0x27D4EB2F165667C5)
#: Hashes worked on at once, so that the arrays stay in the cache.
_BLOCK = 1 << 14
#: Longer strings are hashed by the xxhash library one by one.
_LONG = 1024
#: Zero bytes after the text, so that a read of eight bytes never passes the end.
_PAD = bytes(16)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(lane: np.ndarray) -> np.ndarray:
    return _rotl(lane * _P2, 31) * _P1


def _xxh64_block(
    octets: np.ndarray, u32: np.ndarray, u64: np.ndarray, start: np.ndarray, size: np.ndarray,
    seed: int,
) -> np.ndarray:
    h = np.full(len(start), _U(seed) + _P5)
    full = np.flatnonzero(size >= 32)
    if full.size:
        at, stripes = start[full], size[full] // 32
        lanes = [
            np.full(full.size, first)
            for first in (_U(seed) + _P1 + _P2, _U(seed) + _P2, _U(seed), _U(seed) - _P1)
        ]
        step, left = 0, np.arange(full.size)
        while left.size:
            read = at[left] + 32 * step
            for k, lane in enumerate(lanes):
                lane[left] = _rotl(lane[left] + u64[read + 8 * k] * _P2, 31) * _P1
            step += 1
            left = left[stripes[left] > step]
        total = sum(_rotl(lane, r) for lane, r in zip(lanes, (1, 7, 12, 18), strict=True))
        for lane in lanes:
            total = (total ^ _round(lane)) * _P1 + _P4
        h[full] = total
    h += size.astype(_U)
    at, rest = start + size // 32 * 32, size % 32
    for k in range(3):
        some = np.flatnonzero(rest >= 8 * (k + 1))
        h[some] = _rotl(h[some] ^ _round(u64[at[some] + 8 * k]), 27) * _P1 + _P4
    at, rest = at + (rest & 24), rest & 7
    some = np.flatnonzero(rest >= 4)
    h[some] = _rotl(h[some] ^ (u32[at[some]].astype(_U) * _P1), 23) * _P2 + _P3
    at, rest = at + (rest & 4), rest & 3
    for k in range(3):
        some = np.flatnonzero(rest > k)
        h[some] = _rotl(h[some] ^ (octets[at[some] + k].astype(_U) * _P5), 11) * _P1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def xxh64(text: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of ``text[start:start + size]`` for each start and size."""
    held = text + _PAD
    octets = np.frombuffer(held, np.uint8)
    u32 = np.ndarray(len(held) - 3, "<u4", held, strides=(1,))
    u64 = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    out = np.empty(len(start), _U)
    with np.errstate(over="ignore"):
        for at in range(0, len(start), _BLOCK):
            s, n = start[at : at + _BLOCK], size[at : at + _BLOCK]
            long = np.flatnonzero(n > _LONG)
            got = _xxh64_block(octets, u32, u64, s, np.where(n > _LONG, 0, n), seed)
            for i in long.tolist():
                got[i] = xxhash.xxh64_intdigest(text[s[i] : s[i] + n[i]], seed)
            out[at : at + _BLOCK] = got
    return out


def spaced(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and words joined by one space.

    Words are what lies between the bytes 0x20 and 0x09 to 0x0D.
    """
    return b" ".join(text.encode().lower().split())


def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of what ``spaced`` returns."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def groups_of_bytes(joined: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text has a range of its own."""
    first = held = 0
    for i, text in enumerate(joined):
        if i > first and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(joined):
        yield first, len(joined)


def shingle_spans(joined: list[bytes], words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, start and size of each shingle in it, shingles of each text.

    A text of fewer words, but one at least, has one shingle: all of it.
    """
    starts, ends, counts, base = [], [], [], 0
    for text in joined:
        s, e = word_spans(text)
        n = min(len(s), 1) if len(s) < words else len(s) - words + 1
        starts.append(s[:n] + base)
        ends.append(e[-n:] + base if n else e[:0])
        counts.append(n)
        base += len(text) + 1
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return b" ".join(joined), start, end - start, np.array(counts, np.int64)
