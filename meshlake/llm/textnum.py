"""Hashes of many substrings at once, over the bytes of a batch of texts.

A text's bytes are mapped to fixed random 64-bit values and summed with powers of an odd
number modulo 2**64, so that any substring's hash comes from two prefix sums."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import zstandard

_RNG = np.random.default_rng(20240131)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}
_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the system, which workers that live on would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # not every C library has it
        _LIBC.malloc_trim(0)


#: Bytes of text that are worked on at once; longer texts come in overlapping segments.
CHUNK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        for name, x in (("up", BASE), ("down", _INVERSE)):
            p = np.full(max(n, CHUNK + 4096), x, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: All ASCII but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, lower: bool, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a buffer in which words don't cross texts
    (a separator stands between texts)."""
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = breaks[buf]
    turn = np.flatnonzero(space[1:] != space[:-1])
    start, end = turn[::2], turn[1::2]
    sums = prefix_sums(_LOWER[buf] if lower else buf)
    return start, end, hash_spans(sums, start, end)


def chunked(texts: list[bytes], most: int = CHUNK):
    """Runs of texts (first, last) of at most ``most`` bytes together, or a single longer one."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) + 1 > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _pieces(text: bytes, most: int, breaks: np.ndarray):
    """A long text cut at separators."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        tail = np.frombuffer(text, np.uint8, count=cut - at, offset=at)
        gap = np.flatnonzero(breaks[tail])
        if len(gap):
            cut = at + int(gap[-1]) + 1
        else:  # one word longer than a piece: to its end
            rest = np.flatnonzero(breaks[np.frombuffer(text, np.uint8, offset=at)])
            cut = at + int(rest[0]) + 1 if len(rest) else len(text)
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def word_hashes(texts: list[bytes], lower: bool = True, breaks: np.ndarray = _SPACE):
    """For each run of texts: index of the first, the words' hashes, and where each text's words begin
    (one more entry than texts); with the words' start and end within their own text."""
    for first, last in chunked(texts):
        if last - first == 1 and len(texts[first]) > CHUNK:
            got = [(at, words(np.frombuffer(p, np.uint8), lower, breaks)) for at, p in _pieces(texts[first], CHUNK, breaks)]
            h = np.concatenate([w[2] for _, w in got])
            s = np.concatenate([w[0] + at for at, w in got])
            e = np.concatenate([w[1] + at for at, w in got])
            yield first, h, np.array([0, len(h)]), s, e
            continue
        lengths = np.array([len(t) + 1 for t in texts[first:last]])
        ends = np.cumsum(lengths)
        s, e, h = words(np.frombuffer(b"\n".join(texts[first:last]), np.uint8), lower, breaks)
        cut = np.concatenate([[0], np.searchsorted(s, ends)])
        base = np.repeat(ends - lengths, np.diff(cut))
        yield first, h, cut, s - base, e - base


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words (those that cross texts too)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total += h[i : len(h) - n + 1 + i] * np.uint64(pow(BASE, i + 1, 2**64))
    return mix(total)


def pack_planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of integers, byte by byte, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unpack_planes(data: bytes, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view("<u8").copy()
