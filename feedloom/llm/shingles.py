"""Sets of word shingles as 64-bit hashes, from Arrow text buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text whose words are hashed at once; longer words are hashed one by one.
SPAN = 1 << 20
LONG = 1 << 16

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_FIRST = np.uint64(0xBF58476D1CE4E5B9)
_SECOND = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(1))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_UP: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _UP:
        _UP.extend((_powers(_BASE, SPAN + LONG), _powers(pow(_BASE, -1, 1 << 64), SPAN + LONG)))
    return _UP


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of texts that lie end to end in ``data``.

    A word is a run of bytes other than ASCII white space, with A to Z lowered; ``begins``
    are the texts' starts. A word's hash is its polynomial modulo 2**64, mixed.
    """
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    edge[-1] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = 1 + np.flatnonzero(solid & (~after | edge[1:]))
    out = np.empty(len(starts), np.uint64)
    up, down = _tables()
    k = 0
    while k < len(starts):
        if ends[k] - starts[k] > LONG:
            word = _LOWER[data[starts[k] : ends[k]]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            k += 1
            continue
        a = starts[k]
        stop = int(np.searchsorted(starts, a + SPAN))
        far = np.flatnonzero(ends[k:stop] - starts[k:stop] > LONG)
        stop = k + int(far[0]) if len(far) else stop
        part = data[a : ends[stop - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        s, e = starts[k:stop] - a, ends[k:stop] - a
        out[k:stop] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        k = stop
    return out, starts


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending: windows of WORDS words; all words, if
    they are fewer; none without words. NULL has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.null_count:
        texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    hashes, starts = words(data, offsets[:-1])
    first = np.searchsorted(starts, offsets)
    windows = hashes.copy()
    for k in range(1, WORDS):
        windows[:-k] = mix(windows[:-k] * _FIRST + hashes[k:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= WORDS:
            own = np.sort(windows[a : b - WORDS + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            short = hashes[a : a + 1]
            for k in range(a + 1, b):
                short = mix(short * _FIRST + hashes[k : k + 1])
            yield mix(short + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def label(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the intersection has at least ``percent`` of the union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


#: Sets of up to this size are compared first by 16 bits of each hash, larger ones by 32.
NARROW = 4096


def coarse(shingles: np.ndarray) -> bytes:
    """The lowest bits of each hash, in order: two or four bytes each."""
    kind = np.uint16 if len(shingles) <= NARROW else np.uint32
    return (b"\2" if kind is np.uint16 else b"\4") + np.sort(shingles.astype(kind)).tobytes()


def may_link(a: bytes, b: bytes, percent: int) -> bool:
    """False only where the full sets are not linked: equal hashes have equal low bits, so
    the matches of the low bits, counted with repeats, are at least the intersection."""
    kinds = {2: np.uint16, 4: np.uint32}
    x, y = (np.frombuffer(v, kinds[v[0]], offset=1) for v in (a, b))
    if x.dtype != y.dtype:
        x, y = (np.sort(v.astype(np.uint16)) for v in (x, y))
    same = len(np.intersect1d(_numbered(x), _numbered(y), assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same)


def _numbered(values: np.ndarray) -> np.ndarray:
    """Sorted values made distinct by how often they were met before."""
    at = np.arange(len(values))
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values.astype(np.int64) + ((at - np.maximum.accumulate(np.where(new, at, 0))) << 32)
