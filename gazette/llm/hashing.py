"""Word and shingle hashes of whole Arrow batches, computed with array operations.

A word is a run of bytes other than space and control white space; A-Z count as a-z. Its hash is a polynomial
over the bytes, taken from running sums, so a batch costs a few passes over its bytes and no loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; the arrays on the way take some fifty times as much.
BLOCK = 1 << 18
PIECE_BITS = 52
PIECE_MASK = np.uint64((1 << PIECE_BITS) - 1)
BATCH_DOCS = 1 << (64 - PIECE_BITS)

_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that every bit of the result hangs on every bit of the input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _table(name: str, size: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < size:
        if name == "marks":
            have = np.ones(256, bool)
            have[128:] = False
            for low, high in (b"09", b"AZ", b"az"):
                have[low:high + 1] = False
        elif name == "byte":
            lower = np.arange(256)
            lower[65:91] += 32
            have = mix((lower + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        elif name == "space":
            have = np.zeros(256, bool)
            have[[0x20, 9, 10, 11, 12, 13]] = True
        else:
            base = _BASE if name == "power" else pow(_BASE, -1, 1 << 64)
            have = np.full(size, base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        _tables[name] = have
    return have


def _block_words(data: np.ndarray, first: np.ndarray, gaps: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one block and where each begins. first: marks bytes that begin a text."""
    text = ~_table(gaps, 256)[data]
    before = np.empty_like(text)
    before[0] = False
    before[1:] = text[:-1]
    starts = np.flatnonzero(text & (first | ~before))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sums = np.zeros(len(data) + 1, np.uint64)
    weighted = _table("byte", 256)[data]
    weighted[~text] = 0
    weighted *= _table("power", len(data))[:len(data)]
    np.cumsum(weighted, out=sums[1:])
    # A word's bytes reach to the next word's start or the end; the white space between counts as zero.
    raw = np.diff(np.append(sums[starts], sums[-1])) * _table("inverse", len(data))[starts]
    return mix(raw), starts


def words(texts: pa.Array, gaps: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts and the index of its text; null texts have no words.

    gaps: what lies between words, "space" or "marks" (all ASCII but letters and digits).
    """
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    space = _table(gaps, 256)
    hashes, owners, at, end = [], [], int(bounds[0]), int(bounds[-1])
    inner = np.unique(bounds[:-1])
    while at < end:
        stop = min(at + BLOCK, end)
        if stop < end:
            # A block ends where a text or a word does; a word longer than a block is taken as a whole.
            free = np.flatnonzero(space[data[at:stop]])
            cut = inner[np.searchsorted(inner, stop, "right") - 1]
            if cut > at or len(free):
                stop = max(int(cut), at + int(free[-1]) + 1 if len(free) else 0)
            else:
                while stop < end and not space[data[stop]] and stop not in inner:
                    stop += 1
        first = np.zeros(stop - at, bool)
        first[inner[(inner >= at) & (inner < stop)] - at] = True
        found, starts = _block_words(data[at:stop], first, gaps)
        hashes.append(found)
        owners.append(np.searchsorted(bounds, starts + at, "right") - 1)
        at = stop
    owner = np.concatenate(owners)
    if texts.null_count:
        keep = np.asarray(texts.is_valid())[owner]
        return np.concatenate(hashes)[keep], owner[keep]
    return np.concatenate(hashes), owner


def chains(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, by where it begins."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = (out ^ hashes[k:k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Running Karp-Rabin hash of every window of `size` words, from running sums."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    weighted = hashes * _table("power", len(hashes))[:len(hashes)]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(weighted)])
    return mix((sums[size:] - sums[:-size]) * _table("inverse", len(hashes))[:n])


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, as (index of the text, 52-bit hash), sorted by both.

    A text with fewer words than `size` has its whole word sequence as one shingle; at most 4096 texts at a time.
    """
    hashes, owner = words(texts)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = chains(hashes, size)
    whole = owner[:len(runs)] == owner[size - 1:] if len(runs) else np.empty(0, bool)
    parts = [(owner[:len(runs)][whole], runs[whole])]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    for k in range(1, size):
        at = first[count == k]
        if len(at):
            parts.append((owner[at], chains(hashes, k)[at]))
    owners = np.concatenate([p[0] for p in parts]).astype(np.uint64)
    keys = np.concatenate([p[1] for p in parts]) & PIECE_MASK
    keys |= owners << np.uint64(PIECE_BITS)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> np.uint64(PIECE_BITS)).astype(np.int64), keys & PIECE_MASK


def pieces_of(texts: pa.Array, limit: int = BLOCK, rows: int = BATCH_DOCS - 1):
    """Slices of an array with at most about `limit` bytes and `rows` texts; yields (start, slice)."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        stop = min(int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1, at + rows, len(texts))
        stop = max(stop, at + 1)
        yield at, texts.slice(at, stop - at)
        at = stop


def spaces() -> np.ndarray:
    """Which bytes lie between words."""
    return _table("space", 256)
