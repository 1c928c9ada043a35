"""Non-decreasing numbers in near-minimal space, with a select structure that finds the k-th one in place.

n numbers up to u take about 2 + log2(u / n) bits each: the low log2(u / n) bits lie side by side, the high parts are a bit
vector with a one for every number, where the k-th one at bit p stands for the high part p - k. Where every
256th one lies is kept in 32 bits, so a single number is found from three short reads.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Ones between two kept places.
SAMPLE = 256
#: Bytes of the high bits that are read at a time.
STEP = 512
_HEAD = 4


def _bits_to_bytes(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Bytes of non-decreasing unsigned 64-bit numbers. At most 2^30 of them, so that places fit into 32 bits."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n > 1 << 30:
        raise ValueError("too many numbers for one structure")
    last = int(values[-1]) if n else 0
    low = max(0, (last // max(n, 1)).bit_length() - 1)
    head = np.array([n, low, ((last >> low) + n + 7) // 8, (n * low + 7) // 8], np.int64).tobytes()
    lows = []
    for at in range(0, n if low else 0, 1 << 16):
        # A block has a multiple of eight numbers, so it ends with a whole byte.
        part = values[at:at + (1 << 16)]
        lows.append(_bits_to_bytes((part[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1)))
    place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((last >> low) + n, np.uint8)
    high[place] = 1
    return head + place[::SAMPLE].astype(np.uint32).tobytes() + b"".join(lows) + _bits_to_bytes(high)


class Reader:
    """Numbers of an encoded structure. read(at, size) gives its bytes; only those that a question needs are read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        self.n, self.low, self.high_bytes, self.low_bytes = np.frombuffer(read(0, 8 * _HEAD), np.int64).tolist()
        self.samples_at = 8 * _HEAD
        self.low_at = self.samples_at + 4 * (-(-self.n // SAMPLE))
        self.high_at = self.low_at + self.low_bytes
        self.size = self.high_at + self.high_bytes

    def _lows(self, i: int, j: int) -> np.ndarray:
        if not self.low:
            return np.zeros(j - i, np.uint64)
        first, last = i * self.low, j * self.low
        data = np.frombuffer(self.read(self.low_at + first // 8, (last + 7) // 8 - first // 8), np.uint8)
        bits = np.unpackbits(data, bitorder="little")[first % 8:first % 8 + last - first].reshape(-1, self.low)
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def slice(self, i: int, j: int) -> np.ndarray:
        """The numbers from place i up to place j, as unsigned 64-bit numbers."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.empty(0, np.uint64)
        # From the kept place before i the ones are counted until j of them are found.
        block = i // SAMPLE
        at = int(np.frombuffer(self.read(self.samples_at + 4 * block, 4), np.uint32)[0])
        skip, wanted, found = i - block * SAMPLE, j - block * SAMPLE, []
        byte, have = at // 8, 0
        while have < wanted:
            size = min(max(STEP, (wanted - have) // 2), self.high_bytes - byte)
            bits = np.unpackbits(np.frombuffer(self.read(self.high_at + byte, size), np.uint8), bitorder="little")
            if byte == at // 8:
                bits[:at % 8] = 0
            ones = np.flatnonzero(bits) + 8 * byte
            found.append(ones)
            have += len(ones)
            byte += size
        places = np.concatenate(found)[skip:wanted]
        return (places - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low) | self._lows(i, j)

    def select(self, k: int) -> int:
        """The number at place k."""
        return int(self.slice(k, k + 1)[0])
