"""Token ids of short byte strings, remembered in arrays, so that whole batches are looked up at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

_LO, _HI, _LEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Keeps the first n bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class FragmentIds:
    """Ids of fragments, told apart by a 64-bit hash of their bytes.

    ``encode`` gives for a list of fragments their ids, one after another, and how many each has. Each
    distinct fragment is encoded once while ``most`` or fewer are held, with 2**30 ids at most; beyond it all
    are forgotten, which changes no result. Fragments of more than 16 bytes are hashed one by one.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear(16)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: free
        self.value = np.zeros(1 << bits, np.int32)
        self.held = self.used = 0
        self.known = np.zeros(0, np.uint64)
        self.first, self.many = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)

    def _hashes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = raw + bytes(16)
        size = ends - starts
        words = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
        key = (words[starts] & _KEEP[np.minimum(size, 8)]) * _LO
        more = np.flatnonzero(size > 8)
        hi = (words[starts[more] + 8] & _KEEP[np.minimum(size[more] - 8, 8)]) * _HI
        key[more] ^= hi << np.uint64(29) | hi >> np.uint64(35)
        key += size.astype(np.uint64) * _LEN
        key ^= key >> np.uint64(32)
        key *= _HI
        long = np.flatnonzero(size > 16)
        if len(long):
            digest = xxhash.xxh3_64_intdigest
            key[long] = np.array([digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], np.uint64)
        key[key == 0] = 1
        return key

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        last = len(self.keys) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = None
        while True:
            held = self.keys[slot]
            hit = held == keys
            if left is None:
                out[hit] = self.value[slot[hit]]
                left = np.flatnonzero(~hit & (held != 0))
            else:
                out[left[hit]] = self.value[slot[hit]]
                going = ~hit & (held != 0)
                left, slot = left[going], slot[going]
                keys = keys[going]
            if not len(left):
                return out
            if len(keys) != len(left):
                keys, slot = keys[left], slot[left]
            slot = slot + 1 & last

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct keys, none of which is held, into free slots."""
        last = len(self.keys) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.value[slot[mine]] = numbers[mine]
            keys, numbers, slot = keys[~mine], numbers[~mine], slot[~mine] + 1 & last

    def _add(self, keys: np.ndarray, fragments: list[bytes]) -> None:
        ids, many = self.encode(fragments)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.held + len(keys) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.many = np.concatenate([self.many, np.zeros_like(self.many)])
        self.pool[self.used : self.used + len(ids)] = ids
        numbers = np.arange(self.held, self.held + len(keys))
        self.first[numbers] = self.used + np.cumsum(many) - many
        self.many[numbers] = many
        self.known = np.concatenate([self.known, keys])
        self.held += len(keys)
        self.used += len(ids)
        if 2 * self.held > len(self.keys):
            while 2 * self.held > 1 << self.bits:
                self.bits += 1
            self.keys, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._insert(self.known, np.arange(self.held))
        else:
            self._insert(keys, numbers)

    def of(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments raw[start:end], one after another, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys = self._hashes(raw, starts, ends)
        number = self._find(keys)
        if (number < 0).any():
            if self.held > self.most or self.used > 1 << 30:
                self._clear(self.bits)
                number[:] = -1
            new = np.flatnonzero(number < 0)
            distinct, at = np.unique(keys[new], return_index=True)
            at = new[at]
            self._add(distinct, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            number[new] = self._find(keys[new])
        many = self.many[number].astype(np.int64)
        return self.pool[spread(self.first[number].astype(np.int64), many)], many
