"""Binary fuse filters: static sets of 64-bit keys with one byte a slot and no false negatives."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QII")  # seed, segments, slots in a segment
ARITY = 3


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit finaliser."""
    x = keys ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashes: np.ndarray, segments: int, length: int) -> np.ndarray:
    """The three slots of each key: one in each of three neighbouring segments."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    return np.stack([(first + np.uint64(i)) * np.uint64(length) + ((hashes >> np.uint64(10 * i)) & mask) for i in range(ARITY)]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32)) ^ (hashes >> np.uint64(17))).astype(np.uint8)


def _peel(places: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own slots), each key alone in its slot among the keys not yet taken."""
    n = places.shape[1]
    order = np.arange(n, dtype=np.int64)
    count = np.zeros(slots, np.int64)
    held = np.zeros(slots, np.int64)  # xor of the keys in a slot
    for row in places:
        np.add.at(count, row, 1)
        np.bitwise_xor.at(held, row, order)
    rounds, taken = [], 0
    alone = np.flatnonzero(count == 1)
    while len(alone):
        keys, first = np.unique(held[alone], return_index=True)
        own = alone[first]
        rounds.append((keys, own))
        taken += len(keys)
        near = places[:, keys]
        for row in near:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(held, row, keys)
        near = np.unique(near)
        alone = near[count[near] == 1]
    return rounds if taken == n else None


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct unsigned 64-bit keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    length = 1 << max(2, min(10, int(np.log(n) / np.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)) + 32
    seed = 1
    while True:
        segments = max(1, int(np.ceil(room / length)) - ARITY + 1)
        slots = (segments + ARITY - 1) * length
        hashes = _mix(keys, seed)
        places = _places(hashes, segments, length)
        rounds = _peel(places, slots)
        if rounds is not None:
            break
        seed, room = seed + 1, room * 1.05
    table, prints = np.zeros(slots, np.uint8), _prints(hashes)
    for chosen, own in reversed(rounds):
        at = places[:, chosen]
        # the key's own slot is still empty, so the three together give what the other two lack
        table[own] = prints[chosen] ^ np.bitwise_xor.reduce(table[at], axis=0)
    return HEAD.pack(seed, segments, length) + table.tobytes()


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the set: always for its members, for about one in 256 others."""
    seed, segments, length = HEAD.unpack_from(filter_)
    table = np.frombuffer(filter_, np.uint8, offset=HEAD.size)
    hashes = _mix(keys.astype(np.uint64), seed)
    return np.bitwise_xor.reduce(table[_places(hashes, segments, length)], axis=0) == _prints(hashes)
