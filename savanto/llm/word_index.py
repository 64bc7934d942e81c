"""A bidirectional FM-index over word ids, built for phrases of a limited length.

The text is one sequence of numbers: words from 1 on, 0 between pieces. Its rotations are sorted by as many
symbols as the longest phrase has, which is all that intervals of such phrases need. The symbols before the
sorted rotations are the forward transform; the same of the text read backwards is the reverse one. A phrase
is an interval of either. Extending it to the left narrows the forward interval, extending it to the right
the reverse one, and the other interval follows from the sizes of its siblings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def _transform(text: np.ndarray, n_symbols: int, depth: int) -> np.ndarray:
    """The symbol before each rotation, in the order of the rotations' first ``depth`` symbols."""
    key, top = text.astype(np.int64), n_symbols
    for k in range(1, depth):
        if top > (1 << 62) // n_symbols:
            key = np.unique(key, return_inverse=True)[1]
            top = int(key.max()) + 1
        key = key * n_symbols + np.roll(text, -k)
        top *= n_symbols
    return text[np.argsort(key, kind="stable") - 1]


@dataclass
class Phrases:
    """Phrases of one length: their word ids, their intervals, and their occurrences."""

    words: np.ndarray
    low: np.ndarray
    reverse_low: np.ndarray
    n: np.ndarray


class WordIndex:
    """``n_symbols`` counts the 0 between pieces as well."""

    def __init__(self, forward: np.ndarray, reverse: np.ndarray | None, n_symbols: int) -> None:
        self.forward, self.reverse, self.n_symbols = forward, reverse, n_symbols

    @classmethod
    def build(cls, text: np.ndarray, n_symbols: int, depth: int) -> WordIndex:
        return cls(_transform(text, n_symbols, depth), _transform(text[::-1], n_symbols, depth), n_symbols)

    def single(self) -> Phrases:
        """Every word."""
        sizes = np.bincount(self.forward, minlength=self.n_symbols)
        low = np.cumsum(sizes) - sizes
        words = np.flatnonzero(sizes[1:]) + 1
        return Phrases(words[:, None].astype(np.int32), low[words], low[words], sizes[words])

    def _extended(self, transform: np.ndarray, low: np.ndarray, n: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-symbol extensions of disjoint intervals: (interval, its twin, size, parent, symbol)."""
        owner = np.full(len(transform), -1, np.int32)
        owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(np.arange(len(low), dtype=np.int32), n)
        # the step back to the symbol before keeps the order: rotations by symbol, then as they stood
        back = np.argsort(transform, kind="stable")
        owner, symbol = owner[back], transform[back]
        starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
        size = np.diff(np.concatenate([starts, [len(owner)]]))
        inside = owner[starts] >= 0
        starts, size = starts[inside], size[inside]
        parent, symbol = owner[starts], symbol[starts]
        # among the extensions of one interval the twin lies behind those by smaller symbols
        by_parent = np.argsort(parent, kind="stable")
        before = np.cumsum(size[by_parent]) - size[by_parent]
        head = np.concatenate([[True], parent[by_parent][1:] != parent[by_parent][:-1]]) if len(parent) else np.empty(0, bool)
        first = np.maximum.accumulate(np.where(head, before, 0)) if len(parent) else before
        twin = np.empty(len(starts), np.int32)
        twin[by_parent] = other[parent[by_parent]] + before - first
        real = symbol > 0
        return starts[real].astype(np.int32), twin[real], size[real].astype(np.int32), parent[real], symbol[real]

    def to_left(self, p: Phrases) -> Phrases:
        """The phrases with each word that stands before them."""
        low, twin, n, parent, symbol = self._extended(self.forward, p.low, p.n, p.reverse_low)
        return Phrases(np.column_stack([symbol, p.words[parent]]).astype(np.int32), low, twin, n)

    def to_right(self, p: Phrases) -> Phrases:
        """The phrases with each word that stands behind them."""
        low, twin, n, parent, symbol = self._extended(self.reverse, p.reverse_low, p.n, p.low)
        return Phrases(np.column_stack([p.words[parent], symbol]).astype(np.int32), twin, low, n)

    def phrases(self, longest: int) -> Iterator[Phrases]:
        """All phrases of 1 to ``longest`` words, grown to the left and to the right by turns; only to the left
        where the reverse transform is not at hand."""
        found = self.single()
        yield found
        for size in range(2, longest + 1):
            found = self.to_left(found) if size % 2 == 0 or self.reverse is None else self.to_right(found)
            yield found
