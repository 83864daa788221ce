"""Double-array tries of number sequences: ``child = base[state] + symbol``, real where ``check[child] == state``."""

from __future__ import annotations

import numpy as np

FREE = -1
#: A number's place in the alphabet is stepped through as digits: small alphabets pack without large gaps.
RADIX_BITS = 10
RADIX = 1 << RADIX_BITS
TRIES_OF_A_PLACE = 24


class DoubleArray:
    """A trie of equally long sequences; all texts' positions are stepped through it at once.

    ``alphabet`` holds the sorted distinct numbers; a number's symbol is its place there plus one, so
    symbol 0 is none of them. A symbol is stepped through digit by digit, the highest first.
    ``accepting[i]`` is the state of sequence ``i``.
    """

    def __init__(self, alphabet: np.ndarray, base: np.ndarray, check: np.ndarray, accepting: np.ndarray, length: int):
        self.alphabet, self.base, self.check, self.accepting, self.length = alphabet, base, check, accepting, length
        self.digits = _digits(len(alphabet))

    @classmethod
    def build(cls, sequences: np.ndarray) -> DoubleArray:
        """Trie of the rows of a matrix, which are sorted and distinct."""
        rows, length = sequences.shape
        alphabet, symbols = np.unique(sequences, return_inverse=True)
        symbols = symbols.reshape(rows, length).astype(np.int64) + 1
        parts = [_digit(symbols[:, word], shift) for word in range(length) for shift in _digits(len(alphabet))]
        used = np.ones(1, bool)  # the root
        bases: list[tuple[np.ndarray, np.ndarray]] = []
        states = np.zeros(rows, np.int64)
        differs = np.zeros(rows, bool)
        checks: list[tuple[np.ndarray, np.ndarray]] = []
        for part in parts:
            differs[:1] = True
            differs[1:] |= part[1:] != part[:-1]
            first = np.flatnonzero(differs)
            parent, symbol = states[first], part[first]
            starts = np.flatnonzero(np.diff(parent, prepend=-1))
            base, used = _place(symbol, starts, used)
            children = base + symbol
            bases.append((parent[starts], base[starts]))
            checks.append((children, parent))
            states = children[np.cumsum(differs) - 1]
        size = len(used)
        base, check = np.zeros(size, np.int32), np.full(size + RADIX, FREE, np.int32)  # no step leaves ``check``
        for where, value in bases:
            base[where] = value
        for where, value in checks:
            check[where] = value
        return cls(alphabet, base, check, states.astype(np.int32), length)

    def symbols_of(self, numbers: np.ndarray) -> np.ndarray:
        """Symbols of numbers, 0 for those that are in no sequence."""
        place = np.minimum(np.searchsorted(self.alphabet, numbers), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == numbers, place + 1, 0).astype(np.int32)

    def accepted(self, symbols: np.ndarray) -> np.ndarray:
        """Accepting states of all positions at which a sequence starts."""
        at = np.flatnonzero(symbols[:len(symbols) - self.length + 1]) if len(symbols) >= self.length else np.zeros(0, np.int64)
        state = np.zeros(len(at), np.int32)
        for level in range(self.length):
            symbol = symbols[at + level]
            known = np.flatnonzero(symbol)
            at, state, symbol = at[known], state[known], symbol[known]
            for shift in self.digits:
                child = self.base[state] + _digit(symbol, shift)
                real = np.flatnonzero(self.check[child] == state)
                at, state, symbol = at[real], child[real], symbol[real]
        return state


def _digits(size: int) -> list[int]:
    """Shifts of the digits of the numbers up to ``size``, the highest digit first."""
    return list(range((max(size.bit_length() - 1, 0) // RADIX_BITS) * RADIX_BITS, -1, -RADIX_BITS))


def _digit(symbols: np.ndarray, shift: int) -> np.ndarray:
    return symbols >> shift & RADIX - 1


def _place(symbol: np.ndarray, starts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases at which every parent's children fall on free places; children of a parent stand together.

    Parents with many children go first, behind the last used place if no free places fit soon;
    those with one child fill the places that are left.
    """
    counts = np.diff(np.append(starts, len(symbol)))
    base = np.zeros(len(symbol), np.int64)
    top = len(used)
    used = np.concatenate([used, np.zeros(len(symbol) + 2 * RADIX, bool)])
    free, cursor = np.flatnonzero(~used[:top + RADIX]), 0
    for node in np.argsort(-counts, kind="stable"):
        if counts[node] == 1:
            break
        children = symbol[starts[node]:starts[node] + counts[node]]
        at, step = -1, max(4, 2048 // len(children))
        for _ in range(TRIES_OF_A_PLACE):
            if cursor >= len(free):
                free, cursor = np.flatnonzero(~used[:top + RADIX]), 0
            tried = free[cursor:cursor + step] - children[0]
            fits = np.flatnonzero((tried >= 0) & ~used[tried[:, None] + children[None, :]].any(axis=1))
            if len(fits):
                at = int(tried[fits[0]])
                break
            cursor += step
        if at < 0:
            at = max(top - int(children[0]), 0)
        used[at + children] = True
        top = max(top, at + int(children[-1]) + 1)
        if top + 2 * RADIX > len(used):
            used = np.concatenate([used, np.zeros(len(used) // 4 + 2 * RADIX, bool)])
        base[starts[node]:starts[node] + counts[node]] = at
    alone = starts[counts == 1]
    free = np.flatnonzero(~used[:top])
    free = free[free >= RADIX][:len(alone)]  # bases stay positive
    end = max(top, RADIX)
    free = np.concatenate([free, np.arange(end, end + len(alone) - len(free))])
    top = max(top, int(free[-1]) + 1) if len(free) else top
    used = np.concatenate([used, np.zeros(max(top - len(used), 0), bool)])
    used[free] = True
    base[alone] = free - symbol[alone]
    return base, used[:top]
