"""Arrays of a context tree over bytes: Krichevsky-Trofimov estimates mixed over all depths.

A gram is a context of ``DEPTH`` bytes and the byte after it, packed in one number with the
nearest context byte in the highest place, so that grams sharing a short context are
neighbours. Each byte is coded as eight binary choices; a node is a context and the bits
of the byte seen so far (1 followed by those bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DEPTH = 7
#: Contexts of this length are never cut: each belongs to one range of keys.
UNIT_DEPTH = 3
#: Grams whose levels are held at a time (some 300 bytes each); a context of more is cut at its next byte.
MOST_GRAMS = 200_000
PAD = b"\n"
_LOG_HALF = np.log(0.5)


def gram_keys(data: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Gram of every byte of ``data`` from the place ``depth`` on."""
    n = len(data) - depth
    keys = np.zeros(max(n, 0), np.uint64)
    if n <= 0:
        return keys
    wide = data.astype(np.uint64)
    for back in range(1, depth + 1):
        keys |= wide[depth - back:depth - back + n] << np.uint64(8 * (depth + 1 - back))
    keys |= wide[depth:]
    return keys


def unit_of(keys: np.ndarray, depth: int = DEPTH, unit: int = UNIT_DEPTH) -> np.ndarray:
    """The nearest ``unit`` context bytes of each gram."""
    return keys >> np.uint64(8 * (depth + 1 - unit))


def nodes_of(keys: np.ndarray, depth: int = DEPTH, unit: int = UNIT_DEPTH) -> np.ndarray:
    """Distinct nodes with contexts of ``unit`` bytes that the grams pass."""
    symbol, context = keys & np.uint64(255), unit_of(keys, depth, unit) << np.uint64(8)
    return np.unique(np.concatenate(
        [np.unique(context | np.uint64(1 << b) | (symbol >> np.uint64(8 - b))) for b in range(8)]))


def parts_of(keys: np.ndarray, depth: int, unit: int) -> Iterator[slice]:
    """Parts of sorted grams, of ``MOST_GRAMS`` at most or one context of ``unit`` bytes."""
    context = unit_of(keys, depth, unit)
    ends = np.append(np.flatnonzero(context[1:] != context[:-1]) + 1, len(keys))
    start = 0
    while start < len(keys):
        fits = int(np.searchsorted(ends, start + MOST_GRAMS, "right")) - 1
        end = int(ends[fits]) if fits >= 0 and ends[fits] > start else int(ends[fits + 1])
        yield slice(start, end)
        start = end


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(y)
    for step in range(8):
        product *= x + step
    return series - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives a sequence with these counts."""
    return (log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0)
            - 1.1447298858494002)  # log(pi)


class Level:
    """The nodes of one context length: keys, counts and weighted log probability."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.weighted = self.kt

    def add_children(self, parents: np.ndarray, weighted: np.ndarray) -> None:
        """Mix the own estimate with the product of the children's probabilities, half each."""
        below = np.bincount(np.searchsorted(self.keys, parents), weighted, len(self.keys))
        self.weighted = np.logaddexp(_LOG_HALF + self.kt, _LOG_HALF + below)

    def own_share(self) -> np.ndarray:
        """Posterior weight of the own estimate against the deeper ones."""
        return np.exp(np.minimum(_LOG_HALF + self.kt - self.weighted, 0.0))

    def estimate(self) -> np.ndarray:
        """Probability that the next bit is one."""
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def level_of(context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Level:
    """Nodes of (context, byte, count) rows."""
    keys, zeros, ones = [], [], []
    for bit in range(8):
        prefix = np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))
        node = context << np.uint64(8) | prefix
        is_one = (symbol >> np.uint64(7 - bit)) & np.uint64(1) == 1
        found, place = np.unique(node, return_inverse=True)
        both = np.bincount(place, count, len(found))
        one = np.bincount(place, np.where(is_one, count, 0), len(found))
        keys.append(found)
        zeros.append(both - one)
        ones.append(one)
    keys, zeros, ones = map(np.concatenate, (keys, zeros, ones))
    order = np.argsort(keys)
    return Level(keys[order], zeros[order], ones[order])


def parents_of(keys: np.ndarray) -> np.ndarray:
    """Node with the same bits and one context byte less."""
    return (keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(255))


def build(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, unit: int = UNIT_DEPTH) -> list[Level]:
    """Levels ``unit`` to ``depth`` of the grams, in that order; counts are above zero."""
    levels: list[Level] = []
    context, symbol, count = keys >> np.uint64(8), keys & np.uint64(255), counts.astype(np.float64)
    for d in range(depth, unit - 1, -1):
        level = level_of(context, symbol, count)
        if levels:
            level.add_children(parents_of(levels[0].keys), levels[0].weighted)
        levels.insert(0, level)
        if d > unit:
            pairs, place = np.unique((context >> np.uint64(8)) << np.uint64(8) | symbol, return_inverse=True)
            count = np.bincount(place, count, len(pairs))
            context, symbol = pairs >> np.uint64(8), pairs & np.uint64(255)
    return levels


def level_above(level: Level) -> Level:
    """Nodes with one context byte less than those of a whole level."""
    parents = parents_of(level.keys)
    keys, place = np.unique(parents, return_inverse=True)
    above = Level(keys, np.bincount(place, level.zeros, len(keys)), np.bincount(place, level.ones, len(keys)))
    above.add_children(parents, level.weighted)
    return above


def unit_level(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, unit: int = UNIT_DEPTH) -> Level:
    """The level of ``unit`` alone; deeper ones are built for a part of the sorted grams at a time."""
    parts = [level_above(unit_level(keys[p], counts[p], depth, unit + 1)) if _crowded(p, depth, unit)
             else build(keys[p], counts[p], depth, unit)[0] for p in parts_of(keys, depth, unit)]
    whole = Level(*(np.concatenate([np.zeros(0, t), *(getattr(x, c) for x in parts)])
                    for c, t in (("keys", np.uint64), ("zeros", float), ("ones", float))))
    whole.weighted = np.concatenate([np.zeros(0), *(x.weighted for x in parts)])
    return whole


def _crowded(part: slice, depth: int, unit: int) -> bool:
    return part.stop - part.start > MOST_GRAMS and unit < depth


def log10_in_parts(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, ...], depth: int = DEPTH,
                   unit: int = UNIT_DEPTH) -> np.ndarray:
    """:func:`log10_of` of sorted grams under the counts of those seen (above 0), a part at a time."""
    out = np.zeros(len(keys), np.float32)
    for p in parts_of(keys, depth, unit):
        seen = counts[p] > 0
        learned = keys[p][seen], counts[p][seen]
        if _crowded(p, depth, unit):
            level = level_above(unit_level(*learned, depth, unit + 1))
            out[p] = log10_in_parts(keys[p], counts[p], _lowered(nodes_of(keys[p], depth, unit + 1), level, top), depth, unit + 1)
        else:
            out[p] = log10_of(keys[p], build(*learned, depth, unit), top, depth, unit)
    return out


def _lowered(nodes: np.ndarray, level: Level, top: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What ``top`` and one more level add above ``nodes``."""
    up = parents_of(nodes)
    _, at = _found(top[0], up)
    own, rest, alone = (x[at] for x in top[1:])
    if not len(level.keys):
        return nodes, own, rest, alone
    here, place = _found(level.keys, up)
    share, estimate = level.own_share()[place], level.estimate()[place]
    return (nodes, np.where(here, own + rest * share * estimate, own), np.where(here, rest * (1 - share), rest),
            np.where(here, own + rest * estimate, alone))


def log10_of(keys: np.ndarray, levels: list[Level], top: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
             depth: int = DEPTH, unit: int = UNIT_DEPTH) -> np.ndarray:
    """Log10 probability of each gram's byte after its context.

    ``top`` holds for the nodes above the units (key, own part, share of what lies deeper,
    estimate where nothing deeper is known). A context that was never seen takes the estimate
    of the longest one that was.
    """
    top_keys, top_own, top_rest, top_alone = top
    total = np.zeros(len(keys))
    symbol = keys & np.uint64(255)
    shares = [(level.keys, level.own_share(), level.estimate()) for level in levels]
    for bit in range(8):
        prefix = np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))
        chance = np.full(len(keys), np.nan)
        for d in range(depth, unit - 1, -1):
            known, share, estimate = shares[d - unit]
            if not len(known):
                continue
            node = (keys >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8) | prefix
            here, place = _found(known, node)
            own = estimate[place]
            mixed = np.where(np.isnan(chance), own, share[place] * own + (1 - share[place]) * chance)
            chance = np.where(here, mixed, chance)
        node = unit_of(keys, depth, unit) << np.uint64(8) | prefix
        here, place = _found(top_keys, node)
        with_unit = np.where(np.isnan(chance), top_alone[place], top_own[place] + top_rest[place] * chance)
        chance = np.where(here, with_unit, np.where(np.isnan(chance), 0.5, chance))
        is_one = (symbol >> np.uint64(7 - bit)) & np.uint64(1) == 1
        total += np.log10(np.where(is_one, chance, 1 - chance))
    return total


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[place] == wanted, place
