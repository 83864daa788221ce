"""Sorted suffix runs: front coding, and a loser tree that never compares a known prefix again."""

from __future__ import annotations

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``known`` bytes."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differing = int.from_bytes(x) ^ int.from_bytes(y)
    return n - (differing.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Prefix shared with the string before, length of the rest, and the rests in one string."""
    shared = np.zeros(len(strings), np.uint16)
    rests, before = [], b""
    for i, s in enumerate(strings):
        shared[i] = common_prefix(before, s, 0)
        rests.append(s[shared[i]:])
        before = s
    return shared, np.array([len(r) for r in rests], np.uint16), b"".join(rests)


def decode_front(shared: np.ndarray, lengths: np.ndarray, rests: bytes) -> list[bytes]:
    """The strings of :func:`front_code`."""
    out, before, at = [], b"", 0
    for keep, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:keep] + rests[at:at + n]
        out.append(before)
        at += n
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs, each with its strings and the prefix lengths they share with the one before.

    Returns for each place of the merged order the run, the place in the run, and the prefix
    length shared with the string before. A candidate with the longer prefix in common with the
    last winner is the smaller one; only on a tie are bytes compared, from that prefix on.
    """
    total = sum(len(strings) for strings, _ in runs)
    out_run, out_at, out_shared = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
    k = 1
    while k < max(len(runs), 1):
        k *= 2
    lists = [r[0] for r in runs] + [[]] * (k - len(runs))
    prefixes = [r[1] for r in runs] + [[]] * (k - len(runs))
    place = [0] * k
    current = [s[0] if s else b"" for s in lists]
    shared = [0 if s else -1 for s in lists]  # with the last winner; -1: the run is over
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes the one it shares with the winner."""
        ha, hb = shared[a], shared[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        if ha < 0:
            return a, b
        x, y = current[a], current[b]
        h = common_prefix(x, y, ha)
        if x <= y:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    winners = list(range(k))
    size = k
    while size > 1:
        size //= 2
        following = []
        for i in range(size):
            w, lost = play(winners[2 * i], winners[2 * i + 1])
            loser[size + i] = lost
            following.append(w)
        winners = following
    w = winners[0]
    for n in range(total):
        out_run[n], out_at[n], out_shared[n] = w, place[w], shared[w]
        i = place[w] = place[w] + 1
        if i < len(lists[w]):
            current[w], shared[w] = lists[w][i], prefixes[w][i]
        else:
            current[w], shared[w] = b"", -1
        node = (k + w) >> 1
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1
    return out_run, out_at, out_shared
