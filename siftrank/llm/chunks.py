"""Token ids of texts through a table of the ids of their blank-separated chunks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A blank between two other characters: the split pattern never matches across its left side.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
MOST_IDS = 600_000


def _in_a_run(chunk: str) -> bool:
    """Whether the blank beside such a chunk of a plain split may belong to a run of white space."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class ChunkTable:
    """Ids of chunks, computed once for each distinct chunk and kept for the later batches of a task.

    ``encode_many`` gives the ids of each of a list of strings. Pieces of the split pattern never
    reach across a chunk's border, so the ids of a text are those of its chunks.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[np.ndarray]]):
        self.encode_many = encode_many
        self._clear()

    def _clear(self) -> None:
        self.checked: set[str] = set()
        self.in_a_run: set[str] = {""}
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.ids, self.size = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.chunks = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _add(self, texts: list[str]) -> None:
        found = self.encode_many(texts)
        lengths = np.array([len(x) for x in found], np.int64)
        while self.chunks + len(texts) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        total = int(lengths.sum())
        while self.size + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.starts[self.chunks:self.chunks + len(texts)] = self.size + np.cumsum(lengths) - lengths
        self.lengths[self.chunks:self.chunks + len(texts)] = lengths
        if total:
            self.ids[self.size:self.size + total] = np.concatenate(found)
        self.chunks += len(texts)
        self.size += total

    def _chunks(self, texts: list[str | None]) -> list[list[str]]:
        """Cut texts before every single blank; all chunks but the first have lost that blank."""
        parts = [t.split(" ") if t else [] for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p)
        new = [c for c in seen if c not in self.checked]
        self.checked.update(new)
        self.in_a_run.update(c for c in new if _in_a_run(c))
        return [_SAFE.split(t) if t and not self.in_a_run.isdisjoint(p) else p for t, p in zip(texts, parts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        if self.size > MOST_IDS:
            self._clear()
        parts = self._chunks(texts)
        new_first = dict.fromkeys(p[0] for p in parts if p and p[0] not in self.first)
        seen: set[str] = set()
        for p in parts:
            seen.update(p[1:])
        new_later = [c for c in seen if c not in self.later]
        base = self.chunks
        for i, c in enumerate(new_first):
            self.first[c] = base + i
        for i, c in enumerate(new_later):
            self.later[c] = base + len(new_first) + i
        if new_first or new_later:
            self._add([*new_first, *(" " + c for c in new_later)])
        place = self.later.__getitem__
        counts = np.array([len(p) for p in parts], np.int64)
        at = np.empty(int(counts.sum()), np.int64)
        end = 0
        for p in parts:
            if p:
                at[end] = self.first[p[0]]
                at[end + 1:end + len(p)] = np.fromiter(map(place, p[1:]), np.int64, len(p) - 1)
                end += len(p)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)]
        sums = np.concatenate([[0], ends])
        cut = np.concatenate([[0], np.cumsum(counts)])
        return ids, sums[cut[1:]] - sums[cut[:-1]]


def text_batches(texts: list[str | None], size: int = 2 << 20) -> list[tuple[int, int]]:
    """First and last place of parts of a list of texts, of about ``size`` characters each."""
    out, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            out.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out
