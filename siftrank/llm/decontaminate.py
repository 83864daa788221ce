"""Benchmark passages in record texts: SimHash of item-sized windows, Hamming blocks, exact check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, batches, bounded_batches
from siftrank.llm.chunks import text_batches

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of a window and an item at the least similarity differ in about 10 of 64 bits, with a deviation of 3.
RADIUS = 23
BLOCKS = 8
#: Bits in which at least one block of eight differs at most, if the whole differs in RADIUS bits.
BLOCK_RADIUS = RADIUS // BLOCKS
#: Characters of benchmark text that one broadcast index is built from.
INDEX_CHARACTERS = 16_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words at ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes:
    """64-bit hashes of words, each computed once for a worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from the hashes of the words."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        h = (h ^ words[i:i + n]) * _MIX if n > 0 else h
        h ^= h >> np.uint64(31)
    return h


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the ``count`` shingles from each start: a bit is set where over half of them have it."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts + count] - sums[starts]
    return np.packbits(ones * 2 > count, axis=1, bitorder="little").view(np.uint64)[:, 0]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller shingle weights over the sum of the larger ones; a weight is the number of occurrences."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class SizedItems:
    """The items of one number of words: fingerprints, block tables and shingle weights."""

    def __init__(self, n_words: int, items: list[tuple[object, np.ndarray]]):
        self.n_words, self.size = n_words, min(SHINGLE, n_words)
        self.count = n_words - self.size + 1
        self.ids = [i for i, _ in items]
        self.weights = [Counter(h.tolist()) for _, h in items]
        zero = np.zeros(1, np.int64)
        self.fingerprints = np.concatenate([window_fingerprints(h, zero, self.count) for _, h in items])
        values = np.arange(256, dtype=np.uint8)[:, None]
        blocks = self.fingerprints.view(np.uint8).reshape(-1, BLOCKS)
        #: For each block and each of its 256 values: which items lie within the block's radius.
        self.near = [np.bitwise_count(values ^ blocks[:, b]) <= BLOCK_RADIUS for b in range(BLOCKS)]
        #: Shingles of the item that a window must share to reach the similarity.
        self.need = max(1, ceil(2 * SIMILARITY / (1 + SIMILARITY) * self.count - 1e-9))

    def candidates(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius: any block close enough, then the whole fingerprint."""
        blocks = fingerprints.view(np.uint8).reshape(-1, BLOCKS)
        close = self.near[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            close = close | self.near[b][blocks[:, b]]
        window, item = np.nonzero(close)
        within = np.bitwise_count(fingerprints[window] ^ self.fingerprints[item]) <= RADIUS
        return window[within], item[within]


class BenchmarkIndex:
    """All items of a part of the benchmark, by their number of words."""

    def __init__(self, items: list[tuple[object, str | None]]):
        hashes, by_size = WordHashes(), {}
        for i, text in items:
            words = hashes.of(words_of(text))
            if len(words):
                by_size.setdefault(len(words), []).append((i, shingle_hashes(words, min(SHINGLE, len(words)))))
        self.sized = [SizedItems(n, found) for n, found in sorted(by_size.items())]
        self.shingles = {}
        for s in sorted({x.size for x in self.sized}):
            known = np.unique(np.array([h for x in self.sized if x.size == s for w in x.weights for h in w], np.uint64))
            filter_ = np.zeros(1 << 20, bool)
            filter_[known >> np.uint64(44)] = True
            self.shingles[s] = (known, filter_)

    def hits(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Which shingles occur in any item."""
        known, filter_ = self.shingles[size]
        found = filter_[shingles >> np.uint64(44)]
        at = np.flatnonzero(found)
        found[at] = np.isin(shingles[at], known)
        return found

    def matches(self, words: np.ndarray, least: dict[int, np.ndarray]) -> Iterator[tuple[object, float, int, int]]:
        """(item, similarity, first word, words) of the best window of every item found in one text."""
        for items in self.sized:
            hits = least[items.size]
            if len(hits) < items.count:
                continue
            upto = np.concatenate([[0], np.cumsum(hits)])
            # A window below this number of benchmark shingles cannot reach the similarity.
            starts = np.flatnonzero(upto[items.count:] - upto[:-items.count] >= items.need)
            best: dict[int, tuple[float, int]] = {}
            for first in range(0, len(starts), 4096):
                some = starts[first:first + 4096]
                low = int(some[0])
                for piece in np.split(some, np.flatnonzero(np.diff(some) > 4096) + 1):
                    low = int(piece[0])
                    shingles = shingle_hashes(words[low:int(piece[-1]) + items.n_words], items.size)
                    window, item = items.candidates(window_fingerprints(shingles, piece - low, items.count))
                    for w, i in zip(window.tolist(), item.tolist(), strict=True):
                        at = int(piece[w]) - low
                        value = weighted_similarity(Counter(shingles[at:at + items.count].tolist()), items.weights[i])
                        if value >= SIMILARITY and value > best.get(i, (0.0, 0))[0]:
                            best[i] = (value, int(piece[w]))
            for i, (value, start) in sorted(best.items()):
                yield items.ids[i], value, start, items.n_words


def find_leaks(records: DataFrame, benchmark: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes",
               item_col: str = "known_compound_id", item_text_col: str = "known_compound_name") -> DataFrame:
    """Records whose evidence notes hold a window that is nearly a benchmark item.

    A window has as many words as the item; both are multisets of five-word shingles (items of fewer
    words: one shingle of all), and a leak has a weighted similarity of at least 0.8. Texts are
    lower-cased (A-Z) and cut at ASCII white space. Returns one row for each pair of record and
    item: ``id_col``, ``item_col``, ``similarity`` (of the best window, the first of equals),
    ``first_word`` (from 0) and ``n_words``.

    Method. Windows with too few benchmark shingles to reach the similarity are passed over (an exact
    bound). The others get a SimHash; an index of eight blocks finds every item of that size within
    23 of 64 bits, since one block then differs in at most two bits; each candidate's similarity is
    computed exactly. At the least similarity the fingerprints differ in 9.7 bits on average with a
    deviation of 2.9, so about one such pair in a million lies outside the radius, fewer at
    higher ones.

    Null and empty texts and items match nothing. Repeated rows give repeated results; a record or item
    without an id is reported with a null. Other columns are ignored; empty tables give no rows.

    How it scales: one pass over the records, nothing is shuffled. The index is broadcast in parts of at
    most ``INDEX_CHARACTERS`` characters of benchmark text (or one longer item), one pass for each.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    schema = arrow_schema(out)
    result = None
    for index in _indexes(benchmark, item_col, item_text_col):
        found = rows.mapInArrow(lambda frames, index=index: batches(schema, _pairs(frames, index.value), 1024), out)
        result = found if result is None else result.unionByName(found)
    return result


def without_leaks(records: DataFrame, benchmark: DataFrame, text_col: str = "evidence_summary_notes",
                  item_col: str = "known_compound_id", item_text_col: str = "known_compound_name") -> DataFrame:
    """The records without a leak in the sense of :func:`find_leaks`, with all their columns; nothing is shuffled."""
    place = records.columns.index(text_col)

    def clean(frames: Iterator[pa.RecordBatch], index: BenchmarkIndex) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for frame in frames:
            leaking = {row for row, *_ in _search(frame.column(place).to_pylist(), index, hashes)}
            yield frame.filter(pa.array([i not in leaking for i in range(frame.num_rows)], pa.bool_()))

    for index in _indexes(benchmark, item_col, item_text_col):
        records = records.mapInArrow(lambda frames, index=index: clean(frames, index.value), records.schema)
    return records


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str) -> list:
    """Broadcast indexes of the benchmark's parts."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts, context = max(1, -(-size // INDEX_CHARACTERS)), benchmark.sparkSession.sparkContext
    return [context.broadcast(BenchmarkIndex([(r.item, r.text) for r in items.where(
        F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).toLocalIterator()])) for part in range(n_parts)]


def _pairs(frames: Iterator[pa.RecordBatch], index: BenchmarkIndex) -> Iterator[tuple]:
    hashes = WordHashes()
    for frame in frames:
        for row, *found in _search(frame.column(1).to_pylist(), index, hashes):
            yield (frame.column(0)[row].as_py(), *found)


def _search(texts: list[str | None], index: BenchmarkIndex, hashes: WordHashes) -> Iterator[tuple]:
    """(place of the text, item, similarity, first word, words) of all leaks."""
    if not index.sized:
        return
    least = {s: min(x.need for x in index.sized if x.size == s) for s in index.shingles}
    for first, last in text_batches(texts, 1 << 20):
        words = [words_of(t) for t in texts[first:last]]
        counts = np.array([len(w) for w in words])
        joined = hashes.of([w for ws in words for w in ws])
        ends = np.cumsum(counts)
        chosen, hits = np.zeros(len(words), bool), {}
        for s in index.shingles:
            hit = np.zeros(len(joined), bool)
            found = index.hits(shingle_hashes(joined, s), s)
            hit[:len(found)] = found
            for back in range(1, s):  # shingles that reach into the next text
                hit[(ends - back)[counts >= back]] = False
            hits[s] = hit
            upto = np.concatenate([[0], np.cumsum(hit)])
            chosen |= upto[ends] - upto[ends - counts] >= least[s]
        for i in np.flatnonzero(chosen).tolist():
            a, b = int(ends[i] - counts[i]), int(ends[i])
            own = {s: hits[s][a:max(b - s + 1, a)] for s in hits}
            for item, value, start, n in index.matches(joined[a:b], own):
                yield first + i, item, value, start, n
