"""Byte-level BPE in padded number matrices: encoding and decoding of record texts."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, bounded_batches
from siftrank.llm.chunks import ChunkTable, text_batches

#: Upper lengths of the matrices; longer pieces are merged one by one with a heap.
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Ids that are decoded at a time (more, if one record has more).
PART_IDS = 200_000
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token and rank on each line), in rank order."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Rank of the token that two neighbouring tokens make: an open hash table in arrays."""

    def __init__(self, tokens: list[bytes]):
        ranks = {t: i for i, t in enumerate(tokens) if t}
        self.ranks, self.tokens = ranks, tokens
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; the largest number where two tokens make none."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slot_ = slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot_]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slot_[hit]]
            open_ = open_[~hit & (at != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces, each merged on its own; a piece that is a token is that token."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.uint32)
            else:
                bucket = next((b for b in BUCKETS if len(piece) <= b), 0)
                if bucket:
                    by_length.setdefault(bucket, []).append(i)
                else:
                    out[i] = self._by_heap(piece)
        for bucket, places in by_length.items():
            for start in range(0, len(places), 1 << 14):
                some = places[start:start + (1 << 14)]
                for i, ids in zip(some, self._by_matrix([pieces[i] for i in some], bucket), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """One row for each piece; every round merges each row's leftmost pair of the smallest rank."""
        n = len(pieces)
        letters = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        lengths = np.array([len(p) for p in pieces])
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.byte_ids[letters], -1)
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        out = np.full((n, width), -1, np.int32)
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(axis=1)
            some = np.arange(len(rows))
            best = ranks[some, at]
            done = best == _NONE
            if done.any():  # finished rows leave the matrix
                out[rows[done]] = ids[done]
                left = ~done
                rows, ids, ranks, at, best = rows[left], ids[left], ranks[left], at[left], best[left]
                some = np.arange(len(rows))
                if not len(rows):
                    break
            ids[some, at] = best
            moved = columns[:-1] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            after = np.minimum(at + 1, width - 1)
            ranks[some, at] = np.where(at + 1 < width, self._pair_ranks(best, ids[some, after]), _NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._pair_ranks(ids[before, at[before] - 1], best[before])
        counts = (out >= 0).sum(axis=1).tolist()
        out = out.astype(np.uint32)
        return [row[:k] for row, k in zip(out, counts, strict=True)]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = np.full(left.shape, _NONE, np.int32)
        both = (left >= 0) & (right >= 0)
        found[both] = self.rank_of(left[both], right[both])
        return found

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in n log n steps."""
        ids: list[int] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = [self.tokens[i] for i in ids], self.ranks
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(tokens[i] + tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if ids[i] < 0 or following[i] != j or ids[j] < 0 or ranks.get(tokens[i] + tokens[j]) != r:
                continue
            ids[i], tokens[i], ids[j] = r, tokens[i] + tokens[j], -1
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                if (q := ranks.get(tokens[i] + tokens[k])) is not None:
                    heapq.heappush(heap, (q, i, k))
            if (h := before[i]) >= 0 and (q := ranks.get(tokens[h] + tokens[i])) is not None:
                heapq.heappush(heap, (q, h, i))
        return np.array([i for i in ids if i >= 0], np.uint32)


@lru_cache(maxsize=1)
def _pairs(tokens: tuple[bytes, ...]) -> PairTable:
    return PairTable(list(tokens))


def _table(tokens: tuple[bytes, ...], pattern: str) -> ChunkTable:
    """A chunk table for one task; only the pair table stays with the worker."""
    pairs, split = _pairs(tokens), regex.compile(pattern)

    def encode_many(chunks: list[str]) -> list[np.ndarray]:
        cut = [split.findall(c) for c in chunks]
        distinct = list(dict.fromkeys(p for pieces in cut for p in pieces))
        ids = dict(zip(distinct, pairs.encode_pieces([p.encode("utf-8", "surrogatepass") for p in distinct]), strict=True))
        none = np.zeros(0, np.uint32)
        return [ids[c[0]] if len(c) == 1 else np.concatenate([ids[p] for p in c]) if c else none for c in cut]

    return ChunkTable(encode_many)


def encode_text(records: DataFrame, ranks_path: str, pattern: str, id_col: str = "molecule_id",
                text_col: str = "evidence_summary_notes") -> DataFrame:
    """Token ids of every record's evidence notes by a byte-level BPE rank file.

    Each match of ``pattern`` is encoded separately, without special tokens. Returns ``id_col`` and
    ``token_ids`` (array of int). Distinct pieces are encoded together: pieces of similar length form
    a padded matrix in which every row merges its leftmost pair of the smallest rank in each round,
    pairs are looked up in an array hash table, and finished rows leave the matrix. Pieces of more
    than 128 bytes are merged with a heap. The vocabulary file is read by the driver and broadcast;
    its size is that of the file, whatever the data.

    Null and empty texts give an empty array. Repeated rows stay. Ids are passed on as they are.
    """
    bounded_batches(records.sparkSession)
    shared = records.sparkSession.sparkContext.broadcast(tuple(read_ranks(ranks_path)))
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    schema = arrow_schema(out)

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value, pattern)
        for frame in frames:
            texts = frame.column(1).to_pylist()
            for first, last in text_batches(texts):
                ids, counts = table.encode(texts[first:last])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    frame.column(0).slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))).cast(schema.field(1).type),
                ], schema=schema)

    return rows.mapInArrow(encode, out)


def decode_tokens(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Add ``decoded``, the bytes that the token ids stand for; null or empty ids give no bytes.

    An id that the vocabulary lacks raises an error.
    """
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(read_ranks(ranks_path)))
    rest = encoded.drop("decoded")
    out = T.StructType([*rest.schema.fields, T.StructField("decoded", T.BinaryType())])
    schema, place = arrow_schema(out), rest.columns.index(ids_col)

    def decode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        letters = np.frombuffer(b"".join(tokens), np.uint8)
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(lengths) - lengths
        for whole in frames:
            counts = pa.compute.fill_null(pa.compute.list_value_length(whole.column(place)), 0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(np.cumsum(counts, dtype=np.int64) // PART_IDS)) + 1
            for first, last in zip([0, *cut.tolist()], [*cut.tolist(), len(counts)], strict=True):
                frame, n_ids = whole.slice(first, last - first), counts[first:last]
                ids = frame.column(place).flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
                    raise ValueError(f"token ids must lie in 0..{len(tokens) - 1}")
                n = lengths[ids]
                ends = np.cumsum(n)
                data = letters[np.repeat(starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
                sums = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_ids)])].tolist()
                decoded = [data[a:b] for a, b in zip(sums[:-1], sums[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(decoded, pa.binary())], schema=schema)

    return rest.mapInArrow(decode, out)
