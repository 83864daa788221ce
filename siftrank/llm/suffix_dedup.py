"""Removal of long repeated byte strings by merging sorted suffix runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, batches, block_rows, bounded_batches, pack, stored, unpack
from siftrank.llm.exact_dedup import fresh_name
from siftrank.llm.suffix_merge import decode_front, front_code, merge_runs

WIDTH = 200
#: Length of the byte strings whose smallest hash in a window marks its anchor.
GRAM = 64
SEGMENT = 1 << 19
RANGE_ROWS = 40_000
_RUN = "range int, block long, shared binary, lengths binary, rests binary, left_lengths binary, lefts binary, copies binary, places binary"
_RUN_ARROW = pa.schema([("range", pa.int32()), ("block", pa.int64())] + [
    (c, pa.binary()) for c in ("shared", "lengths", "rests", "left_lengths", "lefts", "copies", "places")])
_SPAN = "block long, kind int, starts binary, ends binary"
_SPAN_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("starts", pa.binary()), ("ends", pa.binary())])


def remove_repeats(records: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes",
                   width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove every byte of the evidence notes that lies in a ``width``-byte string found anywhere else too.

    Texts are their UTF-8 bytes; strings never cross records, overlaps count, and all strings
    are judged on the input. Returns one row for each record: ``id_col``, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the other bytes, in order).

    Method. Every window of ``width`` bytes has an anchor, the place of the smallest hash among its
    ``gram``-byte strings; equal windows have equal anchors. Suffixes are sorted at anchors only,
    and only at those whose gram occurs twice or more (no other window can repeat). Each block
    sorts its suffixes, sends them front-coded to ranges of the suffix order, and each range
    merges its runs with a loser tree that carries common-prefix lengths. The merged order with
    those lengths says which suffixes agree to the right of an anchor and how far; the bytes to
    the left are compared within such a group, which settles each window around the anchor
    exactly. Grams are compared as bytes in the merge, so a hash collision only costs time.

    Null texts count as empty; texts shorter than ``width`` lose nothing; repeated rows are copies
    of each other and lose all their bytes from ``width`` on. A record without an id is treated
    like any other. Other columns are ignored; an empty table gives an empty result.

    How it scales: equal neighbourhoods of a block are sent once with all their places, so a passage
    in a third of all records sends one suffix for each block. All suffixes with one gram meet in
    one range.
    """
    spark = records.sparkSession
    bounded_batches(spark)
    rows = records.select(F.col(id_col).alias("id"), F.lit(False).alias("flag"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    blocks = stored(_blocks(rows, id_type, width, gram), "repeat-blocks")
    n_blocks = blocks.count()
    places = blocks.select("block", "hashes", "prefixes", "counts").mapInArrow(
        _anchor_rows, "hash long, prefix long, n int, block long")
    often = places.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    repeated = stored(places.join(often, "hash").select("hash", "prefix", "block"), "repeat-anchors")
    n_repeated = repeated.count()
    n_ranges = max(8, n_repeated // RANGE_ROWS)
    cuts = _cuts(repeated, n_ranges) if n_repeated else []
    by_block = repeated.groupBy("block").agg(F.collect_list("hash").alias("wanted"))
    runs = blocks.select("block", "lengths", "payload", "anchors", "anchor_hashes").join(by_block, "block").mapInArrow(
        lambda frames: batches(_RUN_ARROW, _runs(frames, cuts, width, gram), 16), _RUN)
    spans = runs.repartition(n_ranges, "range").sortWithinPartitions("range").mapInArrow(
        lambda frames: batches(_SPAN_ARROW, _merge(frames, width, gram)), _SPAN)
    texts = blocks.select("block", F.lit(1).alias("kind"), "ids", "lengths", "payload")
    parts = max(n_blocks // 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = T.StructType([
        T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ])
    schema = arrow_schema(out)
    return spans.unionByName(texts, allowMissingColumns=True).repartition(parts, "block").sortWithinPartitions(
        "block", "kind").mapInArrow(lambda frames: batches(schema, _cut_out(frames), 512), out)


def without_repeats(records: DataFrame, text_col: str = "evidence_summary_notes", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The records with what :func:`remove_repeats` keeps of their texts, and all other columns as they were.

    Bytes of a character that was cut at the border of a removed run go too; null texts stay null.
    """
    rest = [c for c in records.columns if c != text_col]
    was_null, record = fresh_name(records, "_was_null"), fresh_name(records, "_record")
    whole = F.struct(*rest, F.col(text_col).isNull().alias(was_null))
    kept = remove_repeats(records.select(whole.alias(record), text_col), record, text_col, width, gram)

    @F.pandas_udf(T.StringType())
    def decoded(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    found = kept.select(record, F.when(~F.col(record)[was_null], decoded("kept")).alias("text"))
    return found.select(*(F.col("text").alias(c) if c == text_col else F.col(record)[c].alias(c) for c in records.columns))


# ---- anchors ----------------------------------------------------------------

@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram``-byte string, the same wherever the string stands."""
    up, down = _powers(SEGMENT + 4096)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h | np.uint64(1)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbouring values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors_of(data: np.ndarray, lengths: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie within one text."""
    n, grams = len(data), width - gram + 1
    ends = np.repeat(np.cumsum(lengths, dtype=np.int64), lengths)
    found, hashes = [], []
    for start in range(0, max(n - width + 1, 0), SEGMENT):
        windows = min(SEGMENT, n - width + 1 - start)
        h = _gram_hashes(data[start:start + windows + width - 1], gram)
        least = _sliding(h, grams, np.minimum)
        starts = np.arange(start, start + windows)
        least = np.where(starts + width <= ends[starts], least, np.uint64(0))
        edge = np.zeros(grams - 1, np.uint64)
        is_anchor = _sliding(np.concatenate([edge, least, edge]), grams, np.maximum) == h
        at = np.flatnonzero(is_anchor)
        found.append(at + start)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(found), return_index=True)
    return places, np.concatenate(hashes)[first]


def _blocks(rows: DataFrame, id_type: T.DataType, width: int, gram: int) -> DataFrame:
    binary = ("lengths", "payload", "anchors", "anchor_hashes", "hashes", "prefixes", "counts")
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type))]
                       + [T.StructField(c, T.BinaryType()) for c in binary])
    schema = arrow_schema(out)

    def make(ids: list, _: list, texts: list) -> tuple:
        lengths = np.array([len(t) for t in texts], np.uint32)
        data = b"".join(texts)
        array = np.frombuffer(data, np.uint8)
        places, hashes = anchors_of(array, lengths, width, gram)
        distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        prefix = np.zeros(len(first), np.uint64)
        for byte in range(7):
            prefix = prefix << np.uint64(8) | array[places[first] + byte].astype(np.uint64)
        return (ids, pack(lengths), zstandard.ZstdCompressor(level=1).compress(data), pack(places.astype(np.uint32), True),
                pack(hashes), pack(distinct, True), pack(prefix), pack(counts.astype(np.uint32)))

    return rows.mapInArrow(lambda frames: batches(schema, block_rows(frames, make), 1), out)


def _anchor_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for row in frame.to_pylist():
            hashes = unpack(row["hashes"], np.uint64, True)
            yield pa.RecordBatch.from_pydict({
                "hash": pa.array(hashes.view(np.int64)),
                "prefix": pa.array(unpack(row["prefixes"], np.uint64).view(np.int64)),
                "n": pa.array(unpack(row["counts"], np.uint32).view(np.int32)),
                "block": pa.array(np.full(len(hashes), row["block"], np.int64))})


def _cuts(repeated: DataFrame, n_ranges: int) -> list[int]:
    """Borders of the ranges by the first seven bytes, from a sketch of their distribution."""
    shares = [i / n_ranges for i in range(1, n_ranges)]
    found = repeated.agg(F.percentile_approx("prefix", shares, 20 * n_ranges)).first()[0]
    return sorted(set(found or []))


# ---- runs -------------------------------------------------------------------

def _runs(frames: Iterator[pa.RecordBatch], cuts: list[int], width: int, gram: int) -> Iterator[tuple]:
    for frame in frames:
        for row in frame.to_pylist():
            lengths = unpack(row["lengths"], np.uint32)
            data = zstandard.ZstdDecompressor().decompress(row["payload"])
            places = unpack(row["anchors"], np.uint32, True).astype(np.int64)
            wanted = np.array(row["wanted"], np.int64).view(np.uint64)
            places = places[np.isin(unpack(row["anchor_hashes"], np.uint64), wanted)]
            ends = np.cumsum(lengths, dtype=np.int64)
            text = np.searchsorted(ends, places, "right")
            lo = np.maximum((ends - lengths)[text], places - (width - gram)).tolist()
            hi = np.minimum(ends[text], places + width).tolist()
            around: dict[tuple[bytes, bytes], list[int]] = {}
            for a, b, e in zip(places.tolist(), lo, hi, strict=True):
                around.setdefault((data[a:e], data[b:a][::-1]), []).append(a)
            ordered = sorted(around)
            first = np.searchsorted(
                np.array(cuts, np.int64), [int.from_bytes(right[:7]) for right, _ in ordered], "right")
            for r in np.unique(first).tolist():
                of = ordered[np.searchsorted(first, r):np.searchsorted(first, r, "right")]
                shared, rest, rests = front_code([right for right, _ in of])
                lefts = [left for _, left in of]
                at = [around[x] for x in of]
                yield (r, row["block"], pack(shared), pack(rest), pack(np.frombuffer(rests, np.uint8)),
                       pack(np.array([len(x) for x in lefts], np.uint16)),
                       pack(np.frombuffer(b"".join(lefts), np.uint8)),
                       pack(np.array([len(x) for x in at], np.uint32)), pack(np.array(sum(at, []), np.uint32)))


def _merge(frames: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[tuple]:
    held: list[dict] = []
    for frame in frames:
        for row in frame.to_pylist():
            if held and held[0]["range"] != row["range"]:
                yield from _merge_range(held, width, gram)
                held = []
            held.append(row)
    if held:
        yield from _merge_range(held, width, gram)


def _merge_range(rows: list[dict], width: int, gram: int) -> Iterator[tuple]:
    """Covered spans of each block, from all runs of one range."""
    runs, lefts, copies, places = [], [], [], []
    for row in rows:
        shared = unpack(row["shared"], np.uint16)
        strings = decode_front(shared, unpack(row["lengths"], np.uint16), unpack(row["rests"], np.uint8).tobytes())
        runs.append((strings, shared.tolist()))
        joined, cut = unpack(row["lefts"], np.uint8).tobytes(), np.cumsum(unpack(row["left_lengths"], np.uint16), dtype=int)
        lefts.append([joined[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist(), strict=False)])
        copies.append(unpack(row["copies"], np.uint32).astype(np.int64))
        places.append(unpack(row["places"], np.uint32).astype(np.int64))
    run, at, shared = merge_runs(runs)
    first = np.cumsum([0, *(len(s) for s, _ in runs)])
    member = first[run] + at
    n_copies = np.concatenate(copies)[member]
    group = np.cumsum(shared < gram)
    alone = np.bincount(group)[group] == 1
    chosen = np.flatnonzero(~alone | (n_copies > 1))
    if not len(chosen):
        return
    right_len = np.array([len(s) for s, _ in runs for s in s])[member][chosen]
    left = [x for part in lefts for x in part]
    left = [left[i] for i in member[chosen]]
    offsets = _repeated_offsets(group[chosen], np.where(shared < gram, 0, shared)[chosen], right_len, left,
                                n_copies[chosen] > 1, width, gram)
    which, o_from, o_to = offsets
    # Windows that start o_to .. o_from bytes before the anchor cover one span.
    rec = chosen[which]
    span_run, span_copies = run[rec], n_copies[rec]
    place_start = np.concatenate([np.cumsum(c) - c for c in copies])[member[rec]]
    place_first = np.cumsum([0, *(len(p) for p in places)])[span_run] + place_start
    spread = np.repeat(np.arange(len(rec)), span_copies)
    inside = np.arange(len(spread)) - np.repeat(np.cumsum(span_copies) - span_copies, span_copies)
    anchor = np.concatenate(places)[place_first[spread] + inside]
    starts, ends, of = anchor - o_to[spread], anchor - o_from[spread] + width, span_run[spread]
    for r in np.unique(of).tolist():
        s, e = joined_spans(starts[of == r], ends[of == r])
        yield rows[r]["block"], 0, pack(s.astype(np.uint32), True), pack((e - s).astype(np.uint32))


def joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as disjoint rising spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def _repeated_offsets(group: np.ndarray, shared: np.ndarray, right_len: np.ndarray, left: list[bytes],
                      copied: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window offsets that repeat: (record, smallest offset, largest offset).

    Records stand in the order of their suffixes. A window that starts o bytes before its anchor
    repeats if another record shares width - o bytes to the right and o bytes to the left. Sharing
    a length to the right is being in one stretch of the suffix order without a smaller prefix;
    sharing a length to the left is the same in the order of the reversed bytes to the left.
    """
    n, most = len(group), width - gram
    left_len = np.array([len(x) for x in left])
    padded = np.array([g.to_bytes(8) + x for g, x in zip(group.tolist(), left, strict=True)], dtype=f"S{8 + most}")
    order = np.argsort(padded, kind="stable")
    letters = padded.view(np.uint8).reshape(n, -1)[order]
    shared_left = np.zeros(n, np.int64)
    if n > 1:
        differs = letters[1:] != letters[:-1]
        where = np.where(differs.any(axis=1), differs.argmax(axis=1) - 8, most)
        shared_left[1:] = np.minimum(where, np.minimum(left_len[order][1:], left_len[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    again = np.zeros((n, most + 2), bool)
    new_group = np.ones(n, bool)
    new_group[1:] = group[1:] != group[:-1]
    for o in range(most + 1):
        valid = np.flatnonzero((right_len >= width - o) & (left_len >= o))
        if not len(valid):
            continue
        to_right = np.cumsum(new_group | (shared < width - o))
        to_left = np.cumsum(shared_left < o)[rank]
        key = to_right[valid] * (n + 1) + to_left[valid]
        by_key = np.argsort(key)
        same = key[by_key][1:] == key[by_key][:-1]
        hit = np.zeros(len(valid), bool)
        hit[1:] |= same
        hit[:-1] |= same
        again[valid[by_key[hit]], o] = True
        again[valid[copied[valid]], o] = True
    edges = np.diff(again.astype(np.int8), axis=1, prepend=0)
    which, o_from = np.nonzero(edges == 1)
    _, o_end = np.nonzero(edges == -1)
    return which, o_from, o_end - 1


# ---- result -----------------------------------------------------------------

def _cut_out(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    for frame in frames:
        for row in frame.to_pylist():
            if row["kind"] == 0:
                s = unpack(row["starts"], np.uint32, True).astype(np.int64)
                spans.append((s, s + unpack(row["ends"], np.uint32)))
                continue
            lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
            data = zstandard.ZstdDecompressor().decompress(row["payload"])
            change = np.zeros(len(data) + 1, np.int64)
            for s, e in spans:
                np.add.at(change, s, 1)
                np.add.at(change, e, -1)
            spans = []
            gone = np.cumsum(change[:-1]) > 0
            array, end = np.frombuffer(data, np.uint8), 0
            for one, n in zip(row["ids"], lengths.tolist(), strict=True):
                start, end = end, end + n
                mask = gone[start:end]
                removed = int(mask.sum())
                n_spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed else 0
                yield one, n, removed, n_spans, array[start:end][~mask].tobytes() if removed else data[start:end]
