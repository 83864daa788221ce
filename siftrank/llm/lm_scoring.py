"""Language-model scores of record texts by context-tree weighting."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm import context_tree as tree
from siftrank.llm.arrays import (
    Places, arrow_schema, batches, block_rows, bounded_batches, pack, remainder_of_id, stored, unpack,
)

END = b"\n"
#: Bytes of text in a block: larger ones send fewer grams for each byte of text.
BLOCK_BYTES = 12 << 20
#: Grams of so many bytes of text are handled at a time.
PART_BYTES = 2 << 20
_SHARE = "range int, kind int, block long, grams binary, gram_counts binary, words binary, word_counts binary"
_SHARE_ARROW = pa.schema([
    ("range", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()),
    ("gram_counts", pa.binary()), ("words", pa.binary()), ("word_counts", pa.binary()),
])
_SUM_ARROW = _SHARE_ARROW.append(pa.field("tokens", pa.int64())).append(pa.field("kinds", pa.int64()))
_TOP = ["top_node", "top_own", "top_rest", "top_alone"]
_ANSWER = "block long, kind int, range int, values binary, word_values binary"
_ANSWER_ARROW = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("values", pa.binary()),
    ("word_values", pa.binary()),
])


def score_text(records: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes",
               held_out: Column | None = None, depth: int = tree.DEPTH) -> DataFrame:
    """Log10 probability of every record's evidence notes under a context-tree model of the others' notes.

    A text is lower-cased (A-Z) and cut into words at ASCII white space; the model codes the
    words joined by single blanks and one end byte, each byte as eight binary choices whose
    Krichevsky-Trofimov estimates are mixed over all context lengths up to ``depth`` bytes by
    their weighted probabilities. The model learns from the records where ``held_out`` is false
    (default: crc32 of the id modulo 10 is not 0) and is the same for all records.

    Returns one row for each record: ``id_col``, ``held_out``, ``n_tokens`` (words and the end),
    ``n_known`` (those seen in training), ``train_tokens``, ``base_score`` (log10 probability under
    smoothed token counts), ``score``, ``n_bytes`` (coded bytes) and ``bits_per_byte``.

    Null texts count as empty (only the end is coded). Records without an id are scored but never
    learned from. Repeated rows are learned and returned as often as they occur. Other columns are
    ignored. An empty table gives an empty result.

    How it scales: texts are stored once as blocks of whole texts; each block sends its distinct
    grams and words once to the range of keys that owns them, and gets their values back, so
    neither a model nor a count table is ever in one place. Ranges are cut by the hash of the
    nearest three context bytes; the levels above are joined in Spark. A range's deeper levels are
    built for ``context_tree.MOST_GRAMS`` grams at a time; a context of more is cut at its next byte,
    with what the levels above it add carried down.
    """
    spark = records.sparkSession
    bounded_batches(spark)
    held = F.coalesce(remainder_of_id(id_col, 10) == 0, F.lit(True)) if held_out is None else held_out
    rows = records.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    blocks = stored(_blocks(rows, id_type, depth), "lm-blocks")
    n_blocks = blocks.count()
    n_ranges = max(8, n_blocks // 4)

    def sent(counted: bool) -> DataFrame:
        return blocks.select("block", "grams", "gram_counts", "words", "word_counts").mapInArrow(
            lambda frames: _requests(frames, n_ranges, depth, counted), _SHARE)

    counted = stored(sent(True).repartition(n_ranges, "range").mapInArrow(_sum_ranges, _SHARE + ", tokens long, kinds long"),
                     "lm-counts", clean=True)
    totals = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    top = _top_levels(counted, depth)
    model = counted.drop("tokens", "kinds").join(top, "range", "left")
    ask = sent(False).withColumns({c: F.lit(None) for c in _TOP})
    answers = model.unionByName(ask).repartition(n_ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(
        lambda frames: _answers(frames, depth), _ANSWER)
    texts = blocks.select("block", F.lit(1).alias("kind"), "ids", "held", "lengths", "payload", "grams")
    parts = max(n_blocks // 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    joined = answers.unionByName(texts, allowMissingColumns=True).repartition(parts, "block")
    out = T.StructType([
        T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("bits_per_byte", T.DoubleType()),
    ])
    schema, tokens, kinds = arrow_schema(out), int(totals[0]), int(totals[1])
    return joined.sortWithinPartitions("block", "kind").mapInArrow(
        lambda frames: _score_blocks(frames, schema, n_ranges, depth, tokens, kinds), out)


# ---- blocks -----------------------------------------------------------------

def _blocks(rows: DataFrame, id_type: T.DataType, depth: int) -> DataFrame:
    out = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.BinaryType()),
        T.StructField("payload", T.BinaryType()), T.StructField("grams", T.BinaryType()),
        T.StructField("gram_counts", T.BinaryType()), T.StructField("words", T.BinaryType()),
        T.StructField("word_counts", T.BinaryType()),
    ])
    schema = arrow_schema(out)

    def make(ids: list, held: list, texts: list) -> tuple:
        lines = [b" ".join(t.lower().split()) + END for t in texts]
        lengths = np.array([len(x) for x in lines], np.uint32)
        both = {True: [], False: []}
        for first, last in _parts(lengths):
            keys, learned = _gram_places(lines[first:last], depth), ~np.array(held[first:last], bool)
            learned = np.repeat(learned, lengths[first:last])
            for chosen in both:
                both[chosen].append(np.unique(keys[learned == chosen], return_counts=True))
        grams, counts = _summed(both[True])
        more = np.setdiff1d(_summed(both[False])[0], grams, assume_unique=True)
        place = np.argsort(np.concatenate([grams, more]), kind="stable")
        hashes, word_counts = _word_counts(lines, held)
        return (ids, held, pack(lengths), zstandard.ZstdCompressor(level=1).compress(b"".join(lines)),
                pack(np.concatenate([grams, more])[place], True),
                pack(np.concatenate([counts, np.zeros(len(more), np.uint64)])[place]), pack(hashes, True), pack(word_counts))

    return rows.mapInArrow(lambda frames: batches(schema, block_rows(frames, make, BLOCK_BYTES), 1), out)


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last text of parts of a block, of about ``PART_BYTES`` each."""
    cut = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // PART_BYTES)) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), len(lengths)], strict=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) pairs with the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order].astype(np.uint64)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], np.add.reduceat(counts, np.flatnonzero(new)) if len(keys) else counts


def _gram_places(lines: list[bytes], depth: int) -> np.ndarray:
    """The gram of every byte of the texts, none of which reaches into another text."""
    pad = tree.PAD * depth
    keys = tree.gram_keys(np.frombuffer(pad + pad.join(lines), np.uint8), depth)
    inside = np.ones(len(keys), bool)
    ends = np.cumsum([len(x) + depth for x in lines])[:-1]
    for back in range(1, depth + 1):
        inside[ends - back] = False
    return keys[inside]


def _word_counts(lines: list[bytes], held: list) -> tuple[np.ndarray, np.ndarray]:
    numbers: dict[bytes, int] = {}
    totals: list[int] = []
    for line, out in zip(lines, held, strict=True):
        for word in [*line.split(), END]:
            place = numbers.setdefault(word, len(totals))
            if place == len(totals):
                totals.append(0)
            if not out:
                totals[place] += 1
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array(totals, np.uint64)[order]


# ---- counts by range --------------------------------------------------------

def _range_of(values: np.ndarray, n_ranges: int) -> np.ndarray:
    mixed = (values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(n_ranges)).astype(np.int32)


def _requests(frames: Iterator[pa.RecordBatch], n_ranges: int, depth: int, counted: bool) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for frame in frames:
            for row in frame.to_pylist():
                grams, words = unpack(row["grams"], np.uint64, True), unpack(row["words"], np.uint64, True)
                counts, word_counts = unpack(row["gram_counts"], np.uint64), unpack(row["word_counts"], np.uint64)
                to, word_to = _range_of(tree.unit_of(grams, depth), n_ranges), _range_of(words, n_ranges)
                order, word_order = np.argsort(to, kind="stable"), np.argsort(word_to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(n_ranges + 1))
                word_cut = np.searchsorted(word_to[word_order], np.arange(n_ranges + 1))
                for r in range(n_ranges):
                    at, word_at = order[cut[r]:cut[r + 1]], word_order[word_cut[r]:word_cut[r + 1]]
                    if len(at) or len(word_at):
                        yield (r, 1, row["block"], pack(grams[at], True), pack(counts[at]) if counted else None,
                               pack(words[word_at], True), pack(word_counts[word_at]) if counted else None)

    return batches(_SHARE_ARROW, rows())


class _Sum:
    """Adds up (keys, counts) arrays without holding more than a few million of them."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > 2_000_000 and len(self.keys) > 1:
            self.total()
            # Merge again only after as much has come as is kept.
            self.held = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, counts = _summed(list(zip(self.keys, self.counts, strict=True)))
            self.keys, self.counts = [keys], [counts]
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _sum_ranges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, words = defaultdict(_Sum), defaultdict(_Sum)
    for frame in frames:
        for row in frame.to_pylist():
            grams[row["range"]].add(unpack(row["grams"], np.uint64, True), unpack(row["gram_counts"], np.uint64))
            words[row["range"]].add(unpack(row["words"], np.uint64, True), unpack(row["word_counts"], np.uint64))
    def rows() -> Iterator[tuple]:
        for r in grams:
            (keys, counts), (hashes, totals) = grams[r].total(), words[r].total()
            yield (r, 0, None, pack(keys, True), pack(counts), pack(hashes, True), pack(totals),
                   int(totals.sum()), int((totals > 0).sum()))

    return batches(_SUM_ARROW, rows(), 1)


# ---- the levels above the ranges --------------------------------------------

def _unit_nodes(frames: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the unit level, also those that were only asked for."""
    for frame in frames:
        for row in frame.to_pylist():
            keys, counts = unpack(row["grams"], np.uint64, True), unpack(row["gram_counts"], np.uint64)
            if not len(keys):
                continue
            seen = counts > 0
            level, asked = tree.unit_level(keys[seen], counts[seen], depth), tree.nodes_of(keys, depth)
            zeros, ones, weighted = (np.zeros(len(asked)) for _ in range(3))
            at = np.searchsorted(asked, level.keys)
            zeros[at], ones[at], weighted[at] = level.zeros, level.ones, level.weighted
            yield pa.RecordBatch.from_pydict({
                "range": pa.array(np.full(len(asked), row["range"], np.int32)), "node": pa.array(asked.astype(np.int64)),
                "zeros": pa.array(zeros), "ones": pa.array(ones), "weighted": pa.array(weighted)})


def _log_gamma(x: Column) -> Column:
    y, product = x + 8.0, F.lit(1.0)
    for step in range(8):
        product = product * (x + float(step))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) - F.log(product)


def _mixed(nodes: DataFrame, at: str) -> DataFrame:
    """Parents of ``nodes``: counts, weighted probability, own share and estimate."""
    up = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
    sums = nodes.groupBy(up.alias("node")).agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    kt = (_log_gamma(F.col("zeros") + 0.5) + _log_gamma(F.col("ones") + 0.5)
          - _log_gamma(F.col("zeros") + F.col("ones") + 1.0) - 1.1447298858494002)
    larger, less = F.greatest("kt", "below"), F.least("kt", "below")
    return sums.withColumn("kt", kt).withColumn(
        "weighted", F.lit(float(np.log(0.5))) + larger + F.log1p(F.exp(less - larger))
    ).select(
        "node", "zeros", "ones", "weighted",
        F.exp(F.least(F.lit(float(np.log(0.5))) + F.col("kt") - F.col("weighted"), F.lit(0.0))).alias(f"s{at}"),
        ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)).alias(f"e{at}"),
    )


def _top_levels(counted: DataFrame, depth: int) -> DataFrame:
    """For each unit node: what the levels above it add, and what they leave to the deeper ones."""
    units = stored(counted.mapInArrow(lambda frames: _unit_nodes(frames, depth),
                                      "range int, node long, zeros double, ones double, weighted double"), "lm-units")
    two = stored(_mixed(units, "2"), "lm-level2", clean=True)
    one = stored(_mixed(two, "1"), "lm-level1", clean=True)
    root = _mixed(one, "0")

    def up(column: str) -> Column:
        return F.shiftleft(F.shiftright(column, 16), 8).bitwiseOR(F.col(column).bitwiseAND(255))

    def renamed(level: DataFrame, at: str) -> DataFrame:
        return level.select(F.col("node").alias(f"n{at}"), f"s{at}", f"e{at}",
                            (F.col("zeros") + F.col("ones") > 0).alias(f"seen{at}"))

    path = (
        units.select("range", "node", up("node").alias("n2")).join(renamed(two, "2"), "n2")
        .withColumn("n1", up("n2")).join(renamed(one, "1"), "n1")
        .withColumn("n0", up("n1")).join(renamed(root, "0"), "n0")
    )
    s, e = [F.col(f"s{i}") for i in range(3)], [F.col(f"e{i}") for i in range(3)]
    to_one = s[0] * e[0] + (1 - s[0]) * e[1]
    to_two = s[0] * e[0] + (1 - s[0]) * (s[1] * e[1] + (1 - s[1]) * e[2])
    alone = F.when(F.col("seen2"), to_two).when(F.col("seen1"), to_one).when(F.col("seen0"), e[0]).otherwise(0.5)
    own = s[0] * e[0] + (1 - s[0]) * (s[1] * e[1] + (1 - s[1]) * s[2] * e[2])
    rest = (1 - s[0]) * (1 - s[1]) * (1 - s[2])
    packed = path.select("range", F.struct("node", own.alias("own"), rest.alias("rest"), alone.alias("alone")).alias("t"))
    return packed.groupBy("range").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "range", F.col("t.node").alias("top_node"), F.col("t.own").alias("top_own"),
        F.col("t.rest").alias("top_rest"), F.col("t.alone").alias("top_alone"))


# ---- answers and scores -----------------------------------------------------

def _answers(frames: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        keys = values = words = counts = None
        for frame in frames:
            for i, row in enumerate(frame.drop_columns(_TOP).to_pylist()):
                grams, hashes = unpack(row["grams"], np.uint64, True), unpack(row["words"], np.uint64, True)
                if row["kind"] == 0:
                    keys, words, counts = grams, hashes, unpack(row["word_counts"], np.uint64)
                    top = [(pa.array([], pa.float64()) if (c := frame.column(name)[i].values) is None else c).to_numpy() for name in _TOP]
                    values = tree.log10_in_parts(keys, unpack(row["gram_counts"], np.uint64),
                                                 (top[0].astype(np.uint64), *(c.astype(np.float64) for c in top[1:])), depth)
                else:
                    yield (row["block"], 0, row["range"], pack(values[np.searchsorted(keys, grams)]),
                           pack(counts[np.searchsorted(words, hashes)]))

    return batches(_ANSWER_ARROW, rows())


def _score_blocks(frames: Iterator[pa.RecordBatch], schema: pa.Schema, n_ranges: int, depth: int, tokens: int,
                  kinds: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        got: dict[int, tuple] = {}
        for frame in frames:
            for row in frame.to_pylist():
                if row["kind"] == 0:
                    got[row["range"]] = (row["values"], row["word_values"])
                else:
                    yield from _score_block(row, got, n_ranges, depth, tokens, kinds)
                    got = {}

    return batches(schema, rows(), 4096)


def _score_block(row: dict, got: dict, n_ranges: int, depth: int, tokens: int, kinds: int) -> Iterator[tuple]:
    lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["payload"])
    ends = np.cumsum(lengths)
    lines = [data[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    grams = unpack(row["grams"], np.uint64, True)
    values = np.zeros(len(grams), np.float32)
    to = _range_of(tree.unit_of(grams, depth), n_ranges)
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    texts = [[number(w, len(numbers)) for w in line.split()] + [number(END, len(numbers))] for line in lines]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
    word_order = np.argsort(hashes)
    word_to, sorted_counts = _range_of(hashes[word_order], n_ranges), np.zeros(len(hashes), np.uint64)
    order, word_by = np.argsort(to, kind="stable"), np.argsort(word_to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n_ranges + 1))
    word_cut = np.searchsorted(word_to[word_by], np.arange(n_ranges + 1))
    for r, (v, w) in got.items():
        values[order[cut[r]:cut[r + 1]]] = unpack(v, np.float32)
        sorted_counts[word_by[word_cut[r]:word_cut[r + 1]]] = unpack(w, np.uint64)
    counts = np.zeros(len(hashes), np.float64)
    counts[word_order] = sorted_counts
    base = np.log10((counts + 0.1) / (tokens + 0.1 * (kinds + 1)))
    known = counts > 0
    places, at_bytes = Places(grams), []
    for first, last in _parts(lengths):
        start = (ends - lengths)[first:last]
        scores = values[places.of(_gram_places(lines[first:last], depth))].astype(np.float64)
        at_bytes.extend(np.add.reduceat(scores, start - start[0]).tolist())
    for i, (one, held) in enumerate(zip(row["ids"], row["held"], strict=True)):
        own = np.array(texts[i])
        n, score = int(lengths[i]), float(at_bytes[i])
        yield (one, held, len(own), int(known[own].sum()), tokens, float(base[own].sum()), score, n,
               -score / np.log10(2) / n)
