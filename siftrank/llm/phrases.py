"""Collocated phrases of records' notes, counted by double-array tries of Apriori-safe candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftrank.llm.arrays import arrow_schema, bounded_batches, pack, stored, unpack
from siftrank.llm.tries import DoubleArray
from siftrank.operators.joins import dense_positions

#: Bytes of text in one block; a longer text is one block of its own.
BLOCK_BYTES = 8 << 20
#: Hash buckets of one section of the candidate filter, of which one at a time is broadcast (one bit each).
SECTION_BITS = 27
#: Buckets that one task sums, and candidates in the tries that are broadcast together.
RANGE_BITS = 22
SHARD = 1 << 19
#: Partial ranks of a group's best phrases.
SALTS = 64
NO_GROUP = "und"

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- texts as word codes ----------------------------------------------------

def word_codes(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """Distinct lower-cased words of a text and the codes of its words: place in that list plus one, 0 at a break."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [], np.zeros(0, np.int32)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    coded = words.dictionary_encode()
    breaks = np.flatnonzero(kind == 2)
    after = np.unique(np.searchsorted(starts, breaks))
    after = after[(after > 0) & (after < len(starts))]
    return coded.dictionary.to_pylist(), np.insert(coded.indices.to_numpy().astype(np.int32) + 1, after, 0)


_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("group", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())),
    T.StructField("codes", T.BinaryType())])


def _blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut (group, text) rows into blocks of one group each."""
    from pyspark import TaskContext

    schema, part, number = arrow_schema(_BLOCK), TaskContext.get().partitionId(), 0
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for group in sorted(held):
            words, codes = word_codes(b"\n".join(held[group]))
            counts = np.bincount(codes, minlength=len(words) + 1)[1:]
            values = [part << 32 | number, group, int(counts.sum()), [w.decode() for w in words], counts, pack(codes)]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
        held.clear()
        size = 0

    for frame in frames:
        for group, text in zip(frame.column(0).to_pylist(), frame.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if size and size + len(text) > BLOCK_BYTES:
                yield from flush()
            held.setdefault(group, []).append(text)
            size += len(text) + 1
    yield from flush()


def _vocabulary(blocks: DataFrame, min_count: int) -> DataFrame:
    """(id, group, word, f) of the words that occur ``min_count`` times; ids count from one, by group and word."""
    words = blocks.select("group", F.inline(F.arrays_zip("words", "counts"))).toDF("group", "word", "f")
    frequent = stored(words.groupBy("group", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "frequent-words")
    return stored(dense_positions(frequent, [F.asc("group"), F.asc("word")], "id").withColumn("id", F.col("id") + 1), "vocabulary")


_STREAM = "block long, ids binary, codes binary"


def _streams(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Blocks (block, ids, codes) over frequent words alone: sorted ids and their places plus one, 0 elsewhere."""
    places = blocks.select("block", "group", F.posexplode("words").alias("place", "word"))
    named = places.join(vocabulary.select("group", "word", "id"), ["group", "word"]).groupBy("block").agg(
        F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for i in range(frame.num_rows):
                block, codes, places, ids = (frame.column(c)[i] for c in range(4))
                place = places.values.to_numpy(zero_copy_only=False)
                number = ids.values.to_numpy(zero_copy_only=False)
                order = np.argsort(number)
                codes = unpack(codes.as_py(), np.int32)
                rank = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
                rank[place[order] + 1] = np.arange(1, len(order) + 1)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block.as_py()]), "ids": pa.array([pack(number[order].astype(np.int64), rising=True)]),
                    "codes": pa.array([pack(rank[codes])])})

    return stored(blocks.select("block", "codes").join(named, "block").select("block", "codes", "places", "ids")
                  .mapInArrow(encode, _STREAM), "word-streams")


def _stream(ids: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unpack(ids, np.int64, rising=True), unpack(codes, np.int32)


# ---- candidates: hash buckets rule out most phrases that are too rare --------

def _starts(codes: np.ndarray, mask: bytes | None, length: int) -> np.ndarray:
    """Positions at which ``length`` frequent words stand whose two shorter phrases passed their filter."""
    known = codes > 0
    if mask is not None:
        known = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(codes)).astype(bool)
    found = known[:-1] & known[1:] if mask is not None else known[:1 - length] & known[length - 1:]
    return np.flatnonzero(found)


def _hashes(ids: np.ndarray, codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    numbers = np.concatenate([[0], ids]).astype(np.uint64)
    mixed = np.zeros(len(at), np.uint64)
    for word in range(length):
        mixed = (mixed ^ numbers[codes[at + word]]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed * _MIX


def _distinct(ids: np.ndarray, codes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Distinct phrases that start at the positions, a row of word ids each."""
    key = codes[at].astype(np.int64)
    for word in range(1, length):
        _, key = np.unique(key, return_inverse=True)
        key = key << 32 | codes[at + word]
    _, first = np.unique(key, return_index=True)
    return np.stack([ids[codes[at[first] + word] - 1] for word in range(length)], axis=1)


def _bucket_bits(positions: int) -> int:
    """Bits of a bucket number: about two buckets for each position, one section at least."""
    return max(SECTION_BITS, int(2 * positions - 1).bit_length() if positions else 0)


def _sections(streams: DataFrame, length: int, bits: int, min_count: int) -> DataFrame:
    """(range, full): for each range of buckets a bit for every bucket with ``min_count`` positions."""
    sub = min(RANGE_BITS, SECTION_BITS)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for ids, codes, mask in zip(*(frame.column(c).to_pylist() for c in range(3)), strict=True):
                ids, codes = _stream(ids, codes)
                at = _starts(codes, mask, length)
                bucket, n = np.unique(_hashes(ids, codes, at, length) >> np.uint64(64 - bits), return_counts=True)
                part = bucket >> np.uint64(sub)
                cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63)))
                ends = np.append(cuts[1:], len(part))
                low = (bucket & np.uint64((1 << sub) - 1)).astype(np.uint32)
                n = np.minimum(n, min_count).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "range": pa.array(part[cuts].astype(np.int64)),
                    "buckets": pa.array([pack(low[a:b], rising=True) for a, b in zip(cuts, ends)], pa.binary()),
                    "n": pa.array([pack(n[a:b]) for a, b in zip(cuts, ends)], pa.binary())})

    def total(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sums = None, np.zeros(0, np.uint32)

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"range": pa.array([here]), "full": pa.array([np.packbits(sums >= min_count).tobytes()])})

        for frame in frames:
            for part, buckets, n in zip(*(frame.column(c).to_pylist() for c in range(3)), strict=True):
                if part != here:
                    if here is not None:
                        yield full()
                    here, sums = part, np.zeros(1 << sub, np.uint32)
                place = unpack(buckets, np.uint32, rising=True)
                sums[place] = np.minimum(sums[place] + unpack(n, np.uint32), min_count)
        if here is not None:
            yield full()

    counted = streams.select("ids", "codes", "mask").mapInArrow(count, "range long, buckets binary, n binary")
    return stored(counted.repartition("range").sortWithinPartitions("range").mapInArrow(total, "range long, full binary"),
                  f"buckets-{length}")


def _listed(spark: SparkSession, streams: DataFrame, length: int, bits: int, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (w1, ...) and (block, mask) of the positions where they stand.

    The filter's sections are broadcast one after the other, each of 2 ** SECTION_BITS bits.
    """
    sub = min(RANGE_BITS, SECTION_BITS)
    per_section = 1 << SECTION_BITS - sub
    schema = "block long, mask binary, phrases binary"
    found = None
    for section in range(1 << bits - SECTION_BITS):
        filled = np.zeros(1 << SECTION_BITS - 3, np.uint8)
        low = section * per_section
        for row in full.where((F.col("range") >= low) & (F.col("range") < low + per_section)).toLocalIterator():
            start = (row["range"] - low) << sub - 3
            filled[start:start + len(row["full"])] = np.frombuffer(row["full"], np.uint8)
        sent = spark.sparkContext.broadcast(filled)

        def list_phrases(frames: Iterator[pa.RecordBatch], section: int = section, sent=sent) -> Iterator[pa.RecordBatch]:
            filled = sent.value
            for frame in frames:
                for block, ids, codes, mask in zip(*(frame.column(c).to_pylist() for c in range(4)), strict=True):
                    ids, codes = _stream(ids, codes)
                    at = _starts(codes, mask, length)
                    bucket = _hashes(ids, codes, at, length) >> np.uint64(64 - bits)
                    inside = bucket >> np.uint64(SECTION_BITS) == section
                    at, bucket = at[inside], bucket[inside] & np.uint64((1 << SECTION_BITS) - 1)
                    ok = filled[bucket >> np.uint64(3)] >> (np.uint8(7) - (bucket & np.uint64(7)).astype(np.uint8)) & 1
                    at = at[ok > 0]
                    marks = np.zeros(len(codes), bool)
                    marks[at] = True
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([block]), "mask": pa.array([np.packbits(marks).tobytes()]),
                        "phrases": pa.array([pack(_distinct(ids, codes, at, length).reshape(-1))])})

        part = stored(streams.select("block", "ids", "codes", "mask").mapInArrow(list_phrases, schema), f"listed-{length}")
        sent.destroy()
        found = part if found is None else found.unionByName(part)

    def unpacked(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for data in frame.column(0).to_pylist():
                rows = unpack(data, np.int64).reshape(-1, length)
                for start in range(0, len(rows), 100_000):
                    part = rows[start:start + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, w]) for w in range(length)], names=_words(length))

    names = ", ".join(f"{w} long" for w in _words(length))
    candidates = found.select("phrases").mapInArrow(unpacked, names).distinct()
    return candidates, found.select("block", "mask")


def _words(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def _merged_masks(streams: DataFrame, masks: DataFrame) -> DataFrame:
    """Streams with the union of their masks; a block has one mask for each section."""
    def merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            joined = []
            for parts in frame.column(3).to_pylist():
                joined.append(np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in parts]).tobytes())
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(joined, pa.binary())], names=["block", "ids", "codes", "mask"])

    parts = masks.groupBy("block").agg(F.collect_list("mask").alias("masks"))
    met = streams.select("block", "ids", "codes").join(parts, "block")
    return stored(met.mapInArrow(merge, f"{_STREAM}, mask binary"), "masked-streams")


# ---- counting ----------------------------------------------------------------

def _tries(candidates: DataFrame, length: int) -> DataFrame:
    """(shard, size, phrases, alphabet, base, check, accepting): tries of at most ``SHARD`` sorted candidates."""
    words = _words(length)

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def trie() -> pa.RecordBatch:
            rows = np.concatenate(held)
            built = DoubleArray.build(rows)
            values = {"phrases": rows.reshape(-1), "alphabet": built.alphabet, "base": built.base, "check": built.check,
                      "accepting": built.accepting}
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([part << 32 | number]), "size": pa.array([len(rows)]),
                **{k: pa.array([pack(v)], pa.binary()) for k, v in values.items()}})

        for frame in frames:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in frame.columns], axis=1)
            while len(rows):
                taken = rows[:SHARD - size]
                held.append(taken)
                size += len(taken)
                rows = rows[len(taken):]
                if size == SHARD:
                    yield trie()
                    held, size, number = [], 0, number + 1
        if size:
            yield trie()

    parts = max(1, -(-candidates.count() // SHARD))
    sorted_ = candidates.repartitionByRange(parts, *words).sortWithinPartitions(*words)
    return stored(sorted_.mapInArrow(build, "shard long, size long, phrases binary, alphabet binary, base binary, check binary, "
                                            "accepting binary"), f"tries-{length}")


def _counted(spark: SparkSession, streams: DataFrame, candidates: DataFrame, length: int) -> DataFrame:
    """(w1, ..., f): exact counts of the candidates over all streams.

    Tries are broadcast in batches of at most twice ``SHARD`` candidates; each task advances all positions of a block
    through a trie level by level, sums the accepting states of its blocks, and the shards' sums are added up.
    """
    tries = _tries(candidates, length)
    words, sums = _words(length), None
    for batch in _batches_of(tries.select("shard", "size").orderBy("shard").toLocalIterator()):
        rows = tries.where(F.col("shard").between(batch[0], batch[-1])).select(
            "shard", "alphabet", "base", "check", "accepting").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def count(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tries = [(shard, DoubleArray(unpack(alphabet, np.int64), *(unpack(x, np.int32) for x in arrays), length))
                     for shard, alphabet, *arrays in sent.value]
            sums = [np.zeros(len(t.base), np.int64) for _, t in tries]
            for frame in frames:
                for ids, codes in zip(*(frame.column(c).to_pylist() for c in range(2)), strict=True):
                    ids, codes = _stream(ids, codes)
                    for (_, trie), total in zip(tries, sums, strict=True):
                        symbols = np.concatenate([np.zeros(1, np.int32), trie.symbols_of(ids)])[codes]
                        total += np.bincount(trie.accepted(symbols), minlength=len(total))
            for (shard, trie), total in zip(tries, sums, strict=True):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard]), "f": pa.array([pack(total[trie.accepting])], pa.binary())})

        part = stored(streams.select("ids", "codes").mapInArrow(count, "shard long, f binary"), f"counts-{length}")
        sent.destroy()
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return candidates.withColumn("f", F.lit(0).cast("long"))

    def total(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's phrases come first, then its sums."""
        phrases, held = None, None

        def rows() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(held), 100_000):
                part = phrases[start:start + 100_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(part[:, w]) for w in range(length)), pa.array(held[start:start + 100_000])],
                                                 names=[*words, "f"])

        for frame in frames:
            for own, f in zip(*(frame.column(c).to_pylist() for c in range(2)), strict=True):
                if own is not None:
                    if phrases is not None:
                        yield from rows()
                    phrases = unpack(own, np.int64).reshape(-1, length)
                    held = np.zeros(len(phrases), np.int64)
                else:
                    held += unpack(f, np.int64)
        if phrases is not None:
            yield from rows()

    both = tries.select("shard", "phrases").unionByName(sums, True)
    placed = both.repartition("shard").sortWithinPartitions("shard", F.desc_nulls_last("phrases")).select("phrases", "f")
    return placed.mapInArrow(total, ", ".join(f"{c} long" for c in [*words, "f"]))


def _batches_of(sizes: Iterator) -> Iterator[list[int]]:
    held, total = [], 0
    for row in sizes:
        if held and total + row["size"] > 2 * SHARD:
            yield held
            held, total = [], 0
        held.append(row["shard"])
        total += row["size"]
    if held:
        yield held


# ---- the operator ------------------------------------------------------------

def mine_phrases(
    records: DataFrame, text_col: str = "evidence_summary_notes", group_col: str = "evidence_summary_category",
    min_count: int = 10, longest: int = 3, covered: int = 50, most: int = 2000,
) -> DataFrame:
    """The strongest collocated phrases in records' evidence notes, for each group of records.

    Notes are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line breaks, and pieces into words
    at spaces and tabs. Candidates are runs of 2 to ``longest`` words inside pieces that occur ``min_count``
    times in their group, overlaps included. A cut after k words has the score floor(1000000 a a / (l r)) of
    the counts of the phrase (a), its first part (l) and the rest (r); the lowest-scoring cut counts, ties to
    the smallest k. A candidate whose words lie in a longer candidate with at least ``covered`` percent of its
    count is dropped. Returns each group's first ``most`` by score and count (both descending) and phrase:
    ``group_col``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (word occurrences of the group), ``score``.

    Null notes count as empty, a null group as ``und`` (together with records of that group); repeated records
    count each time; groups without candidates have no row, so an empty table gives an empty result. Texts of
    any length are whole; other columns are ignored, whatever their names. ``group_col`` must not be called
    like another result column.

    How it scales: texts are coded once, in blocks. A phrase can only be frequent if its shorter phrases are
    and if its hash bucket is, so buckets are counted first (two for each position) and only phrases that pass
    are listed. They are counted exactly by tries of bounded size, broadcast some at a time; passes over the
    coded blocks grow with candidates / (2 * SHARD) and positions / 2 ** SECTION_BITS. Only words, buckets and
    candidates are shuffled, each summed within tasks or blocks first.
    """
    spark = records.sparkSession
    results = ["rank", "phrase", "a", "l", "r", "n", "score"]
    if group_col.lower() in results:
        raise ValueError(f"the group column must not be called {group_col}")
    bounded_batches(spark)
    texts = records.select(F.coalesce(F.col(group_col).cast("string"), F.lit(NO_GROUP)), F.coalesce(F.col(text_col), F.lit("")))
    blocks = stored(texts.mapInArrow(_blocks, _BLOCK), "word-blocks")
    sizes = blocks.groupBy("group").agg(F.sum("n").alias("n"))
    vocabulary = _vocabulary(blocks, min_count)
    streams = _streams(blocks, vocabulary).withColumn("mask", F.lit(None).cast("binary"))
    bits = _bucket_bits(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    counts = {1: vocabulary.select(F.col("id").alias("w1"), "f")}
    for length in range(2, longest + 1):
        full = _sections(streams, length, bits, min_count)
        candidates, masks = _listed(spark, streams, length, bits, full)
        if length > 2:
            shorter = counts[length - 1].drop("f")
            for shift in (0, 1):
                names = _words(length)[shift:shift + length - 1]
                candidates = candidates.join(shorter.toDF(*names), names, "left_semi").select(*_words(length))
        found = _counted(spark, streams, stored(candidates, f"candidates-{length}"), length)
        counts[length] = stored(found.where(F.col("f") >= min_count), f"phrases-{length}")
        if length < longest:
            streams = _merged_masks(streams, masks)
    return _ranked(counts, vocabulary, sizes, group_col, covered, most)


def _ranked(counts: dict[int, DataFrame], vocabulary: DataFrame, sizes: DataFrame, group_col: str, covered: int, most: int) -> DataFrame:
    """Scores, dropped parts and ranks of all counted phrases."""
    tables = {k: df.select(F.array(*_words(k)).alias("ids"), "f") for k, df in counts.items()}
    every = tables[1]
    for k in range(2, max(tables) + 1):
        every = every.unionByName(tables[k])
    every = stored(every, "phrase-counts")
    phrases = every.where(F.size("ids") > 1)
    size = F.size("ids")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("ids", 1, F.col("k")), "rest": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(every.toDF("first", "l"), "first").join(every.toDF("rest", "r"), "rest")
    whole = "CAST({} AS DECIMAL(38,0))"
    score = F.expr(f"({whole.format(1000000)} * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) "
                   f"div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = cuts.select("ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("ids", "a").agg(
        F.min("cut").alias("cut"))
    longer = phrases.where(size > 2).select("f", "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("f", "ids", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("at"))
    parts = longer.select(F.slice("ids", F.col("at"), F.col("k")).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = stored(scored.join(parts, "ids", "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a"))
    ).select("ids", "a", "cut.score", "cut.l", "cut.r"), "scored-phrases")
    spelled = kept.select("ids", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("id", "group", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.min("group").alias("group"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    named = kept.join(spelled, "ids").select("group", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["group", F.pmod(F.hash("phrase"), F.lit(SALTS))], ["group"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return named.join(sizes, "group").select(
        F.col("group").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
