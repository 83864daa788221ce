"""Blocks of sets, and exact searches of all blocks of probes against all blocks of targets.

A block is one row that holds many sets. Two stored tables of blocks are crossed and each cell of the cross is compared
inside a task, so no pair of sets is written unless it is a result: what is stored and shuffled grows with the sets alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.session import columnar

#: Bytes of blocks in a file, which one task holds while others pass by.
FILE_BYTES = 64 << 20
#: Bytes of cells that a Python worker gets at a time (more, if one cell has more).
BATCH_BYTES = 4 << 20
#: Shared features of a block of sets of any width (more, if one set has more).
BLOCK_FEATURES = 2_000_000
#: Blocks in a file: at 14 bytes a feature they stay below ``FILE_BYTES``.
BLOCKS_OF_FILE = FILE_BYTES // (14 * BLOCK_FEATURES)
#: Shared features of a cell that are counted at a time.
HITS = 1_000_000
#: Results that a task holds back, because a better one may follow.
MOST_HELD = 1_000_000
#: Sets whose features are dealt together.
SETS_AT_ONCE = 4_096
#: Largest ratio of sizes in a block of vectors of a fixed width.
BAND_RATIO = 1.2
SLACK = 1e-9
#: The lowest bits of a set's key say how many bits its size has.
SIZE_BITS = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def block_files(spark: SparkSession, size: int) -> int:
    """Files for blocks of ``size`` bytes in total: enough for all task slots, none larger than a task can hold."""
    return max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def cut_blocks(frames: Iterator[pa.RecordBatch], keys: int, most: int, heaviest: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of blocks of sorted rows: equal in the first ``keys`` columns, ``most`` rows and ``heaviest`` in all ``n`` at most."""
    number, held, here, count, weight = TaskContext.get().partitionId() << 32, [], None, 0, 0
    for frame in frames:
        start = 0
        rows = zip(*(frame.column(i).to_pylist() for i in range(keys)), strict=True)
        for at, (key, n) in enumerate(zip(rows, frame.column("n").to_pylist(), strict=True)):
            if count and (key != here or count >= most or heaviest is not None and weight + n > heaviest):
                held.append(frame.slice(start, at - start))
                yield number, pa.Table.from_batches(held)
                number, held, start, count, weight = number + 1, [], at, 0, 0
            here, count, weight = key, count + 1, weight + n
        held.append(frame.slice(start))
    if count:
        yield number, pa.Table.from_batches(held)


def crossed(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every block of one table beside every block of the other, their columns named ``p_`` and ``t_``."""
    spark, key = probes.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))  # ten thousand cells in one batch would fill a worker's memory
    return probes.toDF(*[f"p_{c}" for c in probes.columns]).crossJoin(targets.toDF(*[f"t_{c}" for c in targets.columns]))


class BestPartners:
    """Best partners of a task's probes. Those that are beaten while they are held do not go out."""

    def __init__(self) -> None:
        self.bounds: dict[int, np.ndarray] = {}
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, block: int, row: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Take the best target of one block for the probes at ``row`` of a block."""
        bound = self.bounds[block]
        good = (value > 0) & (value >= bound[row] - SLACK)
        row, a, b, value = row[good], a[good], b[good], value[good]
        bound[row] = np.maximum(bound[row], value)
        self.held.append((block, row, a, b, value))
        self.rows += len(row)
        if self.rows > MOST_HELD:
            yield from self.flushed()

    def flushed(self) -> Iterator[pa.RecordBatch]:
        for block, row, a, b, value in self.held:
            good = value >= self.bounds[block][row] - SLACK
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[good]), "b": pa.array(b[good]), "similarity": pa.array(value[good])})
        self.held, self.rows = [], 0


_ROWS = ("kind boolean, probe boolean, target boolean, chunk int, key long, set_id long, n int, rows binary, keys binary, tokens binary")
_BLOCK = "block long, probe boolean, target boolean, chunk int, ids binary, sizes binary, tokens binary, counts binary, owners binary"


def _dealt(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, positions of it) of every place that occurs."""
    order = np.argsort(place)
    starts = np.flatnonzero(np.diff(place[order], prepend=-1))
    for start, end in zip(starts, [*starts[1:], len(order)], strict=False):
        yield int(place[order[start]]), order[start:end]


def _by_key(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run that is equal in the first ``keys`` columns."""
    held, here = [], None
    for frame in frames:
        if not frame.num_rows:
            continue
        at = list(zip(*(frame.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i, key in enumerate(at):
            if key != here:
                if i > start:
                    held.append(frame.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, here, start = [], key, i
        held.append(frame.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _joined_rows(rows: pa.Table, dtype) -> np.ndarray:
    """Places in the joined ``keys`` of packed rows, each of which counts its own."""
    def lengths(name: str, kind) -> np.ndarray:
        return np.array([len(x) for x in rows.column(name).to_pylist()], np.int64) // np.dtype(kind).itemsize

    sizes = lengths("keys", np.int64)
    return _joined(rows.column("rows"), dtype) + np.repeat(np.cumsum(sizes) - sizes, lengths("rows", dtype))


def _postings(sets: DataFrame, buckets: int) -> DataFrame:
    """Packed features (bucket, sides, rows, keys, tokens) of ``sets(key, features, probe, target)``: a row for each bucket of features and task batch."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, SETS_AT_ONCE):
                part = frame.slice(start, SETS_AT_ONCE)
                lists = part.column(0)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists), dtype=np.uint16), np.diff(lists.offsets.to_numpy()))
                keys = part.column(1).to_numpy()
                sides = np.where(part.column(2).to_numpy(zero_copy_only=False), 1, 0) + np.where(part.column(3).to_numpy(zero_copy_only=False), 2, 0)
                found = []
                for bucket, at in _dealt(((flat.view(np.uint64) * _FACTOR) >> np.uint64(33)).astype(np.int64) % buckets):
                    used, own = np.unique(row[at], return_inverse=True)
                    found.append((bucket, *(x.tobytes() for x in (sides[used].astype(np.uint8), own.astype(np.uint16), keys[used], flat[at]))))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)],
                                                     names=["bucket", "sides", "rows", "keys", "tokens"])

    kinds = [pa.int32(), *[pa.binary()] * 4]
    return sets.select("features", "key", "probe", "target").mapInArrow(
        cut, "bucket int, sides binary, rows binary, keys binary, tokens binary")


def _shared_postings(postings: DataFrame, chunks: list[int]) -> DataFrame:
    """The features of sorted ``postings`` that a probe and another set, a target, have: numbered, packed by chunks of sets."""

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(frames, 1):
            bucket, own = rows.column("bucket")[0].as_py(), _joined_rows(rows, np.uint16)
            side, key = _joined(rows.column("sides"), np.uint8)[own], _joined(rows.column("keys"), np.int64)[own]
            tokens, token = np.unique(_joined(rows.column("tokens"), np.int64), return_inverse=True)
            used = np.flatnonzero((np.bincount(token, minlength=len(tokens)) > 1)[token])
            token, key, side = token[used], key[used], side[used]
            # Rows of one key are copies of one set.
            order = np.lexsort((key, token))
            order = order[np.flatnonzero((np.diff(token[order], prepend=-1) != 0) | (np.diff(key[order], prepend=0) != 0))]
            token, key, side = token[order], key[order], side[order]
            probes = np.bincount(token, side & 1, len(tokens))
            targets = np.bincount(token, side >> 1, len(tokens))
            good = ((probes > 0) & (targets > 0) & (np.bincount(token, minlength=len(tokens)) > 1))[token]
            token, key, side = token[good] + (bucket << 32), key[good], side[good]
            found = []
            for place, at in _dealt(_chunk(key, chunks) * 4 + side):
                used, row = np.unique(key[at], return_inverse=True)
                found.append((False, bool(place & 1), bool(place & 2), place >> 2, None, None, None,
                              *(x.tobytes() for x in (row.astype(np.int32), used, token[at]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)],
                                                 names=[c.split()[0] for c in _ROWS.split(", ")])

    kinds = [pa.bool_()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 3
    return postings.mapInArrow(keep, _ROWS)


def _chunk(key: np.ndarray, chunks: list[int]) -> np.ndarray:
    """Chunk of each set: any of those of its size."""
    of, before = np.array(chunks), np.cumsum([0, *chunks[:-1]])
    step = key & ((1 << SIZE_BITS) - 1)
    return (key.view(np.uint64) >> np.uint64(20)).astype(np.int64) % of[step] + before[step]


def _chunk_column(chunks: list[int]) -> Column:
    """The same in SQL."""
    step = F.col("key").bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")
    of, before = (F.element_at(F.array(*[F.lit(int(x)) for x in values]), step + 1) for values in (chunks, np.cumsum([0, *chunks[:-1]])))
    return (F.pmod(F.shiftrightunsigned("key", 20), of) + before).cast("int")


def feature_blocks(sets: DataFrame, most: int) -> DataFrame:
    """Stored blocks of ``sets(set_id, n, features, probe, target, tie)``, each in the order of ``tie`` and with an index of its features.

    Features that no probe shares with a target cannot count; they are left out, but not from the sizes. To tell them,
    features are shuffled once by value, in packed postings. A chunk is any share of the sets of like size (to a factor
    of 2); its sets make a block or a few.
    """

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in _by_key(frames, 3):
            named = rows.filter(rows.column("kind"))
            if not named.num_rows:
                continue
            key = named.column("key").to_numpy()
            sort = np.argsort(key, kind="stable")
            parts = rows.filter(pc.invert(rows.column("kind")))
            token, own = _joined(parts.column("tokens"), np.int64), _joined_rows(parts, np.int32)
            row = sort[np.searchsorted(key[sort], _joined(parts.column("keys"), np.int64))][own]
            count = np.bincount(row, minlength=len(key))
            order = np.argsort(row, kind="stable")
            row, token, ends = row[order], token[order], np.cumsum(count)
            start = 0
            while start < len(key):
                done = ends[start - 1] if start else 0
                end = max(start + 1, min(start + most, int(np.searchsorted(ends, done + BLOCK_FEATURES, "right"))))
                part = slice(done, ends[end - 1])
                tokens, at, counts = np.unique(token[part], return_inverse=True, return_counts=True)
                owners = (row[part] - start).astype(np.uint16)[np.argsort(at, kind="stable")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([named.column("probe")[0].as_py()]), pa.array([named.column("target")[0].as_py()]),
                     pa.array([named.column("chunk")[0].as_py()], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (
                         named.column("set_id").to_numpy()[start:end], named.column("n").to_numpy()[start:end].astype(np.int32),
                         tokens, counts.astype(np.int32), owners))],
                    names=["block", "probe", "target", "chunk", "ids", "sizes", "tokens", "counts", "owners"])
                number, start = number + 1, end

    spark = sets.sparkSession
    slots = spark.sparkContext.defaultParallelism
    step = F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))), F.lit((1 << SIZE_BITS) - 1)).cast("bigint")
    sizes = {r["step"]: r for r in sets.groupBy(step.alias("step")).agg(F.sum("n").alias("size"), F.count("*").alias("sets")).collect()}
    size, number = (sum(r[c] for r in sizes.values()) for c in ("size", "sets"))
    most = min(most, max(1, -(-number // slots)))
    chunks = [max(1, -(-sizes[i]["sets"] // most), -(-sizes[i]["size"] // (4 * BLOCK_FEATURES))) if i in sizes else 1 for i in range(1 << SIZE_BITS)]
    buckets = max(slots, -(-size // (BLOCK_FEATURES // 2)))
    features = F.col("features").cast("array<bigint>")
    key = F.shiftleft(F.xxhash64(F.col("set_id"), features, "probe", "target"), SIZE_BITS).bitwiseOR(step)
    # Rows of one number may hold unlike features, and are sets of their own then.
    rows = sets.select(
        features.alias("features"), key.alias("key"), "probe", "target",
        F.col("set_id").cast("long").alias("set_id"), F.col("n").cast("int").alias("n"), "tie")
    postings = _postings(rows, buckets)
    # Only a table that may stand in fewer parts than there are tasks gets a number of parts of its own.
    if size * 14 <= FILE_BYTES * slots:
        postings = postings.repartition(block_files(spark, size * 14), "bucket")
    else:
        postings = postings.repartition("bucket")
    shared = columnar(_shared_postings(postings.sortWithinPartitions("bucket"), chunks), "shared-features")
    none = F.lit(None).cast("binary")
    named = rows.select(
        F.lit(True).alias("kind"), "probe", "target", _chunk_column(chunks).alias("chunk"), "key", "set_id", "n", none.alias("rows"), none.alias("keys"),
        none.alias("tokens"), "tie")
    kind = named.schema["tie"].dataType
    both = named.unionByName(shared.withColumn("tie", F.lit(None).cast(kind)))
    order = ["probe", "target", "chunk"]
    both = both.repartition(max(slots, sum(chunks)), *order).sortWithinPartitions(*order, "kind", "tie")
    return columnar(both.select(*order, "kind", "key", "set_id", "n", "rows", "keys", "tokens").mapInArrow(pack, _BLOCK), "feature-blocks",
                    BLOCKS_OF_FILE)


class _Index:
    """The sets of a block of a crossed row."""

    def __init__(self, frame: pa.RecordBatch, row: int, side: str):
        def array(name: str, dtype) -> np.ndarray:
            return np.frombuffer(frame.column(side + name)[row].as_buffer(), dtype)

        self.ids, self.sizes = array("ids", np.int64), array("sizes", np.int32)
        self.tokens, self.counts, self.owners = array("tokens", np.int64), array("counts", np.int32), array("owners", np.uint16)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts


class _Probes(_Index):
    """The same by sets: the place in ``tokens`` of every feature of every set."""

    def __init__(self, frame: pa.RecordBatch, row: int):
        super().__init__(frame, row, "p_")
        order = np.argsort(self.owners, kind="stable")
        self.places = np.repeat(np.arange(len(self.tokens), dtype=np.int32), self.counts)[order]
        self.rows = self.owners[order].astype(np.int32)
        self.features = np.bincount(self.rows, minlength=len(self.sizes))


def _places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def _spans(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of items of ``most`` weight (more, if one item has more)."""
    total, start = np.cumsum(weights), 0
    while start < len(weights):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield slice(start, end)
        start = end


class _Held:
    """Whether sets of a block have features: a table for features of more than ``cold`` sets (``together`` at most), sorted postings for others."""

    def __init__(self, t: _Index, cold: int, together: int):
        self.width = len(t.sizes)
        often = np.flatnonzero(t.counts > cold)
        if len(often) > together:
            often = often[np.argsort(-t.counts[often], kind="stable")[:together]]
        self.line = np.full(len(t.tokens), -1, np.int32)
        self.line[often] = np.arange(len(often))
        self.table = np.zeros((len(often) + 1, self.width), bool)
        count = t.counts[often]
        self.table[np.repeat(np.arange(len(often)), count), t.owners[_places(t.starts[often], count)]] = True
        self.codes = np.repeat(np.arange(len(t.tokens), dtype=np.int64) * self.width, t.counts) + t.owners

    def has(self, token: np.ndarray, row: np.ndarray) -> np.ndarray:
        line = self.line[token]
        out = self.table[line, row]
        rare = np.flatnonzero(line < 0)
        code = token[rare].astype(np.int64) * self.width + row[rare]
        out[rare] = self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code
        return out


def _cell(p: _Probes, t: _Index, bound: np.ndarray, cold: int, together: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, target, similarity) of the best target for every probe that may have one at its ``bound``, the first of equal ones.

    A target at the bound shares so many features with the probe that it has one of the probe's rarest here: all others
    together are too few. Only postings of these are read, and what they bring is compared whole if it can reach the bound.
    """
    # A target at the bound shares at least this many, since it is no smaller than the smallest one.
    total = p.sizes + float(t.sizes.min())
    need = np.maximum(np.ceil(bound / (1 + bound) * total - SLACK * total).astype(np.int64), 1)
    if not (np.minimum(p.features, t.sizes.max()) >= need).any():
        return
    at = np.minimum(np.searchsorted(t.tokens, p.tokens), len(t.tokens) - 1)
    there = t.tokens[at] == p.tokens
    mine = np.flatnonzero(there[p.places])
    rows, token = p.rows[mine], at[p.places[mine]]
    met = np.bincount(rows, minlength=len(p.sizes))
    some = (np.minimum(met, t.sizes.max()) >= need)[rows]
    if not some.any():
        return
    rows, token = rows[some], token[some]
    uses = t.counts[token]
    order = np.argsort(rows.astype(np.int64) << 32 | uses)
    rows, token, uses = rows[order], token[order], uses[order]
    met = np.bincount(rows, minlength=len(p.sizes))
    first = np.cumsum(met) - met
    read = np.where(met > 0, met - need + 1, 0)
    held = None
    work = np.bincount(rows, np.where(np.arange(len(rows)) - first[rows] < read[rows], uses, 0), len(p.sizes))
    chosen = np.flatnonzero(work > 0)
    for span in _spans(work[chosen].astype(np.int64), HITS):
        some = chosen[span]
        mine = _places(first[some], read[some])
        times = uses[mine]
        code = np.repeat(rows[mine].astype(np.int64) << 16, times) | t.owners[_places(t.starts[token[mine]], times)]
        code.sort()
        start = np.flatnonzero(np.diff(code, prepend=-1))
        row, target, shared = code[start] >> 16, code[start] & 0xFFFF, np.diff(start, append=len(code))
        total, left, done, step = p.sizes[row].astype(np.int64) + t.sizes[target], (met - read)[row], 0, 2
        while True:
            most = shared + np.maximum(left - done, 0)
            good = np.flatnonzero((most >= (bound[row] - SLACK) * (total - most)) & (p.ids[row] != t.ids[target]))
            row, target, shared, total, left = (x[good] for x in (row, target, shared, total, left))
            if not (left > done).any():
                break
            # The probe's other features, rarest first: a few that are missing rule most targets out.
            held = held or _Held(t, cold, together)
            asked = np.clip(left - done, 0, step)
            for part in _spans(asked, HITS):
                ask = _places((first + read)[row[part]] + done, asked[part])
                pair = np.repeat(np.arange(part.stop - part.start), asked[part])
                shared[part] += np.bincount(pair[held.has(token[ask], target[part][pair])], minlength=part.stop - part.start)
            done, step = done + step, step * 2
        if len(row):
            similar = shared / (total - shared)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            top = np.repeat(np.maximum.reduceat(similar, begin), np.diff(begin, append=len(row)))
            best = np.flatnonzero(similar == top)
            best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]  # the first of equal ones has the smallest tie
            yield row[best], target[best], similar[best]


def feature_partners(sets: DataFrame, most: int, cold: int, together: int) -> DataFrame:
    """(a, b, similarity): partners of every probe set, the best target (smallest ``tie`` of equal ones) among them.

    ``sets(set_id, n, features, probe, target, tie)`` with features of any kind. Exact: the best partner so far, first one
    among a chunk of the targets, rules out pairs that share too few features, of which only the rarest are looked up. What is stored
    grows with the features. ``most`` sets make a block; the postings of features of more than ``cold`` of them are also
    held as a table, ``together`` of them at most.
    """
    blocks = feature_blocks(sets, min(most, 1 << 16))
    probes = blocks.where("probe").drop("probe", "target")
    targets = blocks.where("target").drop("probe", "target")
    kept = probes.columns

    def indexed(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, _Probes]]:
        number, p = None, None
        for frame in frames:
            for row in range(frame.num_rows):
                if frame.column("p_block")[row].as_py() != number:
                    number, p = frame.column("p_block")[row].as_py(), _Probes(frame, row)
                yield frame, row, p

    def measure(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, row, p in indexed(frames):
            bound = np.zeros(len(p.ids))
            if frame.column("t_block")[row].is_valid and len(p.tokens):
                t = _Index(frame, row, "t_")
                for at, _, value in _cell(p, t, bound, cold, together) if len(t.tokens) else ():
                    bound[at] = value
            yield pa.RecordBatch.from_arrays(
                [*(frame.column(f"p_{c}").slice(row, 1) for c in kept), pa.array([bound.tobytes()], pa.binary())], names=[*kept, "bound"])

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestPartners()
        for frame, row, p in indexed(frames):
            block = frame.column("p_block")[row].as_py()
            if block not in best.bounds:
                best.bounds[block] = np.frombuffer(frame.column("p_bound")[row].as_buffer(), float).copy()
            t = _Index(frame, row, "t_")
            if len(p.tokens) and len(t.tokens):
                for at, target, value in _cell(p, t, best.bounds[block], cold, together):
                    yield from best.add(block, at, p.ids[at], t.ids[target], value)
        yield from best.flushed()

    one = targets.groupBy("chunk").agg(F.min("block").alias("block"))
    near = targets.join(one, ["chunk", "block"], "left_semi")
    near = near.toDF(*[f"t_{c}" for c in near.columns])
    met = probes.toDF(*[f"p_{c}" for c in probes.columns]).join(near, F.col("p_chunk") == F.col("t_chunk"), "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema.fields)
    bounded = columnar(met.mapInArrow(measure, f"{schema}, bound binary"), "bounded-blocks", BLOCKS_OF_FILE)
    return crossed(bounded, targets.drop("block", "chunk")).mapInArrow(search, "a long, b long, similarity double")
