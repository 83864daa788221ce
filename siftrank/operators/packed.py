"""Nearest partners among feature vectors of a fixed width, over packed words.

1 - Tanimoto is a metric. Targets are dealt to their nearest pivot and cut into blocks by popcount;
a block is searched for a probe only if neither the triangle inequality over the pivot nor the ratio
of popcounts shows that everything in it is worse than the best partner found so far. Blocks meet as whole
rows (:mod:`siftrank.operators.blocks`), so no vector is stored once for each block that it is searched in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftrank.operators.blocks import BAND_RATIO, SLACK, BestPartners, block_files, crossed, cut_blocks
from siftrank.session import columnar

#: Widths up to this many bits are packed.
PACKED_BITS = 8_192
#: Pivots at most, all of which every task holds: 1 MB at 8,192 bits; and blocks' worth of targets for each. With more pivots
#: blocks would hold few vectors, and the cells of the cross would cost more than the vectors in them.
MOST_PIVOTS = 1_024
PIVOT_BLOCKS = 32
#: Vectors of a block, and probes that are compared with a block at a time.
BLOCK = 2_048
PROBES = 1_024
#: Bits of a whole number that a 32-bit float holds exactly, and the fewest pairs of vectors that are worth a matrix product.
EXACT_BITS = 24
PRODUCT_PAIRS = 4_096


def packed_width(sets: DataFrame) -> int | None:
    """Bits of a vector (a multiple of 64) that holds all features; None if they are no small positions."""
    low, high = sets.agg(F.min(F.array_min("features")), F.max(F.array_max("features"))).first()
    if high is None or low < 0 or high >= PACKED_BITS:
        return None
    return (int(high) // 64 + 1) * 64


def _words(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors of a column as a matrix of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), width // 64)


def pack_sets(sets: DataFrame, width: int) -> DataFrame:
    """``features`` (positions below ``width``) as ``bits``; other columns stay."""
    kept = [f for f in sets.schema.fields if f.name != "features"]

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, 2_048):
                part = frame.slice(start, 2_048)
                lists = part.column(0)
                at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                bits = np.zeros((len(lists), width), np.uint8)
                bits[rows, at] = 1
                packed = np.packbits(bits, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in packed], pa.binary()), *part.columns[1:]], names=["bits", *[f.name for f in kept]])

    schema = "bits binary" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return sets.select("features", *[f.name for f in kept]).mapInArrow(pack, schema)


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common bits of every row of one matrix with every row of the other."""
    if len(left) * len(right) >= PRODUCT_PAIRS:
        most = min(int(np.bitwise_count(x).sum(axis=1).max()) for x in (left, right))
        bits = max(1, most.bit_length())
        if EXACT_BITS // bits > 1:
            return _products(left, right, bits)
    out = np.empty((len(left), len(right)), np.int32)
    turned = np.ascontiguousarray(right.T)
    for i, row in enumerate(left):
        np.bitwise_count(turned & row[:, None]).sum(axis=0, dtype=np.int32, out=out[i])
    return out


def _unpacked(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.float32)


def _products(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The same, all below 2 ** ``bits``, by a product that counts several rows of ``right`` at once in the digits of one number."""
    digits = EXACT_BITS // bits
    each = -(-len(right) // digits)
    joined = _unpacked(right[:each])
    for i in range(1, digits):
        part = _unpacked(right[i * each:(i + 1) * each])
        part *= np.float32(1 << bits * i)
        joined[:len(part)] += part
    found = (_unpacked(left) @ joined.T).astype(np.int32)
    out = np.empty((len(left), each * digits), np.int32)
    for i in range(digits):
        np.bitwise_and(found >> bits * i, (1 << bits) - 1, out=out[:, i * each:(i + 1) * each])
    return out[:, :len(right)]


def _similarity(shared: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return shared / (left[:, None] + right[None, :] - shared)


def _tanimoto(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _similarity(_shared(left, right), *(np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (left, right)))


def _nearest_pivot(packed: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """Add ``pivot`` and ``distance`` of the nearest pivot."""
    names = packed.columns

    def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            far = 1 - _tanimoto(_words(frame.column(0), width), pivots)
            best = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*frame.columns, pa.array(best.astype(np.int32)), pa.array(far[np.arange(len(best)), best])],
                names=[*names, "pivot", "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields)
    return packed.mapInArrow(assign, f"{schema}, pivot int, distance double")


def _blocked(targets: DataFrame) -> DataFrame:
    """Add ``band`` and ``sub``: a pivot's targets cut by popcount, equal popcounts cut by id where they are too many.

    A band's popcounts differ by ``BAND_RATIO`` at most, so that their ratio to a probe's rules out whole bands.
    """
    counts = targets.groupBy("pivot", "n").agg(F.count("*").alias("_size")).withColumn(
        "_step", F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / np.log(BAND_RATIO)).cast("int"))
    below = F.sum("_size").over(Window.partitionBy("pivot", "_step").orderBy("n")) - F.col("_size")
    band = F.col("_step").cast("bigint") * (1 << 32) + F.floor(below / BLOCK)
    cuts = counts.select("pivot", "n", band.alias("band"), F.ceil(F.col("_size") / BLOCK).cast("int").alias("_subs"))
    return targets.join(cuts, ["pivot", "n"]).withColumn(
        "sub", F.pmod(F.xxhash64("set_id"), F.col("_subs")).cast("int")).drop("_subs")


def _may_hold(far: np.ndarray, n: np.ndarray, bound: np.ndarray, low_n, high_n, low_d, high_d) -> np.ndarray:
    """Whether a block may hold a partner as good as the bound of a probe, ``far`` from the block's pivot and with ``n`` bits."""
    ratio = np.minimum(np.minimum(n / low_n, high_n / n), 1.0)  # the popcounts allow no more
    least = np.maximum(np.maximum(far - high_d, low_d - far), 0)
    return np.minimum(ratio, 1 - least) >= bound - SLACK


_BLOCK = ("block long, probe boolean, target boolean, pivot int, step int, low_n int, high_n int, low_d double, high_d double, "
          "ids binary, bits binary")


def _pack_blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vectors (probe, target, pivot, band, sub, n, distance, set_id, bits) as blocks."""
    for number, rows in cut_blocks(frames, 5, BLOCK):
        n, distance = rows.column("n").to_numpy(), rows.column("distance").to_numpy()
        one = rows.slice(0, 1).to_pylist()[0]
        yield pa.RecordBatch.from_pylist([{
            "block": number, "probe": one["probe"], "target": one["target"], "pivot": one["pivot"], "step": one["band"] >> 32,
            "low_n": int(n.min()), "high_n": int(n.max()), "low_d": float(distance.min()), "high_d": float(distance.max()),
            "ids": rows.column("set_id").to_numpy().astype(np.int64).tobytes(), "bits": b"".join(rows.column("bits").to_pylist())}],
            schema=_BLOCK_ARROW)


_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("probe", pa.bool_()), ("target", pa.bool_()), ("pivot", pa.int32()), ("step", pa.int32()),
    ("low_n", pa.int32()), ("high_n", pa.int32()), ("low_d", pa.float64()), ("high_d", pa.float64()), ("ids", pa.binary()),
    ("bits", pa.binary())])


class _Block:
    """The vectors of a block of a crossed row, and its bounds."""

    def __init__(self, frame: pa.RecordBatch, row: int, side: str, width: int):
        def value(name: str):
            return frame.column(side + name)[row].as_py()

        self.number, self.pivot = value("block"), value("pivot")
        self.limits = [value(name) for name in ("low_n", "high_n", "low_d", "high_d")]
        self.ids = np.frombuffer(frame.column(side + "ids")[row].as_buffer(), np.int64)
        self.words = np.frombuffer(frame.column(side + "bits")[row].as_buffer(), np.uint64).reshape(-1, width // 64)


def _compared(p: _Block, t: _Block, pivots: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of probes, their similarities to all targets) where a target of the block may be a partner at the bound."""
    far = 1 - _tanimoto(p.words, pivots[t.pivot:t.pivot + 1])[:, 0]
    sizes, others = (np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (p.words, t.words))
    wanted = np.flatnonzero(_may_hold(far, sizes, bound, *t.limits))
    low = t.limits[0]
    for start in range(0, len(wanted), PROBES):
        part = wanted[start:start + PROBES]
        shared = _shared(p.words[part], t.words)
        # The most that a probe shares with a target tells whether one can be at the bound.
        most = shared.max(axis=1)
        good = np.flatnonzero(most >= (bound[part] - SLACK) * (sizes[part] + low - most))
        if not len(good):
            continue
        part = part[good]
        similar = _similarity(shared[good], sizes[part], others)
        own = np.flatnonzero(np.isin(p.ids[part], t.ids))
        if len(own):
            similar[own] = np.where(p.ids[part[own]][:, None] == t.ids[None, :], -1.0, similar[own])
        yield part, similar


class _Blocks:
    """Packed vectors in stored blocks around pivots, which are targets."""

    def __init__(self, sets: DataFrame, width: int):
        """``sets(bits, set_id, n, tie, probe, target)``, at least one of them a target; all are both where no flags are given."""
        self.width = width
        if "target" not in sets.columns:
            sets = sets.withColumns({"probe": F.lit(True), "target": F.lit(True)})
        size = sets.agg(F.count("*"), F.count_if("target")).first()
        chosen = sets.where("target").orderBy(F.xxhash64("set_id"), "set_id").limit(
            min(MOST_PIVOTS, size[1] // (PIVOT_BLOCKS * BLOCK) + 1)).select("bits").collect()
        self.pivots = np.frombuffer(b"".join(bytes(r["bits"]) for r in chosen), np.uint64).reshape(len(chosen), width // 64)
        blocked = _blocked(_nearest_pivot(sets.select("bits", "set_id", "n", "tie", "probe", "target"), self.pivots, width))
        keys, files = ["probe", "target", "pivot", "band", "sub"], block_files(sets.sparkSession, size[0] * width // 8)
        rows = blocked.repartition(files, *keys).sortWithinPartitions(*keys, "tie").select(*keys, "n", "distance", "set_id", "bits")
        self.table = columnar(rows.mapInArrow(_pack_blocks, _BLOCK), "vector-blocks")

    @property
    def bounds(self) -> np.ndarray:
        """A row (pivot, least n, most n, least distance, most distance) for each block of targets."""
        found = self.table.where("target").select("pivot", "low_n", "high_n", "low_d", "high_d").collect()
        return np.array([tuple(r) for r in found], float)

    def routes(self, probes: DataFrame) -> DataFrame:
        """(set_id, block) for each block that ``probes(bits, set_id, bound)`` have to be compared with: a measure of the bounds."""
        pivots, width, blocks = self.pivots, self.width, self.bounds
        pivot = blocks[:, 0].astype(np.int64)

        def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for start in range(0, frame.num_rows, PROBES):
                    part = frame.slice(start, PROBES)
                    words = _words(part.column(0), width)
                    far, n = 1 - _tanimoto(words, pivots), np.bitwise_count(words).sum(axis=1)[:, None]
                    bound = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                    row, block = np.nonzero(_may_hold(far[:, pivot], n, bound, *blocks.T[1:]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(pa.array(row)), pa.array(block.astype(np.int32))], names=["set_id", "block"])

        return probes.select("bits", "set_id", "bound").mapInArrow(route, "set_id long, block int")

    def bounded_probes(self) -> DataFrame:
        """Stored blocks of probes, with each probe's best similarity in one block of its own pivot and popcount as ``bound``."""
        pivots, width = self.pivots, self.width
        probes, places = self.table.where("probe").drop("probe", "target"), ["pivot", "step"]
        at = ["block", "low_n", "high_n", "low_d", "high_d", "ids", "bits"]
        one = self.table.where("target").groupBy(*places).agg(F.min("block").alias("block"))
        near = self.table.where("target").join(one, [*places, "block"], "left_semi").select(
            F.col("pivot").alias("t_pivot"), F.col("step").alias("t_step"), *[F.col(c).alias(f"t_{c}") for c in at])
        met = probes.toDF(*[f"p_{c}" for c in probes.columns]).join(
            near, (F.col("p_pivot") == F.col("t_pivot")) & (F.col("p_step") == F.col("t_step")), "left")
        kept = probes.columns

        def bound(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                found = []
                for row in range(frame.num_rows):
                    p = _Block(frame, row, "p_", width)
                    best = np.zeros(len(p.ids))
                    if frame.column("t_block")[row].is_valid:
                        for part, similar in _compared(p, _Block(frame, row, "t_", width), pivots, best):
                            best[part] = np.maximum(similar.max(axis=1), 0.0)
                    found.append(best.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(frame.column(f"p_{c}") for c in kept), pa.array(found, pa.binary())], names=[*kept, "bound"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema.fields)
        return columnar(met.mapInArrow(bound, f"{schema}, bound binary"), "bounded-probes")


def _packed(sets: DataFrame, width: int, name: str) -> DataFrame:
    columns = [c for c in sets.columns if c not in ("set_id", "features")]
    return columnar(pack_sets(sets.select("features", F.col("set_id").cast("long").alias("set_id"), *columns), width), name)


def _no_pairs(sets: DataFrame) -> DataFrame:
    return sets.sparkSession.createDataFrame([], "a long, b long, similarity double")


def packed_partners(sets: DataFrame, width: int) -> DataFrame:
    """(a, b, similarity): partners of every probe set, the best target (smallest ``tie`` of equal ones) among them.

    ``sets(set_id, n, features, probe, target, tie)`` with features below ``width``. Exact: a block is passed over only
    if its bounds rule it out. What every task holds are the pivots and one file of blocks.
    """
    packed = _packed(sets.select("set_id", "n", "features", "probe", "target", "tie"), width, "packed-vectors")
    if packed.where("target").isEmpty():
        return _no_pairs(sets)
    blocks = _Blocks(packed, width)
    pivots = blocks.pivots

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestPartners()
        for frame in frames:
            for row in range(frame.num_rows):
                p, t = _Block(frame, row, "p_", width), _Block(frame, row, "t_", width)
                if p.number not in best.bounds:
                    best.bounds[p.number] = np.frombuffer(frame.column("p_bound")[row].as_buffer(), float).copy()
                for part, similar in _compared(p, t, pivots, best.bounds[p.number]):
                    first = similar.argmax(axis=1)  # the first of equal ones has the smallest tie
                    yield from best.add(p.number, part, p.ids[part], t.ids[first], similar[np.arange(len(part)), first])
        yield from best.flushed()

    return crossed(blocks.bounded_probes(), blocks.table.where("target").drop("probe", "target")).mapInArrow(
        search, "a long, b long, similarity double")


def packed_pairs(sets: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b, similarity) of all pairs of a probe and a target of ``sets(set_id, n, features, probe, target)`` at the threshold.

    Where all sets are both, each pair comes once, the smaller number first.
    """
    packed = _packed(sets.select("set_id", "n", "features", "probe", "target", F.lit(0).alias("tie")), width, "packed-vectors")
    if packed.where("target").isEmpty():
        return _no_pairs(sets)
    blocks = _Blocks(packed, width)
    pivots = blocks.pivots

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in range(frame.num_rows):
                p, t = _Block(frame, row, "p_", width), _Block(frame, row, "t_", width)
                for part, similar in _compared(p, t, pivots, np.full(len(p.ids), float(threshold))):
                    if p.number == t.number:
                        similar[part[:, None] >= np.arange(len(t.ids))] = -1.0
                    at, other = np.nonzero(similar >= threshold - 1e-12)
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(p.ids[part[at]]), "b": pa.array(t.ids[other]), "similarity": pa.array(similar[at, other])})

    probes, targets = blocks.table.where("probe").drop("probe", "target"), blocks.table.where("target").drop("probe", "target")
    sided = packed.where("probe and target").isEmpty()
    cells = crossed(probes, targets).where(
        (F.col("p_high_n") >= threshold * F.col("t_low_n") - SLACK) & (F.col("t_high_n") >= threshold * F.col("p_low_n") - SLACK))
    if sided:
        return cells.mapInArrow(search, "a long, b long, similarity double")
    found = cells.where("p_block <= t_block").mapInArrow(search, "a long, b long, similarity double")
    # Rows of one number are one set.
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
