"""Merkle manifests of stored runs: digests swept up the trees, proofs swept down, both in label order.

A tree node's label is (last leaf below it, level). In rising order of labels children come before
their parent, so one sweep over the sorted nodes, with a priority queue that delivers digests to the
labels of parents, hashes a whole tree (time-forward processing); the reversed order delivers proof
suffixes from parents to children. A tree is cut into subtrees of ``8 ** HEIGHT`` leaves: a task's
queue works within a subtree, the sorted shuffle between rounds carries messages from one to another.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftrank.llm.arrays import arrow_schema, batches, bounded_batches, stored
from siftrank.operators.joins import dense_positions

WIDTH_BITS = 3
WIDTH = 1 << WIDTH_BITS
#: Levels that one round sweeps: a task holds one subtree of 8 ** HEIGHT nodes at a time.
HEIGHT = 5
DIGEST = 32
#: The columns of a record that its leaf covers by default, in this order.
LEAF_COLUMNS = ("molecule_id", "input_smiles", "canonical_smiles", "priority_score", "evidence_summary_notes")
FIRST_LABEL = 1 << 62

UP = T.StructType([T.StructField("g", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
                   T.StructField("end", T.LongType()), T.StructField("level", T.LongType()),
                   T.StructField("digest", T.BinaryType()), T.StructField("children", T.BinaryType())])


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the values: ``-`` for a null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def combine(digests: bytes) -> bytes:
    """Digest of a run of digests, as SHA-256 of their hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def _levels(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


def _rows(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*(c.to_pylist() for c in frame.columns), strict=True)


def _up_rows(rows: Iterator[tuple], height: int) -> Iterator[tuple]:
    """Sweep (g, chunk, pos, n, digest), sorted, up to each subtree's top.

    Yields inner nodes with their children's digests, and for each subtree one row without children:
    its top digest and the number of nodes that its tree has left.
    """
    size = WIDTH ** height
    queue: list[tuple[int, int, int, bytes]] = []
    here, m, top, left = None, 0, 0, 0

    def send(level: int, index: int, digest: bytes) -> Iterator[tuple]:
        if level == top:
            yield (*here, left, None, None, digest, None)
            return
        parent_end = min(((index >> WIDTH_BITS) + 1) << WIDTH_BITS * (level + 1), m) - 1
        heapq.heappush(queue, (parent_end, level + 1, index, digest))

    def deliver(before: int) -> Iterator[tuple]:
        """Hash every node whose last leaf stands before the given one."""
        while queue and queue[0][0] < before:
            end, level, index, digest = heapq.heappop(queue)
            children = [digest]
            while queue and queue[0][:2] == (end, level):
                children.append(heapq.heappop(queue)[3])
            joined = b"".join(children)
            yield (*here, None, end, level, None, joined)
            yield from send(level, index >> WIDTH_BITS, combine(joined))

    for g, chunk, pos, n, digest in rows:
        if (g, chunk) != here:
            yield from deliver(size)
            here, m = (g, chunk), min(size, n - chunk * size)
            top = _levels(n) if n <= size else height
            left = 1 if n <= size else -(-n // size)
        place = pos - chunk * size
        yield from deliver(place)
        yield from send(0, place, digest)
    if here:
        yield from deliver(size)


def _down_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sweep suffixes down: rows (g, chunk, end, level, pos, children, suffix, subroot, payload), labels falling.

    A subtree's first row brings the suffix of its top; yields (g, pos, suffix, subroot, payload) of its leaves.
    """
    queue: list[tuple[int, int, bytes]] = []
    arriving, root = None, None
    for g, _, end, level, pos, children, suffix, subroot, payload in rows:
        if end == FIRST_LABEL:
            arriving, root = suffix, subroot
            continue
        if arriving is not None:
            heapq.heappush(queue, (-end, -level, arriving))
            arriving = None
        label_end, label_level, own = heapq.heappop(queue)
        if (-label_end, -label_level) != (end, level):
            raise RuntimeError(f"message for node {(-label_end, -label_level)} met node {(end, level)}")
        if children is None:
            yield (g, pos, own, root, payload)
            continue
        first = end >> WIDTH_BITS * level << WIDTH_BITS
        for j in range(len(children) // DIGEST):
            child_end = min((first + j + 1 << WIDTH_BITS * (level - 1)) - 1, end)
            siblings = children[:j * DIGEST] + children[(j + 1) * DIGEST:]
            heapq.heappush(queue, (-child_end, 1 - level, siblings + own))


class _Trees:
    """Rounds of sweeps over trees of nodes (g, pos, n, digest): ``n`` nodes at positions 0 to n - 1 in tree ``g``."""

    def __init__(self, nodes: DataFrame, name: str):
        self.name, self.height, self.rounds = name, HEIGHT, []
        self.tops = None
        current = nodes
        while True:
            swept = stored(self._up(current), f"{name}-nodes")
            tops = swept.where("children IS NULL").select("g", F.col("chunk").alias("pos"), "n", "digest")
            self.rounds.append((current, swept.where("children IS NOT NULL")))
            done = tops.where("n = 1").select("g", F.col("digest").alias("subroot"), F.lit(len(self.rounds) - 1).alias("round"))
            self.tops = done if self.tops is None else self.tops.unionByName(done)
            current = tops.where("n > 1")
            if current.isEmpty():
                return

    def _up(self, nodes: DataFrame) -> DataFrame:
        height, schema = self.height, arrow_schema(UP)
        rows = nodes.select("g", F.shiftright("pos", WIDTH_BITS * height).alias("chunk"), "pos", "n", "digest")
        rows = rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "pos")
        return rows.mapInArrow(lambda frames: batches(schema, _up_rows(_rows(frames), height), 4096), UP)

    def proofs(self, arriving: DataFrame, payload: Column) -> DataFrame:
        """(g, pos, suffix, subroot, payload) of all first nodes; ``arriving`` is (g, suffix, subroot, round) of the tops."""
        lower = None
        for number in reversed(range(len(self.rounds))):
            messages = arriving.where(F.col("round") == number).select("g", F.lit(0).cast("long").alias("chunk"), "suffix", "subroot")
            if lower is not None:
                messages = messages.unionByName(lower.select("g", F.col("pos").alias("chunk"), "suffix", "subroot"))
            out = self._down(number, messages, payload if number == 0 else F.lit(None).cast("string"))
            lower = stored(out, f"{self.name}-suffixes") if number else out
        return lower

    def _down(self, number: int, messages: DataFrame, payload: Column) -> DataFrame:
        nodes, inner = self.rounds[number]
        shift = WIDTH_BITS * self.height
        chunk = F.shiftright("pos", shift)
        leaves = nodes.select("g", chunk.alias("chunk"), (F.col("pos") - F.shiftleft(chunk, shift)).alias("end"),
                              F.lit(0).cast("long").alias("level"), "pos", payload.alias("payload"))
        first = messages.select("*", F.lit(FIRST_LABEL).alias("end"), F.lit(FIRST_LABEL).alias("level"))
        rows = leaves.unionByName(inner.select("g", "chunk", "end", "level", "children"), True).unionByName(first, True)
        rows = rows.select("g", "chunk", "end", "level", "pos", "children", "suffix", "subroot", "payload")
        rows = rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", F.desc("end"), F.desc("level"))
        out = T.StructType([rows.schema[c] for c in ("g", "pos", "suffix", "subroot", "payload")])
        schema = arrow_schema(out)
        return rows.mapInArrow(lambda frames: batches(schema, _down_rows(_rows(frames)), 2048), out)


def _positions(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Add ``g`` (place of the group), ``n`` (its leaves) and ``pos`` (place in the group, by id, then digest).

    Groups and ids are range-sorted together, so that a large group is spread over many tasks.
    """
    leaves = stored(leaves, "leaves")
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("leaf")]
    placed = stored(leaves.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted-leaves")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    runs = stored(placed.groupBy("part", "group").agg(F.min("place").alias("first"), F.count("*").alias("size")), "runs")
    groups = stored(dense_positions(runs.groupBy("group").agg(F.sum("size").alias("n")), [F.asc_nulls_first("group")], "g"), "groups")
    before = F.sum("size").over(Window.partitionBy("group").orderBy("part")) - F.col("size")
    starts = runs.withColumn("offset", before - F.col("first")).drop("first", "size").alias("r").join(
        groups.alias("s"), F.col("r.group").eqNullSafe(F.col("s.group"))).select("part", F.col("r.group").alias("of"), "offset", "g", "n")
    met = placed.join(starts, (placed["part"] == starts["part"]) & placed["group"].eqNullSafe(F.col("of")))
    return stored(met.select(*leaves.columns, "g", "n", (F.col("offset") + F.col("place")).alias("pos"),
                             F.col("leaf").alias("digest")), "placed-leaves"), groups.count()


def dataset_manifest(
    records: DataFrame, id_col: str = "molecule_id", group_col: str = "job_id", leaf_columns: tuple[str, ...] = LEAF_COLUMNS,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Merkle manifest of stored result records: a subtree for each run, one root over all runs.

    A record is a leaf: the digest of ``leaf_columns`` (a value that is no text counts as Spark's text of
    it). In each run leaves ascend by ``id_col``; while several nodes remain, every eight consecutive
    ones (the last may be fewer, even one) become the digest of their hexadecimal digests. What remains
    is the run's subroot; the subroots in order of ``group_col`` give the root in the same way.

    Returns one row for each record: ``id_col``, ``group_col``, the columns of ``also`` (expressions over
    the record that are taken along, such as the digest of another version of it), ``leaf``, ``position``,
    ``group_size``, ``group_place``, ``group_count``, ``subroot``, ``root`` and ``proof``: the digests of the
    leaf's siblings, level by level up to the root, left to right, 32 bytes each. Digests are binary.

    Null values are leaves' values like others; records without a run form the first subtree, records
    without an id stand first in theirs. Records with one id stand in the order of their digests, so
    repeated rows are leaves of their own. Very long texts are only hashed; an empty table gives an empty
    result. Columns that are not named are ignored; a named one must not be called like a result column.

    How it scales: texts are hashed once, by built-in functions. Only digests and ids are sorted, in ranges
    that cut large runs too; a task holds no more than the queue of one subtree, and a run of n records
    takes log(n) / log(8 ** HEIGHT) rounds each way. A proof has up to seven digests for each level.
    """
    also = also or {}
    results = ["leaf", "position", "group_size", "group_place", "group_count", "subroot", "root", "proof"]
    named = [id_col, group_col, *also]
    clash = {c.lower() for c in named} & set(results)
    if clash or len({c.lower() for c in named}) < len(named):
        raise ValueError(f"columns named like a result or twice: {named}")
    bounded_batches(records.sparkSession)
    leaves = records.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"),
                            *[c.alias(f"also{i}") for i, c in enumerate(also.values())],
                            leaf_digest([F.col(c) for c in leaf_columns]).alias("leaf"))
    placed, count = _positions(leaves)
    trees = _Trees(placed, "trees")
    tops = stored(trees.tops, "subroots")
    over = _Trees(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(count).cast("long").alias("n"),
                              F.col("subroot").alias("digest"), "subroot", "round"), "root")
    found = over.tops.first()
    root = F.lit(bytes(found["subroot"]) if found else None).cast("binary")
    start = over.tops.select("g", F.lit(b"").alias("suffix"), "subroot", "round")
    above = stored(over.proofs(start, F.struct("subroot", "round")), "root-suffixes")
    arriving = above.select(F.col("pos").alias("g"), "suffix", "payload.subroot", "payload.round")
    kept = ["id", "group", *[f"also{i}" for i in range(len(also))], "leaf", "pos", "n", "g"]
    proofs = trees.proofs(arriving, F.struct(*kept))
    names = dict(zip(kept, [id_col, group_col, *also, "leaf", "position", "group_size", "group_place"], strict=True))
    return proofs.select(*[F.col(f"payload.{k}").alias(v) for k, v in names.items()],
                         F.lit(count).cast("long").alias("group_count"), "subroot", root.alias("root"), F.col("suffix").alias("proof"))


def fold_proof(digest: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf's digest and its siblings give; ``places`` are (position, size) in its run and of its run."""
    at = 0
    for position, size in places:
        while size > 1:
            first = position >> WIDTH_BITS << WIDTH_BITS
            others = min(WIDTH, size - first) - 1
            before = at + (position - first) * DIGEST
            after = at + others * DIGEST
            digest = combine(proof[at:before] + digest + proof[before:after])
            at, position, size = after, position >> WIDTH_BITS, -(-size // WIDTH)
    return digest


def verify_manifest(manifest: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """Add ``folded_root``, recomputed from the digests in ``leaf_col`` and the manifest's proofs, and ``verified``.

    ``verified`` tells whether it equals ``root``. A null digest folds to a null root and is not verified.
    No row is moved.
    """
    out = T.StructType([*manifest.schema.fields, T.StructField("folded_root", T.BinaryType())])
    schema = arrow_schema(out)

    def fold(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            wanted = [leaf_col, "proof", "position", "group_size", "group_place", "group_count"]
            rows = zip(*(frame.column(c).to_pylist() for c in wanted), strict=True)
            folded = [None if leaf is None else fold_proof(leaf, proof, [(pos, n), (g, groups)]) for leaf, proof, pos, n, g, groups in rows]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(folded, pa.binary())], schema=schema)

    return manifest.mapInArrow(fold, out).withColumn(
        "verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))
