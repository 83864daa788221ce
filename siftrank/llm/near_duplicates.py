"""One record of each group of near-duplicates by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftrank.llm.arrays import arrow_schema, bounded_batches, dropped, stored
from siftrank.llm.components import components
from siftrank.llm.exact_dedup import fresh_name
from siftrank.llm.simhash_dedup import fingerprint, fingerprint_links, shingle_hashes
from siftrank.operators.sketches import sketches, undecided_pairs

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of about this many sets or more go to the end of the order.
CROWDED = 200
#: One in so many sets is counted to find the shingles to move (any choice gives the same result), the most
#: crowded first and so many at most.
SAMPLED, MOST_MOVED = 16, 1 << 20
#: Parts in which the sets of a moved shingle are counted.
SALTS = 1_024
#: Sets of one key that are compared with as many others in one join key.
BLOCK = 1_000
#: Keys of more sets than this, and the most rounds in which their sets meet one of them before all of them meet.
FEW, ROUNDS = 16, 5
#: A round that finds fewer links is the last one.
WORTH = 100
#: Sets that are broadcast by name, so that texts need not be shuffled to find or to leave them out.
MOST_NAMED = 1 << 21
#: Shingles of texts that a task keeps while it compares pairs.
MOST_KEPT = 2_000_000
_LAST = np.uint64((1 << 64) - 1)
_HEAD = "key long, set long, n int, place int, moved boolean"
_HEAD_ARROW = pa.schema([("key", pa.int64()), ("set", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("moved", pa.bool_())])


def keep_one_of_each(records: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes",
                     shingle: int = SHINGLE, similarity: float = SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """One record of each group of near-duplicates, with all its columns: the one with the smallest id.

    Two records are near-duplicates if the sets of their ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` or more; groups are joined by way of others too. Texts are lower-cased
    (A-Z) and cut at ASCII white space; fewer words are one shingle, and texts without a word (null ones
    too) are equal. Of records that share the smallest id one stays; a record without an id stays only
    where its group has no other.

    Method. Equal sets are one set. Sets whose SimHash fingerprints lie within two bits meet by Golay-code keys
    (:func:`siftrank.llm.simhash_dedup.fingerprint_links`), are compared whole and joined. SimHash alone does not find
    all: at 0.8 fingerprints differ in up to 23 of 64 bits, as do 1 to 2 % of unrelated pairs. So the sets that it leaves
    in different groups are searched exactly: in any one order of all shingles, two sets at the similarity share
    one of their first n - ceil(similarity * n) + 1 (exact bound), so these are the keys under which sets
    meet; sizes and places of the shared key rule most pairs out, and the rest are compared whole. The
    order is that of the hashes (64 bits; a shingle is taken for its hash), with the shingles of many sets
    (by a sample) moved to the end.

    How it scales: a fifth of the shingles is sent. Pairs that met are first compared by parity sketches of two to
    four bits a shingle (an exact bound), and whole texts are sent only for what these leave. Up to ``MOST_NAMED`` sets
    that met, copies and records that go are broadcast by name, so that other texts are read in place and not shuffled. Shingles of many
    records (a header, a licence) move to the end and are counted in salted parts. Each set is first
    compared with the smallest set of each of its keys, then in rounds with others of its crowded keys, for as long as
    this joins groups. Only sets that this leaves in different groups
    are compared with each other, in blocks: a large family of one text costs a few comparisons a set. Steps
    and shuffle files are deleted once what follows them is stored.
    """
    bounded_batches(records.sparkSession)
    sig, number = fresh_name(records, "_sig"), fresh_name(records, "_row")
    row = T.StructType([*records.schema.fields, T.StructField(sig, T.BinaryType())])
    schema, place = arrow_schema(row), records.columns.index(text_col)

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            signs = [xxhash.xxh3_128_digest(_shingles(t, shingle).tobytes()) for t in frame.column(place)]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(signs, pa.binary())], schema=schema)

    # The row numbers depend on partitions, so they are stored before they are used.
    rows = stored(records.mapInArrow(sign, row).withColumn(number, F.monotonically_increasing_id()), "signed-rows", clean=True)
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(number).alias("row")))
    sets = stored(rows.groupBy(sig).agg(F.min(number).alias("set"), first.alias("least")).drop(sig), "distinct-sets", clean=True)
    texts = _only(rows.select(F.col(number).alias("set"), F.col(text_col).alias("text")), "set", sets)
    groups = components(joined_sets(texts, shingle, similarity, crowded))
    named = sets.join(groups, sets["set"] == groups["node"], "left").select("least", F.coalesce("component", "set").alias("group"))
    chosen = stored(named.groupBy("group").agg(F.min("least").alias("least")).select(F.col("least.row").alias(number)), "kept-rows",
                    clean=True)
    return _only(rows, number, chosen).select(*records.columns)


def _only(rows: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``kept``; where few are not, these are broadcast and the rows stay in place."""
    others = stored(rows.select(key).join(kept.select(key), key, "left_anti"), "other-names", clean=True)
    if others.count() <= MOST_NAMED:
        return rows.join(F.broadcast(others), key, "left_anti")
    dropped(others)
    return stored(rows.join(kept.select(key), key, "left_semi"), "kept-texts", clean=True)


def joined_sets(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of (set, text) rows at the similarity."""
    short = set_sketches(texts, shingle)
    close = golay_pairs(texts, shingle, similarity, short)
    sampled = texts.where(F.pmod(F.xxhash64("set"), F.lit(SAMPLED)) == 0)
    counts = _heads(sampled, np.zeros(0, np.int64), shingle, 0.0).groupBy("key").agg(F.count("*").alias("n"))
    often = stored(counts.where(F.col("n") >= max(2, crowded // SAMPLED)).orderBy(F.desc("n")).limit(MOST_MOVED).select("key"),
                   "often-used", clean=True)
    keys = _shared_keys(_heads(texts, often.toArrow().column(0).to_numpy(), shingle, similarity))
    groups, near = _groups(close), [close]
    for turn in range(ROUNDS):
        met = _plausible(_stars(keys, turn), similarity)
        for side in "ab":
            own = groups.toDF(f"set_{side}", f"group_{side}")
            met = met.join(own, F.col(side) == F.col(f"set_{side}"), "left")
        apart = met.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")
        near.append(_alike(apart, texts, short, shingle, similarity))
        groups = _groups(groups.unionByName(near[-1]))
        if turn and near[-1].count() < WORTH:
            break
    last = F.ceil(F.col("uses") / BLOCK).cast("int") - 1
    placed = stored(keys.join(groups, keys["set"] == groups["a"], "left").select(
        "key", F.struct("set", "n", "place").alias("side"), F.coalesce("b", "set").alias("group"), last.alias("last"),
        F.pmod(F.hash("set"), last + 1).alias("own")), "grouped-keys", clean=True)
    rest = _alike(_plausible(_apart(placed), similarity), texts, short, shingle, similarity)
    dropped(placed, often, short, *near)
    return groups.unionByName(rest)


def _groups(links: DataFrame) -> DataFrame:
    """Links (a, b) of each set to the smallest one of its component."""
    return components(links).select(F.col("node").alias("a"), F.col("component").alias("b"))


def _stars(keys: DataFrame, turn: int) -> DataFrame:
    """Heads (l, r) of each set and of one set of each of its keys: the smallest, in later turns others of the crowded keys."""
    side = F.struct("set", "n", "place")
    if turn:
        keys = keys.where(F.col("uses") > FEW).drop("least")
        keys = keys.join(keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("set", "key", F.lit(turn)), side.alias("side"))).alias("m")).select(
            "key", F.col("m.side").alias("least")), "key")
    return keys.select(side.alias("r"), F.col("least").alias("l")).where("r.set <> l.set")


def set_sketches(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Stored sketches (set, n, sketch) of (set, text) rows."""

    def make(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [_shingles(t, shingle) for t in frame.column(1)]
            sizes = np.array([len(x) for x in found], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array(sizes.astype(np.int32)), pa.array(sketches(flat, sizes), pa.binary())], names=["set", "n", "sketch"])

    return stored(texts.select("set", "text").mapInArrow(make, "set long, n int, sketch binary"), "set-sketches", clean=True)


def golay_pairs(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, short: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of (set, text) rows at the similarity whose fingerprints meet by Golay-code keys, each set with the smallest of a fingerprint."""

    def sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            fps = np.array([fingerprint(_shingles(t, shingle)) for t in frame.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(fps)], names=["set", "fp"])

    signed = stored(texts.select("set", "text").mapInArrow(sign, "set long, fp long"), "set-fingerprints", clean=True)
    least = stored(signed.groupBy("fp").agg(F.min("set").alias("first")), "distinct-fingerprints", clean=True)
    same = signed.join(least, "fp").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    links = fingerprint_links(least.select("fp"))
    across = links.join(least.toDF("a", "first_a"), "a").join(least.toDF("b", "first_b"), "b").select(
        F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    close = _alike(same.unionByName(across).distinct(), texts, set_sketches(texts, shingle) if short is None else short, shingle, similarity)
    dropped(signed, least)
    return close


def _shared_keys(heads: DataFrame) -> DataFrame:
    """The heads whose key several sets have, with the number of these sets and the smallest one's head."""
    side = F.struct("set", "n", "place")
    salt = F.when(F.col("moved"), F.pmod(F.xxhash64("set"), F.lit(SALTS))).otherwise(F.lit(0))
    part = Window.partitionBy("key", "salt")
    marked = stored(heads.withColumn("salt", salt).withColumns({"uses": F.count("*").over(part), "least": F.min(side).over(part)})
                    .where("moved or uses > 1").drop("salt"), "shared-keys", clean=True)
    crowded = marked.where("moved").drop("uses", "least")
    whole = crowded.groupBy("key").agg(F.count("*").alias("uses"), F.min(side).alias("least")).where("uses > 1")
    return marked.where("not moved").unionByName(crowded.join(whole, "key")).drop("moved")


def _apart(placed: DataFrame) -> DataFrame:
    """Pairs (l, r) of sets with a common key that are in different groups."""
    # Keys whose sets are all in one group are settled.
    mixed = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    placed = placed.join(mixed, "key", "left_semi")
    left = placed.select("key", F.col("side").alias("l"), F.col("group").alias("group_l"), F.col("own").alias("i"),
                         F.explode(F.sequence("own", "last")).alias("j"))
    right = placed.select("key", F.col("side").alias("r"), F.col("group").alias("group_r"), F.col("own").alias("j"),
                          F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    return left.join(right, ["key", "i", "j"]).where("group_l <> group_r and (i < j or l.set < r.set)").select("l", "r")


def _shingles(text: pa.Scalar, size: int) -> np.ndarray:
    return np.unique(shingle_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), size))


def _heads(texts: DataFrame, moved: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(key, set, n, place, moved) of the first shingles of every set; ``place`` counts from 1."""
    last = texts.sparkSession.sparkContext.broadcast(np.sort(np.append(moved.view(np.uint64), _LAST)))

    def compute(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keys, late, counts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [], []
            for text in frame.column(1):
                found = _shingles(text, shingle)
                at_end = last.value[np.searchsorted(last.value, found)] == found
                n = len(found)
                counts.append(min(n, n - ceil(similarity * n - 1e-9) + 1))
                sizes.append(n)
                keys.append(np.concatenate([found[~at_end], found[at_end]])[:counts[-1]])
                late.append(np.arange(counts[-1]) >= n - np.count_nonzero(at_end))
            of = np.repeat(np.arange(len(counts)), counts)
            start = np.cumsum([0, *counts])[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys).view(np.int64)), frame.column(0).take(pa.array(of)),
                pa.array(np.array(sizes, np.int32)[of]), pa.array((np.arange(len(of)) - start[of] + 1).astype(np.int32)),
                pa.array(np.concatenate(late))], schema=_HEAD_ARROW)

    return texts.select("set", "text").mapInArrow(compute, _HEAD)


def _plausible(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of met sets l, r that can reach the similarity if their key is the first shared one."""
    n_l, n_r = F.col("l.n"), F.col("r.n")
    rest = F.least(n_l - F.col("l.place"), n_r - F.col("r.place")) + 1
    return met.where((rest >= _least_whole(similarity / (1 + similarity) * (n_l + n_r)))
                     & (F.least(n_l, n_r) >= _least_whole(similarity * F.greatest(n_l, n_r)))).select(
        F.least("l.set", "r.set").alias("a"), F.greatest("l.set", "r.set").alias("b")).distinct()


def _least_whole(value: Column) -> Column:
    return F.ceil(value - 1e-9)


def _alike(pairs: DataFrame, texts: DataFrame, short: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; sketches rule most others out before texts are sent."""
    met = stored(pairs, "met-pairs", clean=True)
    pairs = stored(undecided_pairs(met, short, short, similarity), "possible-pairs", clean=True)
    dropped(met)
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "needed-sets", clean=True)
    if needed.count() <= MOST_NAMED:
        needed = F.broadcast(needed)

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for frame in frames:
            good = []
            for a, b, *texts in zip(*(frame.column(i).to_pylist() for i in (0, 1)), frame.column(2), frame.column(3), strict=True):
                if held > MOST_KEPT:
                    known.clear()
                    held = 0
                for number, text in zip((a, b), texts, strict=True):
                    if number not in known:
                        known[number] = _shingles(text, shingle)
                        held += len(known[number])
                a, b = known[a], known[b]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield frame.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # Texts travel, not their shingles: those are larger and do not compress.
    met = stored(texts.join(needed, "set", "left_semi").select("set", "text"), "met-texts", clean=True)
    alike = stored(pairs.join(met.toDF("a", "text_a"), "a").join(met.toDF("b", "text_b"), "b").select(
        "a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "similar-pairs", clean=True)
    dropped(pairs, met)
    return alike
