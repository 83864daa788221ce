"""Near-duplicate records by SimHash and Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, bounded_batches, stored
from siftrank.llm.components import components
from siftrank.llm.golay import nearby_indices

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Segments of the fingerprint: lowest bit and number of bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Keys shared by more fingerprints than this are split by all words one bit away instead of compared in pairs.
CROWDED = 64


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words (all of them, if fewer), repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(size, len(words)) - 1
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[:len(words) - last].tolist(), ends[last:].tolist(), strict=True)],
                    np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it; zero for none."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints_of(texts: pa.Array) -> np.ndarray:
    found = [fingerprint(shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in texts]
    return np.array(found, np.uint64).view(np.int64)


def fingerprints(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint) of every record; the fingerprint as a signed number."""
    bounded_batches(records.sparkSession)
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])
    schema = arrow_schema(out)

    def compute(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(_fingerprints_of(frame.column(1)))], schema=schema)

    return rows.mapInArrow(compute, out)


def _segment(fps: np.ndarray, i: int) -> np.ndarray:
    low, bits = SEGMENTS[i]
    return ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (place of the fingerprint, key) rows.

    Two fingerprints within two bits agree on at least one of three segments, and on the next
    one they differ in two bits at most, so they share a codeword number there. A key is the
    segment's number, its bits and one codeword number of the next segment.
    """
    nearby = [nearby_indices(_segment(fps, i)) for i in range(3)]
    places, keys = [], []
    for i in range(3):
        codes = nearby[(i + 1) % 3].astype(np.uint64)
        base = (np.uint64(i) << np.uint64(40)) | (_segment(fps, i).astype(np.uint64) << np.uint64(12))
        found = np.sort(base[:, None] | codes, axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        places.append(np.nonzero(new)[0])
        keys.append(found[new])
    return np.concatenate(places), np.concatenate(keys)


def _key_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        fps = frame.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(fps), 20_000):
            part = fps[start:start + 20_000]
            places, keys = golay_keys(part)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "fp": pa.array(part[places].view(np.int64))})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` which lie within two bits of each other.

    Fingerprints under one Golay key are compared in pairs where the key is held by few. A crowded
    key is cut further: each of its fingerprints also stands under itself and its 64 words one bit
    away; fingerprints under one such word are at most two bits apart, and any two that close share
    one, so linking them to the smallest loses no connection and lists no pairs.
    """
    keyed = stored(distinct.mapInArrow(_key_rows, "key long, fp long"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    few = shared.where(F.col("n") <= CROWDED).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("f"))
    pairs = few.select(F.explode("f").alias("a"), "f").select("a", F.explode("f").alias("b")).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    crowded = shared.where(F.col("n") > CROWDED).select("fp").distinct()
    words = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *(
        F.lit((1 << b) - (1 << 64 if b == 63 else 0)) for b in range(64)))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a")
    stars = words.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").unionByName(stars).distinct()


def group_near_duplicates(records: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes"
                          ) -> DataFrame:
    """Group records whose evidence notes have SimHash fingerprints within two bits, directly or by way of others.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a fingerprint bit is set
    where over half of the three-word shingles' XXH64 values (seed 42, repeats included) have it.
    Returns one row for each record: ``id_col``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id of the group.

    Candidates come from Golay codes: the fingerprint is cut into three segments, two errors leave
    one segment whole, and the next segment's nearby codeword numbers bridge up to two errors.
    Candidates are verified by Hamming distance.

    Null texts count as empty; texts without a word have fingerprint zero and are linked like others;
    with one or two words the whole sequence is the only shingle. Ids need not be unique; a record
    without an id takes its group's smallest id (null if the group has none). Other columns are
    ignored; an empty table gives an empty result.

    How it scales: work is on distinct fingerprints with their smallest id, so copies cost one row
    each; see :func:`fingerprint_links` for crowded keys. Components are found in stored rounds.
    """
    rows = stored(fingerprints(records, id_col, text_col), "fingerprints")
    found = stored(_least_of_groups(rows.groupBy("fp").agg(F.min("id").alias("least"))), "groups")
    return rows.join(found, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _least_of_groups(distinct: DataFrame) -> DataFrame:
    """(fp, least) with the smallest ``least`` of all fingerprints of a group, from one row for each fingerprint."""
    distinct = stored(distinct, "distinct-fingerprints")
    groups = components(fingerprint_links(distinct.select("fp")))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("least"))
    return named.drop("least").join(smallest, "component").select("fp", "least")
