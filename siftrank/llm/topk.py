"""Exact top-k search by refining global score histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.arrays import arrow_schema, batches, bounded_batches, pack, stored, unpack

K = 5
BINS = 4096
QUERY_ROWS = 256
#: Numbers in a block of candidates, and blocks that one group of work holds.
BLOCK_NUMBERS = 1 << 18
GROUP_BLOCKS = 4
_BINS = "query_block long, place int, bin long, n long"
_BINS_ARROW = pa.schema([("query_block", pa.int64()), ("place", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])


def whole_components(vector: str) -> Column:
    """floor(256 x) of every component, the component taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))


def top_matches(records: DataFrame, is_query: Column, id_col: str = "molecule_id", vector_col: str = "descriptor_vector",
                k: int = K, bins: int = BINS) -> DataFrame:
    """The ``k`` records with the highest inner product for every query record, exactly.

    Vectors are scaled to whole numbers (floor of 256 times each component), so scores are whole.
    Queries are the records where ``is_query`` holds; candidates are all records with another id.
    Returns ``query_id``, ``rank`` (from 1), the match's ``id_col`` and ``score``; ties go to the smaller
    id, and a query with fewer candidates gets all of them.

    Method. Query blocks meet groups of candidate blocks and score everything. Each round adds up, for
    every query, in which of ``bins`` bins of its current score range the best scores lie, finds the bin
    of the k-th, and makes it the next range, until a range is one value: the k-th score. The last
    round keeps what reaches that score, of equal scores only the smallest ids of each group.

    Records without an id or with a vector that is null or holds a null or non-finite component take no
    part. A shorter vector counts as filled up with zeros. Records that repeat an id are each a
    candidate; a query is answered once for each of its records. Empty tables give an empty result.
    The project's own records hold descriptors as columns; the caller packs them into one array.

    How it scales: neither queries nor candidates are broadcast. Each query block is sent to every group
    of candidate blocks; a group returns at most ``k`` bins or rows for each query.
    """
    spark = records.sparkSession
    bounded_batches(spark)
    fit = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = records.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit).select(
        F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole_components(vector_col).alias("vector"))
    id_type = rows.schema["id"].dataType
    blocks = stored(_blocks(rows, id_type), "vector-blocks")
    n_blocks, width, norm = blocks.where("kind = 0").agg(
        F.count("*"), F.coalesce(F.max("width"), F.lit(0)), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    n_groups = max(1, -(-n_blocks // GROUP_BLOCKS))
    queries = blocks.where("kind = 1")
    # No score of a query lies outside +-(its norm times the largest norm).
    state = stored(queries.mapInArrow(lambda frames: batches(_STATE_ARROW, _first_ranges(frames, norm, bins)), _STATE), "score-ranges")

    def meet(ranges: DataFrame) -> DataFrame:
        asked = queries.join(ranges.withColumnRenamed("query_block", "block"), "block")
        asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        held = blocks.where("kind = 0").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int"))
        both = held.unionByName(asked, allowMissingColumns=True).repartition(n_groups, "group")
        return both.sortWithinPartitions("group", "kind", "block")

    while state.where(F.exists("width_of", lambda w: w > 1)).limit(1).count():
        found = meet(state).mapInArrow(lambda frames: batches(_BINS_ARROW, _top_bins(frames, k, width, bins), 4096), _BINS)
        state = stored(_narrower(state, found, k, bins), "score-ranges")
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("query_block", T.LongType()), T.StructField("place", T.IntegerType()),
                        T.StructField(id_col, id_type), T.StructField("score", T.LongType())])
    schema = arrow_schema(out)
    best = meet(state).mapInArrow(lambda frames: batches(schema, _reaching(frames, k, width), 4096), out)
    order = Window.partitionBy("query_block", "place").orderBy(F.desc("score"), F.asc(id_col))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", id_col, "score")


# ---- blocks -----------------------------------------------------------------

_STATE = "query_block long, low array<bigint>, width_of array<bigint>, above array<bigint>"
_STATE_ARROW = pa.schema([("query_block", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("low", "width_of", "above")])


def _blocks(rows: DataFrame, id_type: T.DataType) -> DataFrame:
    out = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("lengths", T.BinaryType()), T.StructField("numbers", T.BinaryType()), T.StructField("width", T.IntegerType()),
        T.StructField("norm", T.DoubleType())])
    schema = arrow_schema(out)

    def make(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for frame in frames:
            vectors, asks, ids = frame.column(2), frame.column(1).to_numpy(zero_copy_only=False).astype(bool), frame.column(0)
            lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for kind, chosen in ((0, np.arange(len(asks))), (1, np.flatnonzero(asks))):
                size = QUERY_ROWS if kind else max(64, BLOCK_NUMBERS // max(int(lengths.max(initial=1)), 1))
                for start in range(0, len(chosen), size):
                    some = chosen[start:start + size]
                    own = [numbers[e - n:e] for e, n in zip(ends[some].tolist(), lengths[some].tolist(), strict=True)]
                    norm = max([float(np.sqrt((v.astype(float) ** 2).sum())) for v in own])
                    yield (kind, number, [ids[int(i)].as_py() for i in some], pack(lengths[some]), pack(np.concatenate(own)),
                           int(lengths[some].max()), norm)
                    number += 1

    return rows.mapInArrow(lambda frames: batches(schema, make(frames), 1), out)


def _matrix(row: dict, width: int) -> np.ndarray:
    lengths, numbers = unpack(row["lengths"], np.int64), unpack(row["numbers"], np.int64)
    if len(lengths) and (lengths == width).all():
        return numbers.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = numbers
    return out


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Whole inner products; in floating point where every sum stays below 2^53, where it is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def _first_ranges(frames: Iterator[pa.RecordBatch], norm: float, bins: int) -> Iterator[tuple]:
    for frame in frames:
        for row in frame.to_pylist():
            matrix = _matrix(row, row["width"])
            reach = [int(np.ceil(np.sqrt((q.astype(float) ** 2).sum()) * norm * (1 + 1e-9))) + 1 for q in matrix]
            widths = []
            for r in reach:
                width = 1
                while width * bins < 2 * r + 1:
                    width *= bins
                widths.append(width * bins)
            yield row["block"], [-r for r in reach], widths, [0] * len(reach)


# ---- rounds -----------------------------------------------------------------

def _meetings(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Each query block with its scores against all candidates of the group, and the candidates' ids."""
    group, held, ids = None, [], []
    for frame in frames:
        for row in frame.to_pylist():
            if row["group"] != group:
                group, held, ids = row["group"], [], []
            if row["kind"] == 0:
                held.append(_matrix(row, width))
                ids.extend(row["ids"])
            elif held:
                candidates = np.concatenate(held)
                held = [candidates]
                queries = _matrix(row, width)
                names = np.array(ids)
                scores = scores_of(queries, candidates)
                own = np.array(row["ids"])[:, None] == names
                yield row, np.where(own, np.iinfo(np.int64).min, scores), names


def _top_bins(frames: Iterator[pa.RecordBatch], k: int, width: int, n_bins: int) -> Iterator[tuple]:
    """Bins of the k best scores of each query's range, with how many of them lie in each."""
    for row, scores, _ in _meetings(frames, width):
        low, span = np.array(row["low"])[:, None], np.array(row["width_of"])[:, None]
        inside = np.where((scores >= low) & (scores - low < span), scores, np.iinfo(np.int64).min)
        best = inside if inside.shape[1] <= k else np.partition(inside, inside.shape[1] - k, axis=1)[:, -k:]
        for place, values in enumerate(best):
            values = values[values > np.iinfo(np.int64).min]
            bins, counts = np.unique((values - low[place]) // max(int(span[place, 0]) // n_bins, 1), return_counts=True)
            for b, n in zip(bins.tolist(), counts.tolist(), strict=True):
                yield row["block"], place, b, n


def _narrower(state: DataFrame, found: DataFrame, k: int, bins: int) -> DataFrame:
    """The bin of each query's k-th score as its next range; without k scores, the lowest score is the range."""
    each = state.select("query_block", F.posexplode(F.arrays_zip("low", "width_of", "above")).alias("place", "s")).select(
        "query_block", "place", "s.low", "s.width_of", "s.above")
    sums = found.groupBy("query_block", "place", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query_block", "place").orderBy(F.desc("bin"))
    joined = sums.join(each, ["query_block", "place"]).withColumn("upto", F.col("above") + F.sum("n").over(down))
    kth = joined.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select(
        "query_block", "place", "bin", (F.col("upto") - F.col("n")).alias("over"))
    size = F.greatest(F.expr(f"width_of div {bins}"), F.lit(1))
    # A range that is one value already stays.
    at, fixed = F.col("low") + F.col("bin") * size, F.col("width_of") <= 1
    following = each.join(kth, ["query_block", "place"], "left").select(
        "query_block", F.struct(
            "place", F.when(fixed | F.col("bin").isNull(), F.col("low")).otherwise(at).alias("low"),
            F.when(fixed | F.col("bin").isNull(), F.lit(1)).otherwise(size).cast("long").alias("width_of"),
            F.when(fixed | F.col("bin").isNull(), F.col("above")).otherwise(F.col("over")).cast("long").alias("above")).alias("s"))
    return following.groupBy("query_block").agg(F.sort_array(F.collect_list("s")).alias("s")).select(
        "query_block", F.col("s.low").alias("low"), F.col("s.width_of").alias("width_of"), F.col("s.above").alias("above"))


def _reaching(frames: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[tuple]:
    for row, scores, names in _meetings(frames, width):
        for place, (low, values) in enumerate(zip(row["low"], scores, strict=True)):
            at = np.flatnonzero(values >= low)
            best = at[np.lexsort((names[at], -values[at]))[:k]]
            for i in best.tolist():
                yield row["ids"][place], row["block"], place, names[i].item(), int(values[i])
