"""Exact set-similarity joins: threshold pairs, nearest neighbour, closest reference.

Equal feature sets are collapsed to one before any pair is formed, so a group of
copies costs as much as one row however large it is.  Pairs are found through an
inverted index whose tokens are ordered from rare to frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.functions.numbers import round_dp
from siftrank.functions.sets import tanimoto
from siftrank.operators.blocks import feature_partners
from siftrank.operators.joins import attach_counted, attach_per_key
from siftrank.operators.minwise import banded_keys
from siftrank.operators.packed import packed_pairs, packed_partners, packed_width
from siftrank.operators.signatures import signature_keys
from siftrank.operators.sketches import possible_pairs
from siftrank.session import columnar, durable

HOT_TOKEN = 2_000  # sets holding a token (by a sample) before it is no key of its own
SAMPLED = 16  # one in so many sets is counted to order the tokens
MOST_LATE = 1 << 20  # tokens that are ordered by their use, beside the frequent ones
SETS_AT_ONCE = 1_024  # sets whose first tokens are found together
MOST_MET, MOST_COPIED = 1 << 20, 1 << 19  # sets that are broadcast by number, or by signature
BLOCK = 4_000  # sets of one key that one task compares among themselves
COLD_TOKEN = 16  # sets of a block holding a token up to which it is only looked up in sorted postings
MASK_TOKENS = 2_048  # more frequent tokens that a block has a table of
SMALL_REFERENCE = 2_048  # reference rows that are broadcast
SMALL_REFERENCE_FEATURES = 1_000_000  # and their features in total


@dataclass(frozen=True)
class DistinctSets:
    """``sets(set_id, n, features, members)`` and ``members(<input columns>, set_id)``."""

    sets: DataFrame
    members: DataFrame


def collapse_sets(df: DataFrame, ordinal: str, features: str) -> DistinctSets:
    """Give rows with equal feature sets one ``set_id``, the smallest ordinal among them."""
    signature = F.md5(F.array_join(F.sort_array(F.col("_features")), ",").cast("binary"))
    # Stored before it is filtered: a filter on a computed array would be pushed
    # below and make Spark compute the features of every text twice.
    stored = columnar(df.withColumn("_features", F.col(features)).drop(features).withColumn("_sig", signature))
    rows = stored.withColumnRenamed("_features", features).where(F.size(features) > 0)
    per_sig = durable(rows.groupBy("_sig").agg(F.min(ordinal).alias("set_id"), F.count("*").alias("members")))
    # Only keys travel here.
    keyed = attach_per_key(rows.select(ordinal, "_sig"), per_sig, ["_sig"], "members")
    members = rows.drop("_sig", features).join(keyed.select(ordinal, "set_id"), ordinal)
    copied = per_sig.where("members > 1")
    if copied.count() <= MOST_COPIED:
        # The wide feature arrays stay where they are; rows that are copies are passed over as they are read.
        first = F.col(ordinal).isNotNull() & (F.col("set_id").isNull() | (F.col("set_id") == F.col(ordinal)))
        chosen = rows.join(F.broadcast(copied), "_sig", "left").where(first)
        sets = chosen.select(
            F.col(ordinal).alias("set_id"), F.size(features).alias("n"), F.col(features).alias("features"),
            F.coalesce("members", F.lit(1).cast("bigint")).alias("members"),
        )
        return DistinctSets(sets, members)
    # The wide feature arrays are shuffled once, for one row per set.
    chosen = per_sig.select(F.col("set_id").alias(ordinal), "members")
    sets = rows.join(chosen, ordinal).select(
        F.col(ordinal).alias("set_id"),
        F.size(features).alias("n"),
        F.col(features).alias("features"),
        "members",
    )
    return DistinctSets(columnar(sets), members)


def _ceil(value: Column) -> Column:
    """Ceiling that forgives floating-point noise just above an integer."""
    return F.ceil(value - 1e-9)


@dataclass(frozen=True)
class TokenOrder:
    """One order of all tokens: those of a sample's most used ones last, the most used at the very end."""

    tokens: np.ndarray  # sorted
    places: np.ndarray  # place of each in the order, from 1; all other tokens have 0 and go by their number
    frequent: int  # tokens placed from here on are no keys of their own


def token_order(sets: DataFrame) -> TokenOrder:
    """Order by the number of sampled sets that hold a token: any order gives the same pairs, this one few candidates."""
    sampled = sets.where(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLED)) == 0)
    used = columnar(sampled.select(F.explode(_numbers("features")).alias("tok")).groupBy("tok").agg(F.count("*").alias("uses")).where(
        "uses > 1"), "used-tokens")
    frequent, least, held = HOT_TOKEN / SAMPLED, None, 0
    for uses, tokens in used.groupBy("uses").agg(F.count("*")).orderBy(F.desc("uses")).collect():
        held += tokens
        if held > MOST_LATE and uses <= frequent:
            break
        least = uses
    most = used.where(F.col("uses") >= least).orderBy("uses", "tok").toArrow() if least else used.limit(0).toArrow()
    tokens, uses = most.column("tok").to_numpy(), most.column("uses").to_numpy()
    sort = np.argsort(tokens)
    return TokenOrder(tokens[sort], sort + 1, int(np.searchsorted(uses, frequent, "right")) + 1)


def _numbers(features: str) -> Column:
    return F.col(features).cast("array<bigint>").alias(features)


def _heads(part: pa.RecordBatch, threshold: float, order: TokenOrder) -> tuple[np.ndarray, ...]:
    """(row, token, place in the row, whether frequent) of the first tokens of every row, whose first column has the tokens.

    Two sets at the threshold share a token within this many of their first tokens in any one order.
    """
    lists = part.column(0)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    late = np.zeros(len(flat), np.int64)
    if len(order.tokens):
        at = np.minimum(np.searchsorted(order.tokens, flat), len(order.tokens) - 1)
        late = np.where(order.tokens[at] == flat, order.places[at], 0)
    sort = np.lexsort((flat, late, row))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    first = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    kept = place <= first[row]
    sort = sort[kept]
    return row[kept], flat[sort], place[kept], late[sort] >= order.frequent


def _sides(postings: DataFrame, on: list[str], extra: list[str]) -> tuple[DataFrame, DataFrame]:
    names = ["set_id", "n", "rn", *extra]
    return tuple(
        postings.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "lr"
    )


def _plausible(met: DataFrame, threshold: float, sided: bool, same_block: Column) -> DataFrame:
    """Pairs ``(a, b)`` that can reach the threshold by size and position of the shared token.

    Within a block both orders of a pair meet and one is kept; across blocks a
    pair meets once.
    """
    rest = F.least(F.col("n_l") - F.col("rn_l"), F.col("n_r") - F.col("rn_r")) + 1
    wanted = _ceil(F.lit(threshold / (1 + threshold)) * (F.col("n_l") + F.col("n_r")))
    small, large = F.least("n_l", "n_r"), F.greatest("n_l", "n_r")
    lead = "side" if sided else "set_id"
    ordered = F.col(f"{lead}_l") < F.col(f"{lead}_r")
    kept = met.where(
        (F.col(f"{lead}_l") != F.col(f"{lead}_r")) & (ordered | ~same_block)
        & (rest >= wanted) & (small >= _ceil(F.lit(threshold) * large))
    )
    return kept.select(
        F.when(ordered, F.col("set_id_l")).otherwise(F.col("set_id_r")).alias("a"),
        F.when(ordered, F.col("set_id_r")).otherwise(F.col("set_id_l")).alias("b"),
    )


def _rare_candidates(sets: DataFrame, order, threshold: float, extra: list[str]) -> DataFrame:
    """Pairs that share one of their first tokens, and not a frequent one. Only these tokens are shuffled."""
    kept = sets.select("set_id", "n", *extra).schema.fields

    def post(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, SETS_AT_ONCE):
                part = frame.slice(start, SETS_AT_ONCE)
                row, token, place, often = _heads(part, threshold, order.value)
                at = pa.array(row[~often])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[~often]), pa.array(place[~often].astype(np.int32)), *(c.take(at) for c in part.columns[1:])],
                    names=["tok", "rn", *[f.name for f in kept]])

    schema = "tok bigint, rn int" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    head = sets.select(_numbers("features"), *[f.name for f in kept]).mapInArrow(post, schema)
    # Shuffled once for both sides of the join.
    left, right = _sides(head, ["tok"], extra)
    return _plausible(left.join(right, "tok"), threshold, bool(extra), F.lit(True))


def _frequent_candidates(sets: DataFrame, order, threshold: float, extra: list[str]) -> DataFrame:
    """Pairs whose first shared token is a frequent one.

    Such a token alone would emit far too many pairs, so the sets that have one
    among their first ones get partition signatures (:mod:`siftrank.operators.signatures`):
    linearly many keys a set, which hold several tokens each.  Keys that
    are still crowded are cut into blocks and every pair of blocks is its own
    join key, so no task compares more than ``BLOCK`` by ``BLOCK`` sets.
    """
    rows = sets.select(_numbers("features"), "set_id", "n", *extra)

    def choose(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, SETS_AT_ONCE):
                part = frame.slice(start, SETS_AT_ONCE)
                row, _, _, often = _heads(part, threshold, order.value)
                yield part.take(pa.array(np.unique(row[often])))

    chosen = columnar(rows.mapInArrow(choose, rows.schema), "frequent-sets")
    return _meet(signature_keys(chosen, threshold, extra), threshold, extra)


def _meet(keys: DataFrame, threshold: float, extra: list[str]) -> DataFrame:
    """Plausible pairs of sets that share a ``key``; crowded keys are cut into blocks."""
    on = ["key"]
    keys = columnar(keys.withColumn("rn", F.lit(1)), "keys")
    usage = keys.groupBy(*on).agg(F.count("*").alias("uses")).where("uses > 1")
    counted = attach_per_key(keys, usage, on, "uses", how="inner")
    last = F.ceil(F.col("uses") / BLOCK).cast("int") - 1
    placed = durable(counted.withColumns({"last": last, "own": F.pmod(F.hash("set_id"), last + 1)}))
    rows = placed.select(*on, "set_id", "n", "rn", *extra, F.col("own").alias("bi"),
                         F.explode(F.sequence("own", "last")).alias("bj"))
    columns = placed.select(*on, "set_id", "n", "rn", *extra, F.col("own").alias("bj"),
                            F.explode(F.sequence(F.lit(0), "own")).alias("bi"))
    cell = [*on, "bi", "bj"]
    left, right = _sides(rows, cell, extra)[0], _sides(columns, cell, extra)[1]
    return _plausible(left.join(right, cell), threshold, bool(extra), F.col("bi") == F.col("bj"))


def _candidates(sets: DataFrame, threshold: float, sided: bool) -> DataFrame:
    """Distinct candidate pairs ``(a, b)``."""
    extra = ["side"] if sided else []
    found = token_order(sets)
    order = sets.sparkSession.sparkContext.broadcast(found)
    pairs = _rare_candidates(sets, order, threshold, extra)
    if found.frequent <= len(found.tokens):
        pairs = pairs.unionByName(_frequent_candidates(sets, order, threshold, extra))
    return pairs.distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, carry: list[str] | None = None) -> DataFrame:
    """Candidate pairs at the threshold with their exact ``similarity`` (and carried set columns).

    Sketches of the sets rule most others out (:mod:`siftrank.operators.sketches`), so features travel for little more
    than the result.
    """
    carry = carry or []
    met = columnar(pairs, "met-pairs")
    # Rows that repeat a number are one set here; what is left of its pairs is compared for each of them.
    pairs = columnar(possible_pairs(met, left, right, threshold).distinct(), "possible-pairs")

    def side(sets: DataFrame, name: str) -> DataFrame:
        met = columnar(pairs.select(F.col(name).alias("set_id")).distinct(), "met-sets")
        if met.count() <= MOST_MET:  # sets without a partner stay where they are
            sets = sets.join(F.broadcast(met), "set_id", "left_semi")
        return sets.select(
            F.col("set_id").alias(name), F.col("features").alias(f"f_{name}"),
            *[F.col(c).alias(f"{c}_{name}") for c in carry],
        )

    return pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").select(
        "a", "b", *[f"{c}_{x}" for c in carry for x in "ab"], tanimoto("f_a", "f_b").alias("similarity")
    ).where(F.col("similarity") >= threshold - 1e-12)


def similar_pairs(distinct: DistinctSets, threshold: float = 0.7) -> DataFrame:
    """All pairs ``a < b`` of distinct sets with similarity at or above ``threshold``.

    With ``distinct.members`` this is the whole pair result in compact form:
    rows of one set have similarity 1, rows of two sets the similarity of the
    sets, and ``members_a`` / ``members_b`` give the multiplicities.
    """
    sets = distinct.sets
    width = packed_width(sets)
    if width is not None:
        sizes = sets.select("set_id", "members")
        flags = {"probe": F.lit(True), "target": F.lit(True)}
        found = columnar(packed_pairs(sets.withColumns(flags), threshold, width), "pairs")
        return found.join(sizes.toDF("a", "members_a"), "a").join(sizes.toDF("b", "members_b"), "b").select(
            "a", "b", "members_a", "members_b", "similarity")
    found = _candidates(sets, threshold, sided=False)
    return _verified(found, sets, sets, threshold, ["members"])


def approximate_pairs(distinct: DistinctSets, threshold: float = 0.7, recall: float = 0.95) -> DataFrame:
    """Pairs like those of :func:`similar_pairs`, each with at least the probability ``recall``.

    Sets that share a band of a minwise signature (:mod:`siftrank.operators.minwise`) are compared, and their exact
    similarity decides: no pair is wrong, and a pair above the threshold is likelier found than one at it. A set has
    a fixed number of keys, whatever its features.
    """
    sets = distinct.sets
    found = _meet(banded_keys(sets, threshold, recall, []), threshold, []).distinct()
    return _verified(found, sets, sets, threshold, ["members"])


def similar_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b, similarity)`` across two tables of distinct sets ``(set_id, n, features)``."""
    both = left.select("set_id", "n", "features", F.lit(0).alias("side")).unionByName(
        right.select("set_id", "n", "features", F.lit(1).alias("side"))
    )
    width = packed_width(both)
    if width is not None:
        own = F.when(F.col("side") == 0, F.lit(-1) - F.col("set_id")).otherwise(F.col("set_id")).cast("bigint")
        flags = {"set_id": own, "probe": F.col("side") == 0, "target": F.col("side") == 1}  # one number may stand on both sides
        found = packed_pairs(both.withColumns(flags), threshold, width)
        return found.withColumn("a", F.lit(-1) - F.col("a"))
    found = _candidates(both, threshold, sided=True)
    return _verified(found, left, right, threshold)


def best_partners(sets: DataFrame, cold: int = COLD_TOKEN) -> DataFrame:
    """For every probe set the most similar target set: ``(set_id, partner, similarity)``.

    ``sets(set_id, n, features, probe, target, tie)``: ties in similarity go to
    the smallest ``tie``.  Probes that share no feature with any target are
    absent.  Exact; no list of pairs is ever stored: blocks of sets are crossed
    and compared inside the tasks (:mod:`siftrank.operators.blocks`), where features of
    more than ``cold`` sets of a block stand in a table.  Features that are
    positions in a vector of a fixed width are packed and searched by bounds
    instead.
    """
    width = packed_width(sets)
    if width is not None:
        scored = packed_partners(sets, width)
    else:
        scored = feature_partners(sets, 4 * BLOCK, cold, MASK_TOKENS)
    return _pick(columnar(scored, "partners"), sets.where("target").select(F.col("set_id").alias("b"), "tie"))


def _pick(scored: DataFrame, ties: DataFrame) -> DataFrame:
    """Best partner per probe: keep the top similarity first, resolve ties afterwards."""
    top = scored.groupBy("a").agg(F.max("similarity").alias("similarity"))
    chosen = durable(scored.join(top, ["a", "similarity"]).select("a", "b", "similarity"))
    return (
        attach_counted(chosen, ties, ["b"], "inner")
        .groupBy("a", "similarity").agg(F.min(F.struct("tie", "b")).alias("best"))
        .select(F.col("a").alias("set_id"), F.col("best.b").alias("partner"), "similarity")
    )


def nearest_neighbour(
    df: DataFrame, distinct: DistinctSets, ordinal: str = "ord", label: str = "label",
    position: str = "rank_position", cold: int = COLD_TOKEN,
) -> DataFrame:
    """``(ord, nearest_label, nearest_similarity)`` for every row with features.

    Another row of the same set is always nearest (similarity 1); only sets
    with a single row are searched.  Ties go to the smaller label, then to the
    earlier position.  Rows without any shared feature tie with all others at
    similarity 0; a lone row has no neighbour.
    """
    members = distinct.members.select(ordinal, "set_id", F.struct(label, position).alias("tie"))
    first = members.groupBy("set_id").agg(F.min("tie").alias("first"), F.count("*").alias("copies"))
    with_first = attach_per_key(members, first, ["set_id"], "copies")
    second = with_first.where(F.col("tie") != F.col("first")).groupBy("set_id").agg(
        F.min("tie").alias("second"), F.count("*").alias("others")
    )
    twins = attach_per_key(with_first.where("copies > 1"), second, ["set_id"], "others").select(
        ordinal,
        F.when(F.col("tie") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("near"),
        F.lit(1.0).alias("similarity"),
    )
    sets = distinct.sets.join(first, "set_id").select(
        "set_id", "n", "features", (F.col("copies") == 1).alias("probe"), F.lit(True).alias("target"),
        F.col("first").alias("tie"),
    )
    ties = first.select(F.col("set_id").alias("partner"), F.col("first").alias("near"))
    found = attach_counted(durable(best_partners(sets, cold)), ties, ["partner"], "inner").select(
        "set_id", "near", "similarity"
    )
    # Two smallest rows overall: the neighbour of rows that share nothing.
    lowest = members.orderBy("tie").limit(2).agg(
        F.min("tie").alias("lowest"), F.max("tie").alias("next"), F.count("*").alias("rows")
    )
    singles = with_first.where("copies = 1").join(found, "set_id", "left")
    singles = singles.crossJoin(F.broadcast(lowest)).select(
        ordinal,
        F.when(F.col("near").isNotNull(), F.col("near"))
        .when(F.col("rows") < 2, None)
        .when(F.col("tie") == F.col("lowest"), F.col("next"))
        .otherwise(F.col("lowest")).alias("near"),
        F.when(F.col("near").isNotNull(), F.col("similarity"))
        .when(F.col("rows") >= 2, 0.0).alias("similarity"),
    )
    return twins.unionByName(singles).select(
        ordinal,
        F.col("near")[label].alias("nearest_label"),
        round_dp("similarity", 3).alias("nearest_similarity"),
    )


def reference_is_small(reference: DataFrame) -> bool:
    """Whether rows and features of a reference are few enough to broadcast (measured)."""
    size = reference.select(F.size("features").alias("n")).limit(SMALL_REFERENCE + 1).agg(
        F.count("*").alias("rows"), F.sum("n").alias("features")
    ).first()
    return size["rows"] <= SMALL_REFERENCE and (size["features"] or 0) <= SMALL_REFERENCE_FEATURES


def _closest_small(rows: DataFrame, reference: DataFrame, ordinal: str) -> DataFrame:
    """Scan a reference of checked size inside the tasks, a batch of rows at a time."""
    table = reference.select("position", F.col("features").cast("array<bigint>").alias("features")).orderBy(
        "position"
    ).toPandas()
    if table.empty:
        return rows.limit(0).select(
            ordinal, F.lit(0).cast("bigint").alias("closest_position"), F.lit(0.0).alias("closest_similarity")
        )
    sizes = np.array([len(f) for f in table["features"]])
    owner = np.repeat(np.arange(len(table)), sizes)
    feature = np.concatenate(list(table["features"])).astype(np.int64)
    order = np.argsort(feature, kind="stable")
    shared_index = rows.sparkSession.sparkContext.broadcast(
        (table["position"].to_numpy(np.int64), sizes, feature[order], owner[order])
    )

    @F.pandas_udf("closest_position bigint, similarity double")
    def closest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        position, size, sorted_features, owners = shared_index.value
        step = max(1, 4_000_000 // len(position))
        for features in batches:
            parts = []
            for start in range(0, len(features), step):
                block = features.iloc[start:start + step]
                n = np.array([len(f) for f in block])
                flat = np.concatenate(list(block)).astype(np.int64)
                low = np.searchsorted(sorted_features, flat, "left")
                hits = np.searchsorted(sorted_features, flat, "right") - low
                inside = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
                cell = np.repeat(np.repeat(np.arange(len(n)), n), hits) * len(position)
                cell = cell + owners[np.repeat(low, hits) + inside]
                shared = np.bincount(cell, minlength=len(n) * len(position)).reshape(len(n), -1)
                ratio_ = shared / (n[:, None] + size[None, :] - shared)
                best = ratio_.argmax(axis=1)  # the first maximum is the first position
                parts.append(pd.DataFrame({
                    "closest_position": position[best], "similarity": ratio_[np.arange(len(n)), best],
                }))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(
                {"closest_position": np.array([], np.int64), "similarity": np.array([], float)}
            )

    scored = rows.select(ordinal, closest(F.col("features").cast("array<bigint>")).alias("c"))
    return scored.select(ordinal, "c.closest_position", round_dp("c.similarity", 3).alias("closest_similarity"))


def closest_reference(
    candidates: DataFrame, reference: DataFrame, ordinal: str = "ord", small: bool | None = None,
    cold: int = COLD_TOKEN,
) -> DataFrame:
    """``(ord, closest_position, closest_similarity)`` per candidate with features.

    ``reference(position, features)``.  Ties go to the first position; a
    candidate that shares nothing still gets the first reference, at 0.  A
    reference of measured small size is broadcast and scanned inside the tasks
    without emitting pairs; a large one goes through the inverted index.
    """
    reference = reference.select("position", "features")
    rows = candidates.select(ordinal, "features")
    if small is not False:
        reference = durable(reference).where(F.size("features") > 0)
    if reference_is_small(reference) if small is None else small:
        return _closest_small(durable(rows).where(F.size("features") > 0), reference, ordinal)

    # The features are stored once, by the next step, which then leaves out rows without any: a filter here would be
    # pushed below and make Spark compute them twice.
    probes = collapse_sets(rows, ordinal, "features")
    targets = collapse_sets(reference, "position", "features")
    shift = F.lit(-1).cast("bigint")
    both = probes.sets.select(
        F.col("set_id").cast("bigint").alias("set_id"), "n", "features", F.lit(True).alias("probe"),
        F.lit(False).alias("target"), F.lit(None).cast("bigint").alias("tie"),
    ).unionByName(targets.sets.select(
        (shift - F.col("set_id")).cast("bigint").alias("set_id"), "n", "features",
        F.lit(False).alias("probe"), F.lit(True).alias("target"), F.col("set_id").cast("bigint").alias("tie"),
    ))
    found = best_partners(both, cold).select(
        "set_id", (shift - F.col("partner")).alias("closest_position"), "similarity"
    )
    start = targets.members.agg(F.min("position").alias("start"))
    sizes = probes.sets.select("set_id", "members").join(found, "set_id", "left")
    return (
        attach_per_key(probes.members, sizes, ["set_id"], "members")
        .crossJoin(F.broadcast(start))
        .where(F.col("start").isNotNull())
        .select(
            ordinal, F.coalesce("closest_position", "start").alias("closest_position"),
            round_dp(F.coalesce("similarity", F.lit(0.0)), 3).alias("closest_similarity"),
        )
    )

