"""Similarity, clustering and projection against brute force, with every skew path forced."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import minwise as MW
from siftrank.operators import packed as PK
from siftrank.operators import signatures as SG
from siftrank.operators import similarity as SM
from siftrank.operators.clustering import butina_cluster, cluster_columns, sphere_exclusion
from siftrank.operators.joins import attach_per_key, dense_positions, rank_positions
from siftrank.operators.projection import project_2d


def sim(a, b):
    return len(a & b) / len(a | b)


def make(seed, n=60, hot=True):
    """Random sets; a third are copies of one set and two features are in almost all sets."""
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if i % 3 == 0:
            s = {1, 2, 3, 4, 5, 6, 7}
        elif i % 3 == 1 and sets:
            s = set(rng.choice(sets)) ^ {rng.randint(1, 40)}
        else:
            s = set(rng.sample(range(1, 400), rng.randint(1, 12)))
        if hot and i % 5:
            s |= {900, 901}
        sets.append(s or {i + 1000})
    return sets


def frame(spark, sets):
    rows = [(i, f"L{(i * 7) % 31:02d}", (i * 13 % 50) / 50, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "ord bigint, label string, priority_score double, features array<bigint>")
    return rank_positions(df)


@pytest.fixture(params=["plain", "skewed", "many_hot", "packed"])
def paths(request, monkeypatch):
    if request.param == "packed":
        monkeypatch.setattr(PK, "BLOCK", 3)
        monkeypatch.setattr(PK, "PROBES", 4)
        return request.param
    monkeypatch.setattr(PK, "PACKED_BITS", 0)
    if request.param == "many_hot":
        monkeypatch.setattr(SM, "MASK_TOKENS", 1)
    if request.param != "plain":
        monkeypatch.setattr(SM, "HOT_TOKEN", 3)
        monkeypatch.setattr(SM, "BLOCK", 4)
        monkeypatch.setattr(SM, "COLD_TOKEN", 3)
    return request.param


@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_similar_pairs(spark, paths, threshold):
    sets = make(1)
    distinct = SM.collapse_sets(frame(spark, sets), "ord", "features")
    got = {(r["a"], r["b"]): r["similarity"] for r in SM.similar_pairs(distinct, threshold).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j and sim(a, b) >= threshold - 1e-12:
                want[(i, j)] = sim(a, b)
    assert got == want and want


def test_similar_between(spark, paths):
    left, right = make(2, 40), make(3, 40)
    a = SM.collapse_sets(frame(spark, left), "ord", "features").sets
    b = SM.collapse_sets(frame(spark, right), "ord", "features").sets
    got = {(r["a"], r["b"]) for r in SM.similar_between(a, b, 0.5).collect()}
    la, lb = {}, {}
    for i, s in enumerate(left):
        la.setdefault(frozenset(s), i)
    for i, s in enumerate(right):
        lb.setdefault(frozenset(s), i)
    assert got == {(i, j) for x, i in la.items() for y, j in lb.items() if sim(x, y) >= 0.5 - 1e-12}


@pytest.mark.parametrize("seed", [4, 5])
def test_nearest_neighbour(spark, paths, seed):
    sets = make(seed, 45)
    rows = frame(spark, sets)
    distinct = SM.collapse_sets(rows, "ord", "features")
    got = {r["ord"]: (r["nearest_label"], r["nearest_similarity"])
           for r in SM.nearest_neighbour(rows, distinct, cold=SM.COLD_TOKEN).collect()}
    meta = {r["ord"]: (r["label"], r["rank_position"]) for r in rows.collect()}
    for i, s in enumerate(sets):
        best = min((-sim(s, t), *meta[j]) for j, t in enumerate(sets) if i != j)
        assert got[i] == (best[1], round(-best[0] + 1e-12, 3)), i


def test_lone_row_has_no_neighbour(spark):
    rows = frame(spark, [{1, 2}])
    got = SM.nearest_neighbour(rows, SM.collapse_sets(rows, "ord", "features")).first()
    assert got["nearest_label"] is None and got["nearest_similarity"] is None


@pytest.mark.parametrize("small", [True, False])
def test_closest_reference(spark, paths, small):
    sets, refs = make(6, 40), make(7, 20)
    ref = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(refs)], "position bigint, features array<bigint>")
    got = {r["ord"]: (r["closest_position"], r["closest_similarity"]) for r in
           SM.closest_reference(frame(spark, sets), ref, small=small, cold=SM.COLD_TOKEN).collect()}
    for i, s in enumerate(sets):
        best = min((-sim(s, t), j) for j, t in enumerate(refs))
        assert got[i] == (best[1], round(-best[0] + 1e-12, 3))


def sequential_clusters(sets, position, threshold):
    n = len(sets)
    near = [[j for j in range(n) if j != i and sim(sets[i], sets[j]) >= threshold - 1e-12] for i in range(n)]
    owner = {}
    for i in sorted(range(n), key=lambda i: (len(near[i]), position[i]), reverse=True):
        if i not in owner:
            owner[i] = i
            for j in near[i]:
                owner.setdefault(j, i)
    return owner


@pytest.mark.parametrize("seed", [8, 9])
def test_clusters_equal_the_sequential_algorithm(spark, paths, seed):
    sets = make(seed, 50)
    rows = frame(spark, sets)
    distinct = SM.collapse_sets(rows, "ord", "features")
    pairs = SM.similar_pairs(distinct, 0.6)
    got = butina_cluster(distinct, pairs).collect()
    position = {r["ord"]: r["rank_position"] for r in rows.collect()}
    want = sequential_clusters(sets, position, 0.6)

    def groups(owner):
        out = {}
        for k, v in owner.items():
            out.setdefault(v, set()).add(k)
        return sorted(map(sorted, out.values()))

    assert groups({r["ord"]: r["centroid"] for r in got}) == groups(want)


def test_cluster_columns(spark):
    rows = spark.createDataFrame(
        [(1, 0.4, "low", 1), (1, 0.9, "high", 0), (2, 0.6, "benzene", 2)],
        "centroid int, priority_score double, label string, rank_position bigint")
    out = {r["label"]: r for r in cluster_columns(rows).collect()}
    assert out["high"]["diversity_representative"] and not out["low"]["diversity_representative"]
    assert out["high"]["diversity_cluster_size"] == 2 and out["benzene"]["diversity_cluster_id"] == 1
    assert out["high"]["diversity_cluster_id"] == out["low"]["diversity_cluster_id"] == 2


def test_projection_keeps_svd_geometry(spark):
    rng = np.random.default_rng(0)
    x = (rng.random((40, 30)) < np.linspace(0.1, 0.9, 30)).astype(float)
    rows = [(i, [int(b) for b in np.flatnonzero(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "ord bigint, features array<int>")
    got = {r["ord"]: (r["chemical_space_x"], r["chemical_space_y"]) for r in project_2d(df, n_bits=30).collect()}
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    have = np.array([got[i] for i in range(len(x))])
    assert np.allclose(np.abs(have), np.abs(want), atol=2e-6)


def test_projection_of_wide_vectors(spark):
    """2,048 bits: the range finder's axes are the leading ones of a singular value decomposition."""
    rng = np.random.default_rng(3)
    x = (rng.random((300, 2048)) < 0.05).astype(float)
    x[:120, :300] = np.maximum(x[:120, :300], rng.random((120, 300)) < 0.2)
    x[200:, 500:900] = np.maximum(x[200:, 500:900], rng.random((100, 400)) < 0.1)
    rows = [(i, [int(b) for b in np.flatnonzero(r)]) for i, r in enumerate(x)]
    got = {r["ord"]: (r["chemical_space_x"], r["chemical_space_y"]) for r in project_2d(
        spark.createDataFrame(rows, "ord bigint, features array<int>").repartition(5)).collect()}
    centred = x - x.mean(axis=0)
    want = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(np.array([got[i] for i in range(len(x))])), np.abs(want), atol=2e-6)


def test_long_chain_of_priorities_is_settled_in_one_part(spark):
    """100,000 points, each outranked by the next: every second one from the top is a centroid."""
    n = 100_000
    points = spark.range(n).selectExpr("id as set_id", "1L as members", "id as position")
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    got = {r.set_id: r.centroid for r in sphere_exclusion(points, edges, 2 * n - 2).collect()}
    near, owner = (lambda i: [j for j in (i - 1, i + 1) if 0 <= j < n]), {}
    for i in sorted(range(n), key=lambda i: (len(near(i)), i), reverse=True):
        if i not in owner:
            owner[i] = i
            for j in near(i):
                owner.setdefault(j, i)
    assert {k for k, v in got.items() if k == v} == {k for k, v in owner.items() if k == v}
    assert len(got) == n


@pytest.mark.parametrize("part_links", [0, 10, 1_000_000])
def test_parts_of_any_size_give_the_same_clusters(spark, part_links):
    rng = random.Random(31)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)} | {(100, 101), (101, 102), (102, 103), (200, 201)}
    points = spark.createDataFrame([(i, 1, i * 37 % 211) for i in [*range(60), *range(100, 104), 200, 201, 300]], "set_id long, members long, position long")
    got = sphere_exclusion(points, spark.createDataFrame(sorted(edges), "a long, b long"), part_links)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rank = {r.set_id: (len(near.get(r.set_id, ())), r.position) for r in points.collect()}
    owner, centroids = {}, []
    for i in sorted(rank, key=rank.get, reverse=True):
        if i not in owner:
            centroids.append(i)
            owner.update({j: i for j in near.get(i, ()) if j not in owner} | {i: i})
    best = {i: i if i in centroids else max((j for j in near[i] if j in centroids), key=rank.get) for i in rank}
    assert {r.set_id: r.centroid for r in got.collect()} == best


def test_projection_of_one_row(spark):
    df = spark.createDataFrame([(1, [3, 4])], "ord bigint, features array<int>")
    row = project_2d(df, n_bits=8).first()
    assert (row["chemical_space_x"], row["chemical_space_y"]) == (0.0, 0.0) and row["chemical_space_warning"]


def test_attach_per_key_with_hot_keys(spark):
    rows = spark.range(100).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    per = rows.groupBy("k").agg(F.count("*").alias("w"), F.sum("id").alias("s")).where("k <> 5")
    for how in ("left", "inner"):
        plain = rows.join(per, "k", how).select("id", "k", "w", "s")
        hot = attach_per_key(rows, per, ["k"], "w", how, hot_rows=20).select("id", "k", "w", "s")
        assert sorted(map(str, hot.collect())) == sorted(map(str, plain.collect()))


def test_positions(spark):
    df = spark.range(1000).select(F.col("id").alias("ord"), (F.col("id") * 37 % 11 / 10).alias("priority_score"))
    rows = df.collect()
    want = {r["ord"]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r["priority_score"], r["ord"])))}
    assert {r["ord"]: r["rank_position"] for r in rank_positions(df).collect()} == want
    placed = dense_positions(df.repartition(7), [F.desc("priority_score"), F.asc("ord")], "p")
    assert {r["ord"]: r["p"] for r in placed.collect()} == want


def test_one_key_with_most_rows_is_spread(spark):
    from siftrank.operators.identity import identity_join
    from siftrank.operators.joins import attach_per_key
    from siftrank.operators.lookups import lookup_documents

    rows = spark.range(3000).selectExpr("id", "if(id % 10 > 0, 0, id) as k")
    per_key = rows.groupBy("k").count().withColumn("v", F.col("k") * 2)
    got = attach_per_key(rows, per_key, ["k"], "count", hot_rows=100)
    assert got.where("v = k * 2").count() == 3000
    sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 0.6 * 3000
    candidates = spark.range(2000).selectExpr("id as ord", "true as valid_molecule", "if(id % 10 > 0, 'copy', concat('t', id)) as canonical_smiles")
    reference = spark.createDataFrame([("copy", "N", "S", "1")], "key string, name string, source string, compound_id string")
    assert identity_join(candidates, reference).where("known_compound_match").count() == 1800
    keys = spark.range(2000).selectExpr("concat('k', id) as identity_key", "'c' as cid", "'m' as molecule_id")
    chemicals = spark.range(200).selectExpr("concat('k', id) as identity_key", "id as ord", "'X' as chemical_id")
    documents = spark.createDataFrame([("X", 1, "d", "t"), ("X", 2, "e", "u")], "chemical_id string, pos long, doc_id string, title string")
    found = lookup_documents(keys, chemicals, documents).select("identity_key", "result.*")
    assert found.count() == 2000 and found.where("patent_record_count = 2").count() == 200


def wide(seed, n, width=2048):
    """Sets of bits of very different sizes: families of near copies, dense ones and single bits."""
    rng = random.Random(seed)
    sets = []
    for i in range(n):
        if i % 3 == 0 and sets:
            s = set(rng.choice(sets)) ^ set(rng.sample(range(width), rng.randint(0, 12)))
        else:
            s = set(rng.sample(range(width), rng.choice([1, 3, 20, 60, 60, 150, 400, 1500, width])))
        sets.append(s or {i})
    return sets


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_fixed_width_pairs(spark, threshold, monkeypatch):
    monkeypatch.setattr(PK, "BLOCK", 16)
    sets = wide(11, 150)
    distinct = SM.collapse_sets(frame(spark, sets), "ord", "features")
    got = {(r["a"], r["b"]): r["similarity"] for r in SM.similar_pairs(distinct, threshold).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    assert got == {(i, j): sim(a, b) for a, i in first.items() for b, j in first.items() if i < j and sim(a, b) >= threshold - 1e-12}


def test_fixed_width_neighbours(spark, monkeypatch):
    monkeypatch.setattr(PK, "BLOCK", 16)
    monkeypatch.setattr(PK, "PROBES", 8)
    sets = wide(12, 140)
    rows = frame(spark, sets)
    got = {r["ord"]: (r["nearest_label"], r["nearest_similarity"])
           for r in SM.nearest_neighbour(rows, SM.collapse_sets(rows, "ord", "features")).collect()}
    meta = {r["ord"]: (r["label"], r["rank_position"]) for r in rows.collect()}
    for i, s in enumerate(sets):
        best = min((-sim(s, t), *meta[j]) for j, t in enumerate(sets) if i != j)
        assert got[i] == (best[1], round(-best[0] + 1e-12, 3)), i


def test_bounds_pass_over_most_blocks(spark, monkeypatch):
    """Families of near copies: the partner is found in the first blocks, and few others are searched."""
    monkeypatch.setattr(PK, "BLOCK", 8)
    rng = random.Random(13)
    sets = []
    for _ in range(40):
        centre = set(rng.sample(range(2048), rng.randint(20, 900)))
        sets += [centre ^ set(rng.sample(range(2048), 3)) for _ in range(10)]
    rows = spark.createDataFrame([(i, sorted(s), len(s), i) for i, s in enumerate(sets)], "set_id long, features array<int>, n int, tie int")
    packed = PK._packed(rows, 2048, "test")
    blocks = PK._Blocks(packed.select("bits", "set_id", "n", "tie"), 2048)
    routes = blocks.routes(packed.select("bits", "set_id", F.lit(0.9).alias("bound")))
    assert routes.count() < 0.15 * len(sets) * len(blocks.bounds)


def test_similar_sets_share_a_signature(spark):
    """Every pair at the threshold shares a key, and the keys of a set grow with its size alone."""
    rng = random.Random(14)
    rows = []
    for i in range(120):
        s = set(rng.sample(range(10 ** 9), rng.choice([1, 2, 3, 5, 9, 30, 120])))
        rows.append(s)
        for _ in range(3):
            change = rng.randint(0, max(1, len(s) // 5))
            rows.append((s - set(rng.sample(sorted(s), min(change, len(s) - 1)))) | set(rng.sample(range(10 ** 9), rng.randint(0, change))))
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(rows)], "set_id long, n int, features array<bigint>")
    for threshold in (0.5, 0.7, 0.85):
        keys = {}
        for r in SG.signature_keys(df, threshold, []).collect():
            keys.setdefault(r["set_id"], set()).add(r["key"])
        met = 0
        for i, a in enumerate(rows):
            assert len(keys[i]) <= 40 + 90 * (1 - threshold) / threshold * len(a)
            for j in range(i):
                near = sim(a, rows[j]) >= threshold
                assert not near or keys[i] & keys[j]
                met += not near and bool(keys[i] & keys[j])
        assert threshold < 0.7 or met < 0.05 * len(rows) ** 2 / 2


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_approximate_pairs(spark, threshold):
    """Every pair found is right, and the wanted recall is reached on the exact join's pairs."""
    rng = random.Random(21)
    sets = []
    for _ in range(150):
        centre = set(rng.sample(range(10 ** 6), rng.randint(5, 60)))
        sets += [centre, (centre - set(rng.sample(sorted(centre), len(centre) // 8))) | {rng.randint(1, 10 ** 6)}, centre | {rng.randint(1, 99)}]
    distinct = SM.collapse_sets(frame(spark, sets), "ord", "features")
    exact = {(r["a"], r["b"]): r["similarity"] for r in SM.similar_pairs(distinct, threshold).collect()}
    found = {(r["a"], r["b"]): r["similarity"] for r in SM.approximate_pairs(distinct, threshold, 0.95).collect()}
    assert all(exact[p] == s for p, s in found.items())
    assert len(found) >= 0.9 * len(exact) > 100
    bands, rows = MW.choose_bands(threshold, 0.95)
    assert 1 - (1 - threshold ** rows) ** bands >= 0.95


def test_vectors_are_stored_once_for_all_blocks(spark, monkeypatch):
    """Nothing is alike, so every block is searched for every vector, yet each vector is stored in one block only."""
    monkeypatch.setattr(PK, "BLOCK", 8)
    rng = random.Random(17)
    rows = [(i, rng.sample(range(2048), 60), 60, i, True, True) for i in range(200)]
    df = spark.createDataFrame(rows, "set_id long, features array<int>, n int, tie int, probe boolean, target boolean")
    blocks = PK._Blocks(PK._packed(df, 2048, "test"), 2048)
    assert blocks.table.agg(F.sum(F.length("bits"))).first()[0] == 200 * 256
    assert sum(len(r["ids"]) // 8 for r in blocks.bounded_probes().collect()) == 200


def test_partners_without_a_list_of_pairs(spark):
    """All sets share a few features with all others; what leaves the tasks is a few rows a set."""
    from siftrank.operators.blocks import feature_partners

    rng = random.Random(18)
    rows = [(i, 30, rng.sample(range(10 ** 6, 10 ** 6 + 120), 30), True, True, i) for i in range(150)]
    df = spark.createDataFrame(rows, "set_id long, n int, features array<bigint>, probe boolean, target boolean, tie int")
    found = feature_partners(df, 10, 5, 4).collect()
    assert len(found) < 150 * 30
    best = {}
    for r in found:
        best[r.a] = min(best.get(r.a, (0, 0)), (-r.similarity, r.b))
    sets = [set(r[2]) for r in rows]
    assert best == {i: min((-sim(s, t), j) for j, t in enumerate(sets) if i != j) for i, s in enumerate(sets)}


@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_pairs_by_frequent_tokens(spark, threshold, monkeypatch):
    """Every set counts for the order of the tokens, and every token of four sets is no key of its own."""
    monkeypatch.setattr(SM, "HOT_TOKEN", 3)
    monkeypatch.setattr(SM, "SAMPLED", 1)
    monkeypatch.setattr(SM, "MOST_LATE", 5)
    monkeypatch.setattr(PK, "PACKED_BITS", 0)
    sets = make(23, 90)
    distinct = SM.collapse_sets(frame(spark, sets), "ord", "features")
    order = SM.token_order(distinct.sets)
    assert 0 < order.frequent <= len(order.tokens) and (np.diff(order.tokens) > 0).all()
    got = {(r["a"], r["b"]): r["similarity"] for r in SM.similar_pairs(distinct, threshold).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(i, j): sim(a, b) for a, i in first.items() for b, j in first.items() if i < j and sim(a, b) >= threshold - 1e-12}
    assert got == want and want


def test_sketches_never_hide_a_pair(spark):
    """A sketch bounds the differences from below, whatever the sizes, and rules out pairs that only share a passage."""
    from siftrank.operators import sketches as SK

    rng = random.Random(24)
    passage = set(rng.sample(range(10 ** 9), 120))
    sets = [passage | set(rng.sample(range(10 ** 9), rng.choice([130, 200, 400]))) for _ in range(60)]
    sets += [s - set(rng.sample(sorted(s), 12)) for s in sets[:20]]
    flat = np.concatenate([np.array(sorted(s), np.int64) for s in sets])
    made = SK.sketches(flat, np.array([len(s) for s in sets]))
    for x, a in zip(made, sets):
        for y, b in zip(made, sets):
            assert SK.least_differences(x, y) <= len(a ^ b)
    df = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "set_id bigint, n int, features array<bigint>")
    every = [(i, j) for i in range(len(sets)) for j in range(i)]
    left = {tuple(r) for r in SK.possible_pairs(spark.createDataFrame(every, "a bigint, b bigint"), df, df, 0.7).collect()}
    near = {(i, j) for i, j in every if sim(sets[i], sets[j]) >= 0.7}
    assert near <= left and len(near) == 20 and len(left) < 0.1 * len(every)


def test_features_stay_where_they_are(spark, monkeypatch):
    """Sets are read without a shuffle of their features unless the copied ones are too many to broadcast; rows are the same."""
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [2, 1]), (3, []), (None, [9]), (4, [3]), (5, [7, 8])],
                                 "ord bigint, features array<bigint>")
    found = {}
    for most in (0, 1 << 19):
        monkeypatch.setattr(SM, "MOST_COPIED", most)
        sets = SM.collapse_sets(rows, "ord", "features").sets
        found[most] = {(r["set_id"], r["n"], tuple(sorted(r["features"])), r["members"]) for r in sets.collect()}
    assert found[0] == found[1 << 19] == {(0, 2, (1, 2), 2), (1, 1, (3,), 2), (5, 2, (7, 8), 1)}
    sets.collect()
    assert "hashpartitioning" not in sets._jdf.queryExecution().executedPlan().toString()


def test_features_of_a_large_reference_are_stored_once_and_not_shuffled(spark, monkeypatch):
    from siftrank.operators import blocks, similarity

    rng = random.Random(9)
    sets = [rng.sample(range(10_000, 11_000), rng.randint(3, 40)) for _ in range(120)] + [[]]
    frame = lambda some, name: spark.createDataFrame([(i, s) for i, s in enumerate(some)], f"{name} long, features array<bigint>")
    probes, targets = sets[:60] + [[]], sets[60:]
    kept, plans = similarity.durable, []
    monkeypatch.setattr(similarity, "durable", lambda df: plans.append(df.columns) or kept(df))
    found = {}
    for limit in (blocks.FILE_BYTES, 0):  # a small table, and one that counts as large
        monkeypatch.setattr(blocks, "FILE_BYTES", limit or 1)
        steps, keep = [], blocks.columnar
        monkeypatch.setattr(blocks, "columnar", lambda df, *a, steps=steps, keep=keep: steps.append(df) or keep(df, *a))
        got = similarity.closest_reference(frame(probes, "ord"), frame(targets, "position"), small=False)
        found[limit] = sorted(map(tuple, got.collect()))
        monkeypatch.setattr(blocks, "columnar", keep)
        shuffled = "REPARTITION_BY_NUM" in steps[0]._jdf.queryExecution().executedPlan().toString()
        assert shuffled == bool(limit)
    assert not any("features" in columns for columns in plans)
    def best(s):
        value, place = max((len(set(s) & set(t)) / len(set(s) | set(t)), -j) for j, t in enumerate(targets) if t)
        return -place, round(value, 3)
    want = [(i, *best(s)) for i, s in enumerate(probes) if s]
    for rows in found.values():
        assert [r[:2] for r in rows] == [w[:2] for w in want] and all(abs(r[2] - w[2]) <= 0.0011 for r, w in zip(rows, want, strict=True))


def test_blocks_hold_only_features_that_meet(spark):
    """Most features stand in one set and cannot count; sets of one number and other features stay apart."""
    from siftrank.operators.blocks import feature_blocks, feature_partners

    rng = random.Random(31)
    private = iter(range(10 ** 9, 10 ** 10))
    sets = [set(rng.sample(range(10 ** 6, 10 ** 6 + 60), rng.randint(0, 12))) | {next(private) for _ in range(rng.choice([1, 5, 90, 700]))}
            for _ in range(130)]
    sets += [sets[0] | {next(private)}, {next(private)}]
    rows = [(i, len(s), sorted(s), True, i % 3 > 0, (f"L{i % 7}", i)) for i, s in enumerate(sets)]
    rows += [rows[1], (2, 3, [10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2], True, True, ("L2", 2))]
    df = spark.createDataFrame(
        rows, "set_id long, n int, features array<bigint>, probe boolean, target boolean, tie struct<label: string, place: long>")
    uses = {}
    for r in rows[:-2] + rows[-1:]:
        for f in r[2]:
            uses.setdefault(f, []).append(r[4])
    held = feature_blocks(df, 10).agg(F.sum(F.length("owners"))).first()[0] // 2
    assert held == sum(len(u) for u in uses.values() if len(u) > 1 and any(u)) < 0.1 * sum(r[1] for r in rows)
    found = {}
    for cold, together in ((0, 3), (2, 1_000), (1_000, 1)):
        best = {}
        for r in feature_partners(df, 10, cold, together).collect():
            best[r.a] = min(best.get(r.a, (0, ("M", 0))), (-r.similarity, (f"L{r.b % 7}", r.b)))
        found[cold] = best
    want = {}
    for r in rows:
        for t in rows:
            value = sim(set(r[2]), set(t[2]))
            if r[0] != t[0] and t[4] and value:
                want[r[0]] = min(want.get(r[0], (0, ("M", 0))), (-value, t[5]))
    assert found[0] == found[2] == found[1_000] == want


def test_vectors_meet_in_few_cells_and_by_products(spark):
    """Blocks are not cut smaller than sizes ask for, and a product counts the same common bits as the words do."""
    rng = np.random.default_rng(33)
    for most, rows, others in ((3, 70, 101), (60, 64, 64), (255, 90, 131), (256, 65, 67), (1024, 71, 90)):
        left, right = (rng.random((n, 1024)) < most / 1100 for n in (rows, others))
        left[0, :], right[1, :], right[-1, :] = False, False, False
        left[1, :most] = right[0, :most] = right[-1, :most] = True
        words = [np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (left, right)]
        assert (PK._shared(*words) == left.astype(int) @ right.astype(int).T).all()
    assert PK.EXACT_BITS <= 24
    random.seed(34)
    rows = [(i, random.sample(range(2048), n), n, i) for i, n in ((i, random.randint(300, 400)) for i in range(1_600))]
    df = spark.createDataFrame(rows, "set_id long, features array<int>, n int, tie int")
    assert len(PK._Blocks(PK._packed(df, 2048, "test"), 2048).bounds) <= 3


def test_ranks_do_not_move_features(spark, monkeypatch):
    """Rows are ranked after their sets are stored: no step that ranks them holds or shuffles features."""
    from siftrank.plans import queries_similar as Q

    sets = make(35, 40)
    rows = spark.createDataFrame([(i, (i * 13 % 50) / 50, sorted(s)) for i, s in enumerate(sets)],
                                 "ord bigint, priority_score double, features array<bigint>")
    order = sorted((-r["priority_score"], r["ord"]) for r in rows.collect())
    held, plans = [], []
    for module in (Q, SM):
        monkeypatch.setattr(module, "durable", lambda df, keep=module.durable: held.append(df.columns) or keep(df))
    monkeypatch.setattr(SM, "columnar", lambda df, *a, keep=SM.columnar: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, *a))
    distinct = Q.ranked_sets(rows)
    assert held and not any("features" in columns for columns in held)
    assert not any("Window" in p or "hashpartitioning" in p for p in plans)
    got = {r["ord"]: r["rank_position"] for r in distinct.members.collect()}
    assert got == {o: i for i, (_, o) in enumerate(order)}
