import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from siftrank.llm.golay import codeword_index, nearby_indices
from siftrank.llm.simhash_dedup import fingerprint_links, group_near_duplicates

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("fp", T.StringType())])


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_groups(keys, near):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = list(keys)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if near(a, b):
                parent[root(a)] = root(b)
    return {k: root(k) for k in ordered}


def test_codewords_cover_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000).astype(np.uint32)
    assert len(np.unique(codeword_index(np.arange(1 << 23, dtype=np.uint32)))) == 4096
    for _ in range(20):
        a, b = rng.integers(0, 23, 2)
        other = words ^ np.uint32(1 << a) ^ np.uint32(1 << b)
        x, y = nearby_indices(words), nearby_indices(other)
        assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
    assert {len(set(r)) for r in nearby_indices(words).tolist()} == {1, 6}


def test_links_join_all_within_two_bits(spark):
    rng = random.Random(2)
    fps = {0}
    while len(fps) < 400:
        fp = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(fps))
        for _ in range(rng.randint(0, 3)):
            fp ^= 1 << rng.randint(0, 63)
        fps.add(fp)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << b for b in range(64)} | {centre ^ 1 << 63 ^ 1 << b for b in range(50)}  # crowded keys
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(r.a, r.b) for r in fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all(near(a, b) for a, b in links)
    joined = {frozenset(x) for x in links}
    expected, got = brute_groups(signed, near), brute_groups(signed, lambda a, b: frozenset((a, b)) in joined)
    classes = lambda g: {frozenset(k for k in g if g[k] == r) for r in g.values()}
    assert classes(expected) == classes(got)


def test_records_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = [(None, None), (3, ""), (2, " \n"), (7, "One"), (8, "one"), (9, "one two"), (9, "one two"), (1, "É é")]
    for i in range(60):
        text = rng.choice(rows)[1] if rng.random() < 0.3 else " ".join(rng.choices(vocabulary, k=rng.randint(3, 80)))
        words = (text or "").split(" ")
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    rows += [(300, "long " * 5000), (301, "long " * 5001)]
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(range(len(rows)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {}
    for k, g in groups.items():
        if rows[k][0] is not None:
            least[g] = min(least.get(g, 10**9), rows[k][0])
    expected = sorted(((rows[k][0], f"{fps[k]:016x}", least.get(groups[k])) for k in range(len(rows))), key=str)
    got = group_near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected


def test_empty_table(spark):
    assert group_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
