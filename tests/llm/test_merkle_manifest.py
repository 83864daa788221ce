import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm import merkle_manifest
from siftrank.llm.merkle_manifest import dataset_manifest, fold_proof, leaf_digest, verify_manifest

COLUMNS = ("molecule_id", "job_id", "priority_score", "evidence_summary_notes")
SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("job_id", T.StringType()),
                       T.StructField("priority_score", T.DoubleType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("leaf", T.StringType()), T.StructField("g", T.LongType()), T.StructField("group", T.LongType())])


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root and the siblings of each leaf, level by level."""
    siblings = [[] for _ in nodes]
    owner = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf in range(len(siblings)):
            at = owner[leaf]
            start = at // 8 * 8
            siblings[leaf] += [n for i, n in enumerate(nodes[start:start + 8], start) if i != at]
            owner[leaf] = at // 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], siblings


def brute(rows):
    leaves = [(r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, h(*map(value, r[:4])), r) for r in rows]
    groups = {}
    for leaf in sorted(leaves, key=lambda x: x[:5]):
        groups.setdefault(leaf[:2], []).append(leaf)
    built = [tree([x[4] for x in g]) for g in groups.values()]
    root, above = tree([b[0] for b in built])
    out = []
    for (subroot, siblings), g, up in zip(built, groups.values(), above):
        for x, own in zip(g, siblings):
            out.append((x[5][0], x[5][1], x[4], subroot, root, "".join(own + up)))
    return out


def sample(n, runs):
    rng = random.Random(n)
    rows = [(i, rng.choice(runs), rng.choice([None, 0.5]), rng.choice([None, "", "Ab é", "x" * 3])) for i in range(n)]
    rows += [(None, runs[0], None, "a"), (None, runs[0], None, None), (3, runs[0], 0.5, "same"), (3, runs[0], 0.5, "same"),
             (-5, runs[0], 1.0, "long " * 30_000)]
    rng.shuffle(rows)
    return [(*r, "own leaf", 7, 8) for r in rows]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    changed = leaf_digest([F.col(c) if c != "evidence_summary_notes" else F.lower(c) for c in COLUMNS])
    found = verify_manifest(dataset_manifest(df, leaf_columns=COLUMNS, also={"changed": changed}), "changed").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r.molecule_id, r.job_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex()) for r in found]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    for r in found:
        assert r.verified == (r.changed == r.leaf) == (r.folded_root == r.root)
        places = [(r.position, r.group_size), (r.group_place, r.group_count)]
        assert fold_proof(bytes(r.leaf), bytes(r.proof), places) == r.root


@pytest.mark.parametrize("height", [1, 2, 5])
def test_matches_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(merkle_manifest, "HEIGHT", height)
    check(spark, sample(300, ["en"] * 6 + ["de", None, "É", "lone"]))


def test_many_runs_and_single_records(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "HEIGHT", 1)
    check(spark, sample(120, [f"run{i}" for i in range(70)]))
    check(spark, sample(0, ["only"])[:1])


def test_sizes_around_eight(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "HEIGHT", 1)
    check(spark, [(i, f"r{n}", None, "t", "", 0, 0) for n in (1, 7, 8, 9, 64, 65) for i in range(n)])


def test_broken_digests_are_not_verified(spark):
    df = spark.createDataFrame([(i, "a", None, "t", "", 0, 0) for i in range(20)], SCHEMA)
    found = verify_manifest(dataset_manifest(df, leaf_columns=COLUMNS, also={"none": F.lit(None).cast("binary")}), "none").collect()
    assert all(r.folded_root is None and not r.verified for r in found)
    with pytest.raises(ValueError):
        dataset_manifest(df, leaf_columns=COLUMNS, also={"proof": F.lit(1)})


def test_empty_table(spark):
    assert verify_manifest(dataset_manifest(spark.createDataFrame([], SCHEMA), leaf_columns=COLUMNS)).collect() == []
