import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from siftrank.llm.suffix_dedup import remove_repeats
from siftrank.llm.suffix_merge import decode_front, front_code, merge_runs

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("kept", T.StringType())])


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - width + 1):
            seen.setdefault(t[p:p + width], []).append((d, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p:p + width] = True
    out = []
    for (i, _), t, g in zip(rows, texts, gone):
        kept = np.frombuffer(t, np.uint8)[~g].tobytes()
        out.append((i, len(t), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return sorted(((r.molecule_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in remove_repeats(df, **kw).collect()), key=str)


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [front_code(r) for r in runs]
    assert [decode_front(*c) for c in coded] == runs
    run, at, shared = merge_runs([(r, c[0].tolist()) for r, c in zip(runs, coded)])
    merged = [runs[r][i] for r, i in zip(run, at)]
    assert merged == sorted(sum(runs, []))
    for before, one, h in zip(merged, merged[1:], shared[1:]):
        n = 0
        while n < min(len(before), len(one)) and before[n] == one[n]:
            n += 1
        assert n == h


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé\0", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(6)]
    rows = [(None, "x"), (5, None), (6, ""), (7, "short"), (7, "short"), (8, "z" * 300), (9, "z" * 45)]
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(12)) for _ in range(5)]
        rows.append((100 + i, " ".join(parts)))
    rows += [(200, rows[-1][1]), (200, rows[-1][1]), (201, rows[-2][1][:-9] + "!" + rows[-2][1][-9:])]
    assert run(spark, rows, width=40, gram=12) == brute(rows, 40)


def test_production_width(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    shared = " ".join(rng.choices(words, k=60))
    rows = [(i, " ".join(rng.choices(words, k=50)) + (" " + shared[i:] if i % 3 == 0 else "") + " " + " ".join(rng.choices(words, k=30)))
            for i in range(30)]
    rows.append((99, shared[:200]))
    rows.append((98, shared[:199]))
    assert run(spark, rows) == brute(rows, 200)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_own_columns_named_like_internal_ones_stay(spark):
    from siftrank.llm.suffix_dedup import without_repeats

    rows = [(1, "x" * 30, True, "r"), (2, None, False, "s"), (3, "alone", None, None)]
    df = spark.createDataFrame(rows, "molecule_id long, evidence_summary_notes string, _was_null boolean, _record string")
    got = without_repeats(df, width=20, gram=8)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "", True, "r"), (2, None, False, "s"), (3, "alone", None, None)]
