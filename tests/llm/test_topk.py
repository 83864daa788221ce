import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm import topk

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("descriptor_vector", T.ArrayType(T.FloatType())),
                       T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])


def brute(rows, k, asks):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if asks(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("bins", [4096, 8])
def test_matches_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 256)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = random.Random(1)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.choice([-1.0, -.5, .25, rng.uniform(-1, 1)])) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(120)]  # ties
    rows += [(None, rows[0][1]), (2000, None), (2005, [1.0, None, 0.0, 0.0]), (2010, [float("nan"), 0.0, 0.0, 0.0]), (2015, [float("inf"), 0.0, 0.0, 0.0]),
             (2020, [0.0] * 4), (2025, []), (2030, [1.0]), (2035, [500.0] * 4)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in topk.top_matches(df, F.col("molecule_id") % 5 == 0, bins=bins).collect())
    assert got == brute(rows, 5, lambda i: i % 5 == 0)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0], "", ""), (6, [-3.0], "", "")], SCHEMA)
    assert [tuple(r) for r in topk.top_matches(df, F.col("molecule_id") == 5).collect()] == [(5, 1, 6, -768 * 256)]
    assert topk.top_matches(df.limit(0), F.lit(True)).collect() == []
    assert topk.top_matches(df.limit(1), F.lit(True)).collect() == []
