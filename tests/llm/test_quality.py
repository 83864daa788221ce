import random

import numpy as np
import pytest
from pyspark.sql import types as T

from siftrank.llm.quality import FEATURES, AttentionModel, PassageEncoder, learn_quality, score_quality

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("selected", T.IntegerType()), T.StructField("score", T.StringType())])


def notes(n, seed):
    rng, out = random.Random(seed), []
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    for i in range(n):
        text, label = rng.choices(words, k=rng.randint(60, 300)), rng.randint(0, 1)
        if not label:
            at = rng.randint(0, len(text) - 40)
            text[at:at + 40] = [w.upper() + "$$" for w in text[at:at + 40]]
        out.append((i, " ".join(text), label, "x"))
    return out


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = AttentionModel(0.4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    counts, y, weight = np.array([2, 1, 3]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    x = rng.normal(0, 1, (6, FEATURES)) * (rng.random((6, FEATURES)) < 0.05)

    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, counts)["logit"]))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum() + 5e-5 * (model.p["E"] ** 2).sum()

    grads = model.gradients(x, counts, y, weight)
    for k, g in grads.items():
        flat = model.p[k].reshape(-1)
        for i in rng.integers(0, len(flat), 6):
            flat[i] += 1e-5
            up = loss()
            flat[i] -= 2e-5
            down = loss()
            flat[i] += 1e-5
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_encoder_covers_all_passages():
    x, counts = PassageEncoder().passages(["a " * 100, None, "", "b"])
    assert counts.tolist() == [3, 1, 1, 1] and x.shape == (6, FEATURES) and x[3].tolist() == x[4].tolist()


def test_held_out_accuracy_and_edges(spark):
    rows = notes(700, 3)
    more = [(2000, None, 1, "x"), (2001, "", None, "x"), (2002, "word " * 30000, 7, "x"), (None, "abc", 0, "x"), (2001, "", None, "x")]
    df = spark.createDataFrame(rows + more, SCHEMA)
    got = score_quality(df, learn_quality(df, df)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)
    truth = {r[0]: r[2] for r in rows}
    held = [(r.predicted, truth[r.molecule_id]) for r in got if r.held_out and r.molecule_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    assert {r.molecule_id: r.passages for r in got}[2002] == 625


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert score_quality(none, learn_quality(none, none)).collect() == []
    one = spark.createDataFrame([(1, "abc", 1, "x")], SCHEMA)
    assert score_quality(one, learn_quality(one, one)).first().score > 0.4
