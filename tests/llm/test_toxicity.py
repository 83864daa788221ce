import random

import numpy as np
import pytest
from pyspark.sql import types as T

from siftrank.llm.toxicity import OrdinalModel, feature_counts, fit_ordinal, learn_severity, marker_grades, score_severity, words_of

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("review_note", T.StringType()),
                       T.StructField("severity", T.IntegerType())])
MARKERS = ["foul", "nasty", "vile", "rotten"]


def notes(n, seed):
    rng, out = random.Random(seed), []
    common = ["w%02d" % i for i in range(40)]
    for i in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        words = rng.choices(common, k=rng.randint(5, 60))
        for m in rng.sample(MARKERS, grade * 2):
            words.insert(rng.randint(0, len(words)), m.upper() + "!" if rng.random() < .3 else m)
        out.append((i, " ".join(words), grade))
    return out


def test_words_and_features():
    assert words_of("Ab-c É1 ") == ["ab".encode(), b"c", "É1".encode()] and words_of(None) == []
    assert feature_counts([b"abcdef", b"abcdef"])[b"abcd*"] == 2


def test_chances_are_a_distribution_with_shared_weights():
    model = OrdinalModel({b"foul": 0, b"none": 1}, np.array([2.0, 0.0]), np.array([1.0, 3.0]))
    chances = model.chances(["foul foul", "", None])
    assert chances.sum(axis=1) == pytest.approx(1) and chances.min() > 0
    eta = 2.0 * (1 + 0.5 * np.log(2))
    below = 1 / (1 + np.exp(-(np.array([1.0, 3.0]) - eta)))
    assert chances[0] == pytest.approx([below[0], below[1] - below[0], 1 - below[1]])
    assert chances[1].tolist() == chances[2].tolist()


def test_held_out_accuracy_and_edges(spark):
    rows = notes(900, 1)
    more = [(2000, None, 0), (2001, "", None), (2002, "foul " * 20000 + "nasty vile rotten", None), (None, "foul nasty vile", 2), (2003, "foul", -1)]
    df = spark.createDataFrame(rows + more + more[:1], SCHEMA)
    model = learn_severity(df, df, label_col="severity")
    got = score_severity(df, model).collect()
    assert len(got) == len(rows) + 6
    truth = {i: g for i, _, g in rows}
    held = [(r, truth[r.molecule_id]) for r in got if r.held_out and r.molecule_id in truth]
    assert np.mean([r.severity == g for r, g in held]) > 0.9
    assert np.mean([r.toxic == (g > 0) for r, g in held]) > 0.95
    means = [np.mean([r.expected_severity for r, g in held if g == k]) for k in range(3)]
    assert means == sorted(means)
    by_id = {r.molecule_id: r for r in got}
    assert by_id[2000].toxic == by_id[2001].toxic == 0 and by_id[2002].toxic == 1


def test_marks_are_graded_by_markers():
    rows = notes(300, 2)
    grades = marker_grades([t for _, t, _ in rows], [int(g > 0) for _, _, g in rows])
    assert np.mean([a == g for a, (_, _, g) in zip(grades, rows)]) > 0.95


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert score_severity(none, learn_severity(none, none)).collect() == []
    assert fit_ordinal(["a"], [0], [1.0], 2).chances(["a"])[0, 0] > 0.9
