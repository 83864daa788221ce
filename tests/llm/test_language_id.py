import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.llm.language_id import CharacterModel, cross_entropies, identify_language, learn_languages, symbols

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("patent_top_record_title", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])
WORDS = {"de": "der die und nicht öl straße über haus schön wir".split(), "en": "the and not oil street over house nice we which".split(),
         "fr": "le la et pas huile rue sur maison beau très où".split()}


def brute_model(texts, alphabet, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        for i in range(len(t)):
            if i >= order - 1:
                counts[order][t[i - order + 1:i]][t[i]] += 1
    seen = {n: set() for n in range(1, order + 1)}
    seen[order] = {c + w for c, ws in counts[order].items() for w in ws}
    for n in range(order - 1, 0, -1):
        for g in seen[n + 1]:
            counts[n][g[1:-1]][g[-1]] += 1
        seen[n] = {c + w for c, ws in counts[n].items() for w in ws}

    def chance(context, w, n):
        if n == 0:
            return 1 / (alphabet + 1)
        context = context[len(context) - (n - 1):] if n > 1 else ""
        ws = counts[n].get(context)
        lower = chance(context[1:], w, n - 1)
        if not ws:
            return lower
        values = [c for x in counts[n].values() for c in x.values()]
        once, twice = values.count(1), values.count(2)
        d = min(.95, max(.05, once / max(once + 2 * twice, 1)))
        total = sum(ws.values())
        if w not in ws:
            return d * len(ws) / total * lower
        return (ws[w] - d) / total + d * len(ws) / total * lower

    return chance


def test_symbols():
    points, counts, has = symbols(["Ab--c1", None, "12", "\0x"])
    cut = np.split(points, np.cumsum(counts)[:-1])
    assert ["".join(map(chr, c)) for c in cut] == [" ab c ", " ", " ", " x "]
    assert has.tolist() == [True, False, False, True]


def test_probabilities_match_brute_force():
    rng = random.Random(1)
    texts = [" " + " ".join(rng.choices(["ab", "abc", "cab", "b", "öa"], k=12)) + " " for _ in range(20)]
    model, brute = CharacterModel(texts, 5, 3), brute_model(texts, 5, 3)
    probe = " abc cab öaa xb "
    expected = [-math.log(brute(probe[i - 2:i], probe[i], 3)) for i in range(2, len(probe))]
    assert cross_entropies([model], [probe], 3)[0][0, 0] == pytest.approx(sum(expected) / len(expected))
    for context in ("ab", " c", "zz"):
        total = sum(brute(context, w, 3) for w in "abcö ") + brute(context, "?", 3)
        assert total == pytest.approx(1)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang, "x"))
    truth = {r[0]: r[2] for r in rows}
    rows += [(1000, None, "de", "x"), (1001, "", "de", "x"), (1002, "12 !?", "de", "x"), (1003, "a", None, "x"), (None, "the house", "en", "x"),
             (1004, "the house " * 20000, None, "x"), (1005, "漢字", None, "x"), (1005, "漢字", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    models = learn_languages(df, learn_from=F.crc32(F.col("molecule_id").cast("string")) % 4 != 2)
    assert models.languages == ["de", "en", "fr"]
    got = identify_language(df, models).collect()
    assert len(got) == len(rows)
    right = [r.lang_pred == truth[r.molecule_id] for r in got if r.molecule_id in truth and r.held_out]
    assert len(right) > 50 and np.mean(right) > 0.97
    by_id = {r.molecule_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[1004].lang_pred == "en" and by_id[1003].lang_pred in models.languages
    assert by_id[1005].rejected and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, "x")], SCHEMA)
    assert [r.lang_pred for r in identify_language(df, learn_languages(df)).collect()] == ["und"]
    none = spark.createDataFrame([], SCHEMA)
    assert identify_language(none, learn_languages(none)).collect() == []
