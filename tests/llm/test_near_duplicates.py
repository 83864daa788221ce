import random

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from siftrank.llm import near_duplicates
from siftrank.llm.near_duplicates import keep_one_of_each
from tests.llm.test_simhash_dedup import brute_groups

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t, _ in rows]
    groups = brute_groups(range(len(rows)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    best = {}
    for k, g in groups.items():
        best[g] = min(best.get(g, (True, 0)), (rows[k][0] is None, rows[k][0] or 0))
    return sorted((i if not none else None for none, i in best.values()), key=str)


def varied(rng, words, text, changes):
    out = text.split()
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def test_copies_with_one_changed_word_go(spark):
    rng = random.Random(1)
    words = ["w%d" % i for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([100, 200, 400]))), "x") for i in range(30)]
    rows += [(100 + i, varied(rng, words, rows[i][1], 1), "x") for i in range(30)]
    kept = corpus_pipeline.keep_one_near_duplicate(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30)) == sorted(brute(rows))


@pytest.mark.parametrize(("crowded", "block"), [(200, 1000), (5, 4)])
def test_groups_match_brute_force(spark, crowded, block, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(2)
    words = ["w%d" % i for i in range(500)]
    header = " ".join(rng.choices(words, k=60))
    rows = [(None, None), (900, ""), (2, " \n"), (7, "One two"), (8, "one TWO"), (9, "a b c d e"), (9, "a b c d e")]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 150))) for _ in range(40)]
    base += [header + " " + " ".join(rng.choices(words, k=rng.randint(5, 80))) for _ in range(40)]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    for i in range(120):
        text = rng.choice(base)
        rows.append((rng.choice([None, 200 + i, 200 + i]), varied(rng, words, text, rng.randint(0, max(1, len(text.split()) // 30)))))
    rows += [(400 + i, varied(rng, words, header, rng.randint(0, 3))) for i in range(60)]
    rows = [(*r, "x") for r in rows]
    expected = brute(rows)
    assert 30 < len(expected) < 200
    got = keep_one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3), "doc_id", "text", crowded=crowded)
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted((r.doc_id for r in got.collect()), key=str) == expected


def test_empty_table(spark):
    assert keep_one_of_each(spark.createDataFrame([], SCHEMA), "doc_id", "text").collect() == []


def test_own_columns_named_like_internal_ones_stay(spark):
    schema = T.StructType([*SCHEMA.fields, T.StructField("_row", T.LongType()), T.StructField("_SIG", T.StringType())])
    rows = [(1, "a b c d e f g", "s", 70, "x"), (2, "a b c d e f g", "s", 71, "y"), (3, "other words stand here now", "s", 72, None)]
    got = keep_one_of_each(spark.createDataFrame(rows, schema), "doc_id", "text")
    assert got.columns == schema.names
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_near_copies_meet_by_golay_keys(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=900)) for _ in range(8)]
    texts += [varied(rng, words, t, 1) for t in texts for _ in range(4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "set long, text string")
    found = {(r.a, r.b) for r in near_duplicates.golay_pairs(rows).collect()}
    sets = [shingles(t) for t in texts]
    assert len(found) >= 8 and all(a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in found)


def test_texts_are_sent_only_for_pairs_that_sketches_leave(spark, monkeypatch):
    sent, keep = {}, near_duplicates.stored

    def counted(df, name, clean=False):
        step = keep(df, name, clean)
        sent[name] = sent.get(name, 0) + step.count()
        return step

    monkeypatch.setattr(near_duplicates, "stored", counted)
    rng = random.Random(6)
    words = ["w%d" % i for i in range(3000)]
    header = rng.choices(words, k=60)
    rows = [(i, " ".join(header + rng.choices(words, k=100)), "x") for i in range(40)]
    assert keep_one_of_each(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").count() == 40
    assert sent["met-pairs"] > 0 and sent["met-texts"] == sent["possible-pairs"] == 0


def test_texts_are_not_shuffled_to_find_sets(spark, monkeypatch):
    plans, keep = {}, near_duplicates.stored

    def planned(df, name, clean=False):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, clean)

    monkeypatch.setattr(near_duplicates, "stored", planned)
    rng = random.Random(7)
    words = ["w%d" % i for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate([*texts, *texts[:5], *(varied(rng, words, t, 1) for t in texts)])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = keep_one_of_each(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
        plans["result"] = [kept._jdf.queryExecution().executedPlan().toString()]
        assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("set-sketches", "set-fingerprints", "met-texts", "result"):
        assert plans[name] and not any("Exchange hashpartitioning" in p for p in plans[name]), name


def test_many_copies_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "MOST_NAMED", 1)
    rng = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate([*texts, *texts[:5], *(varied(rng, words, t, 1) for t in texts)])]
    kept = keep_one_of_each(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(rows)) == list(range(20))


def test_a_family_of_near_copies_is_not_compared_in_all_pairs(spark, monkeypatch):
    sent, keep = {}, near_duplicates.stored

    def counted(df, name, clean=False):
        step = keep(df, name, clean)
        sent[name] = sent.get(name, 0) + step.count()
        return step

    monkeypatch.setattr(near_duplicates, "stored", counted)
    rng = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    text = rng.choices(words, k=60)
    # Four groups of one family: the smallest set of the shared shingles is like its own group only.
    rows = [(i, " ".join([*text[:p], f"x{i}", *text[p + 1:]]), "x") for i, p in enumerate(p for p in (8, 22, 36, 50) for _ in range(120))]
    kept = keep_one_of_each(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(rows))
    assert sent["possible-pairs"] < 25 * len(rows)
