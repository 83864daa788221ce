import random
from collections import Counter

from pyspark.sql import types as T

from siftrank.llm import decontaminate as dc

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("similarity", T.StringType())])
ITEMS = T.StructType([T.StructField("known_compound_id", T.LongType()), T.StructField("known_compound_name", T.StringType()),
                      T.StructField("first_word", T.StringType())])


def shingles(words):
    size = min(5, len(words))
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def brute(rows, items):
    out = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        for j, it in items:
            item = (it or "").encode().lower().split()
            if not item:
                continue
            b, best = Counter(shingles(item)), (0, 0)
            for s in range(len(words) - len(item) + 1):
                a = Counter(shingles(words[s:s + len(item)]))
                both = sum((a & b).values())
                value = both / (sum(a.values()) + sum(b.values()) - both)
                if value > best[0]:
                    best = (value, s)
            if best[0] >= .8:
                out.append((i, j, round(best[0], 9), best[1], len(item)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(80)] + ["É", "the"]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([12, 20, 31, 45, 45])))) for j in range(25)]
    items += [(100, None), (101, ""), (102, "only three words"), (103, items[0][1]), (104, "one"), (None, "no id item of six words here")]
    rows = [(None, items[0][1]), (900, None), (901, ""), (902, "one"), (903, "say only Three words\tnow"), (904, "no id item of six words here")]
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(5, 90))
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 3)):
                at, kind = rng.randrange(len(passage)), rng.random()
                if kind < .4:
                    passage[at] = "changed"
                elif kind < .7:
                    del passage[at]
                else:
                    passage.insert(at, "new")
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in passage] if rng.random() < .3 else passage
        rows.append((i, " ".join(words)))
    rows += [rows[-1], (905, "w1 " * 30000 + items[3][1])]
    return rows, items


def test_matches_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows, items = case(seed)
        leaks = dc.find_leaks(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3),
                              spark.createDataFrame([(*r, "x") for r in items], ITEMS))
        got = sorted(((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in leaks.collect()), key=str)
        small = [r for r in rows if r[0] != 905]
        assert [g for g in got if g[0] != 905] == brute(small, items)
        assert [g[1] for g in got if g[0] == 905] == [3]


def test_index_in_parts_and_filter(spark, monkeypatch):
    rows, items = case(3)
    df, bench = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    whole = dc.find_leaks(df, bench)
    expected = sorted(map(str, whole.collect()))
    monkeypatch.setattr(dc, "INDEX_CHARACTERS", 1000)
    assert sorted(map(str, dc.find_leaks(df, bench).collect())) == expected
    kept = {r.molecule_id for r in dc.without_leaks(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {r.molecule_id for r in whole.collect()} and dc.without_leaks(df, bench).columns == df.columns


def test_blocks_find_all_within_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    items = dc.SizedItems(5, [(i, rng.integers(0, 2**63, 1, dtype=np.uint64)) for i in range(50)])
    probes, source = [], []
    for i, f in enumerate(items.fingerprints.tolist()):
        for n in range(0, dc.RADIUS + 1):
            flipped = f
            for b in rng.choice(64, n, replace=False).tolist():
                flipped ^= 1 << b
            probes.append(flipped)
            source.append(i)
    window, item = items.candidates(np.array(probes, np.uint64))
    assert set(zip(range(len(probes)), source)) <= set(zip(window.tolist(), item.tolist()))


def test_empty_tables(spark):
    rows, items = case(4)
    df, bench = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    assert dc.find_leaks(df.limit(0), bench).collect() == [] and dc.find_leaks(df, bench.limit(0)).collect() == []
