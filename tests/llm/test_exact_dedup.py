import hashlib
import random
import re

from pyspark.sql import types as T

from siftrank.llm import exact_dedup
from siftrank.llm.exact_dedup import drop_exact_copies, filter_bits, mark_exact_copies, repeated_slots, with_maybe_repeated

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("_maybe", T.LongType()), T.StructField("kept", T.LongType())])


def brute(rows):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for i, (id_, _) in enumerate(rows):
        same = [j for j in range(len(rows)) if texts[j] == texts[i]]
        first = min(same, key=lambda j: (rows[j][0] is None, rows[j][0] or 0))
        out.append((id_, rows[first][0], len(same), hashlib.sha256(texts[i].encode()).hexdigest()))
    return out


def sample_rows():
    rng = random.Random(5)
    rows = [(4, None), (2, ""), (9, " "), (8, "\n\t \x0b"), (7, "a b"), (6, "a  b"), (5, "a b"), (3, " a b"), (None, "a b"),
            (None, "only without id"), (11, "A b"), (12, "long " * 50_000), (10, "long\n" * 50_000)]
    rows += [(100 + i, "hot text") for i in range(60)]
    rows += [(200 + i, " ".join(rng.choices("abcd", k=rng.randint(1, 4)))) for i in range(120)]
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    got = mark_exact_copies(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.molecule_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = {}
    for r in got:
        assert not r.kept or r.molecule_id == r.keep_id
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    left = drop_exact_copies(df)
    assert left.columns == df.columns
    assert sorted(map(str, (r.molecule_id for r in left.collect()))) == sorted(str(r.molecule_id) for r in got if r.kept)


def test_matches_brute_force(spark):
    check(spark, sample_rows())


def test_full_filter_and_heavy_texts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 1 << 5)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 5)
    monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 10)
    check(spark, sample_rows())


def test_repeated_rows_keep_one(spark):
    got = mark_exact_copies(spark.createDataFrame([(1, "x", "", 0, 0)] * 3, SCHEMA)).collect()
    assert [r.group_size for r in got] == [3] * 3 and sum(r.kept for r in got) == 1


def test_filter_holds_every_repeat_and_passes_most_others(spark):
    rows = spark.range(20_000).selectExpr("sha2(cast(id % 19000 as string), 256) as digest", "id")
    bits = filter_bits(20_000)
    found = with_maybe_repeated(rows, "digest", repeated_slots(rows, "digest", bits), bits, "maybe").collect()
    repeated = [r for r in found if r.id < 1000 or r.id >= 19_000]
    assert all(r.maybe for r in repeated)
    assert sum(r.maybe for r in found) - len(repeated) < 600


def test_only_maybe_repeated_rows_are_shuffled(spark):
    plan = mark_exact_copies(spark.createDataFrame([(1, "x", "", 0, 0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mark_exact_copies(empty).collect() == [] and drop_exact_copies(empty).collect() == []
