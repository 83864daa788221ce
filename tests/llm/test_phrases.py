import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from siftrank.llm import phrases, tries
from siftrank.llm.phrases import mine_phrases, word_codes
from siftrank.llm.tries import DoubleArray

SCHEMA = T.StructType([T.StructField("evidence_summary_notes", T.StringType()), T.StructField("evidence_summary_category", T.StringType()),
                       T.StructField("rank", T.LongType()), T.StructField("word", T.StringType())])


def brute(rows, min_count, longest, most, covered=50):
    f, n = {}, Counter()
    for text, group in rows:
        group = group or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[group] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (group, tuple(words[i:i + k]))
                    f[key] = f.get(key, 0) + 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = {}
    for (group, words), a in found.items():
        cuts = [(1_000_000 * a * a // (f[group, words[:k]] * f[group, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = lambda w: any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: E731,B023
        if any(g == group and len(w) > len(words) and inside(w) and 100 * b >= covered * a for (g, w), b in found.items()):
            continue
        out.setdefault(group, []).append((score, a, " ".join(words), f[group, words[:k]], f[group, words[k:]]))
    result = []
    for group, items in out.items():
        items.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        result += [(group, i + 1, p, a, lo, r, n[group], s) for i, (s, a, p, lo, r) in enumerate(items[:most])]
    return sorted(result)


def sample():
    rng = random.Random(4)
    rows = [(None, "en"), ("", "en"), ("!!, \n", None), ("A b\x0bc", None), ("über\x01 b", "de"), ("über b", "de")]
    words = ["alpha", "Beta", "GAMMA", "delta,", "é", "z\x01", "z", "-", "end.", "x\ty"]
    for _ in range(160):
        rows.append((" ".join(rng.choices(words, weights=range(10, 0, -1), k=rng.randint(0, 25))), rng.choice(["en", "en", "de", None, "und"])))
    rows += [("same words here again", "en")] * 30 + [("new york city is new york", "lone")] * 7
    rows.append(("very long note of words " * 4000, "de"))
    rng.shuffle(rows)
    return rows


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "own") for r in rows], SCHEMA).repartition(3)
    got = mine_phrases(df, **options)
    assert got.columns == ["evidence_summary_category", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, options.get("min_count", 10), options.get("longest", 3), options.get("most", 2000))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(phrases, "SECTION_BITS", 9)
    monkeypatch.setattr(phrases, "RANGE_BITS", 7)
    monkeypatch.setattr(phrases, "SHARD", 20)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(phrases, "_bucket_bits", lambda positions: 11)


def test_matches_brute_force(spark):
    check(spark, sample())


def test_sections_shards_and_blocks_change_nothing(spark, small):
    check(spark, sample(), min_count=5, most=17)


def test_longer_phrases(spark, small):
    check(spark, sample(), min_count=7, longest=4)


def test_large_counts_are_exact(spark):
    check(spark, [("a b " * 30_000, "en"), ("c d. " * 300, "en"), ("b c a b", None)] * 2, min_count=300)


def test_empty_table(spark):
    assert mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        mine_phrases(spark.createDataFrame([], SCHEMA), group_col="rank")


def test_codes_keep_breaks():
    words, codes = word_codes("B a. a\tb\r\n,\n\x0b c".encode())
    assert [words[c - 1].decode() if c else "|" for c in codes] == ["b", "a", "|", "a", "b", "|", "c"]
    assert word_codes(b" ,\n") == ([], pytest.approx(np.zeros(0)))


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_tries_count_like_brute_force(monkeypatch, bits):
    monkeypatch.setattr(tries, "RADIX_BITS", bits)
    monkeypatch.setattr(tries, "RADIX", 1 << bits)
    rng = np.random.default_rng(bits)
    for length, size, top in ((2, 1, 5), (2, 400, 60), (3, 300, 9), (3, 2000, 40)):
        sequences = np.unique(np.minimum(rng.pareto(0.7, (size, length)).astype(np.int64), top) * 3 + 1, axis=0)
        trie = DoubleArray.build(sequences)
        text = rng.choice(np.append(np.unique(sequences), [0, 2]), 5000)
        counts = np.bincount(trie.accepted(trie.symbols_of(text)), minlength=len(trie.base))[trie.accepting]
        wanted = Counter(tuple(text[i:i + length].tolist()) for i in range(len(text) - length + 1))
        assert counts.tolist() == [wanted[tuple(s)] for s in sequences.tolist()]
