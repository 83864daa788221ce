import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from siftrank.llm import context_tree as tree
from siftrank.llm import lm_scoring
from siftrank.llm.lm_scoring import score_text

SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("score", T.StringType())])
DEPTH = 4


def coded(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def log_kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """The context tree as a dictionary of nodes (context with the nearest byte first, bits so far)."""

    def __init__(self, texts, depth):
        self.depth, self.nodes = depth, {}
        for text in texts:
            for context, bits in self.places(text):
                for i, bit in enumerate(bits):
                    for d in range(depth + 1):
                        self.nodes.setdefault((context[:d], bits[:i]), [0, 0])[int(bit)] += 1
        self.weighted = {}
        for context, bits in sorted(self.nodes, key=lambda n: -len(n[0])):
            own = log_kt(*self.nodes[context, bits])
            if len(context) < depth:
                below = sum(self.weighted.get((context + bytes([c]), bits), 0) for c in range(256))
                low, high = sorted([own, below])
                self.weighted[context, bits] = math.log(.5) + high + math.log1p(math.exp(low - high))
            else:
                self.weighted[context, bits] = own

    def places(self, text):
        data = b"\n" * self.depth + text
        for i in range(self.depth, len(data)):
            yield data[i - self.depth:i][::-1], f"{data[i]:08b}"

    def one(self, context, bits):
        chance = None
        for d in range(self.depth, -1, -1):
            node = (context[:d], bits)
            if node in self.nodes:
                a, b = self.nodes[node]
                own = (b + .5) / (a + b + 1)
                share = math.exp(math.log(.5) + log_kt(a, b) - self.weighted[node])
                chance = own if chance is None else share * own + (1 - share) * chance
        return .5 if chance is None else chance

    def score(self, text):
        total = 0
        for context, bits in self.places(text):
            for i, bit in enumerate(bits):
                p = self.one(context, bits[:i])
                total += math.log10(p if bit == "1" else 1 - p)
        return total


def test_matches_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(60)]
    rows += [(None, "no id abc"), (100, None), (101, ""), (102, " \t\n"), (103, "Z9Z unknown"), (5, rows[5][1]), (104, "ABC abc\r\nabc")]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    train = [coded(t) for i, t in rows if not held(i)]
    assert 0 < len(train) < len(rows) - 4
    model, counts = Brute(train, DEPTH), Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    got = score_text(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), depth=DEPTH).collect()
    assert len(got) == len(rows)
    by_key = {(r.molecule_id, r.n_bytes, r.n_tokens): r for r in got}
    for i, t in rows:
        text = coded(t)
        tokens = [*text.split(), b"\n"]
        r = by_key[i, len(text), len(tokens)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + .1) / (n + .1 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(model.score(text), rel=1e-5, abs=1e-5)
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(text))


def test_nothing_to_learn_and_empty(spark):
    rows = [(None, "abc", "x"), (None, None, "x")]
    got = {r.n_bytes: r for r in score_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[4].score == pytest.approx(32 * math.log10(.5)) and got[1].train_tokens == 0
    assert score_text(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("most", [1, 40, 700])
def test_cut_contexts_give_the_same_values(monkeypatch, most):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aaaaaabc "), 3000)).encode(), bytes(rng.integers(97, 123, 2000, np.uint8))]
    grams = [tree.gram_keys(np.frombuffer(tree.PAD * 7 + t, np.uint8)) for t in texts]
    keys = np.unique(np.concatenate(grams))
    counts = np.zeros(len(keys), np.uint64)
    learned, times = np.unique(grams[0], return_counts=True)
    counts[np.searchsorted(keys, learned)] = times
    nodes = tree.nodes_of(keys)
    top = (nodes, np.full(len(nodes), .05), np.full(len(nodes), .9), rng.uniform(.2, .8, len(nodes)))
    level, levels = tree.unit_level(learned, times), tree.build(learned, times)
    expected = tree.log10_of(keys, levels, top)
    monkeypatch.setattr(tree, "MOST_GRAMS", most)
    cut = tree.unit_level(learned, times)
    assert (cut.keys == level.keys).all() and (cut.ones == level.ones).all() and np.allclose(cut.weighted, levels[0].weighted, rtol=1e-12)
    assert np.allclose(tree.log10_in_parts(keys, counts, top), expected, rtol=1e-5)
    assert np.allclose(tree.log10_in_parts(keys, counts * 0, top), tree.log10_of(keys, tree.build(keys[:0], times[:0]), top), rtol=1e-5)


def test_one_context_holding_most_grams_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(tree, "MOST_GRAMS", 30)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 500)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 900)
    rng = random.Random(6)
    rows = [(i, "".join("xyz" + rng.choice("abcdefgh") for _ in range(rng.randint(1, 20)))) for i in range(30)]
    rows += [(200, " ".join(rng.choices(["xyza", "xyzb", "q"], k=400))), (201, "xyz" * 300)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = Brute([coded(t) for i, t in rows if not held(i)], 7)
    got = {r.molecule_id: r.score for r in score_text(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(model.score(coded(t)), rel=1e-5, abs=1e-5)


def test_default_depth_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(8)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(20)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    model = Brute([coded(t) for i, t in rows if not held(i)], 7)
    got = {r.molecule_id: r.score for r in score_text(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i] == pytest.approx(model.score(coded(t)), rel=1e-5, abs=1e-5)
