import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from siftrank.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")
SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("start", T.StringType())])


def test_round_trip_in_order(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_BYTES", 3000)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeté", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [(i * 7 % 101, " ".join(rng.choices(words, k=rng.randint(1, 60))), "x") for i in range(101)]
    rows += [(500, None, "x"), (501, "", "x"), (501, "", "x"), (502, " a  b\n\n c ", "x"), (503, "x<|endoftext|>y", "x"),
             (504, "long " * 20000, "x"), (505, "it's Don't\u2019 \u00e9t\u00e9\u00d7 1a \u6f22 \u00a0x \t y\n z\u2028 .5,\n\nA  ", "x"), (None, "no id", "x"), (None, "no id", "x")]
    tokenizer = Tokenizer.from_file(PATH)
    expected = {}
    for i, t, _ in rows:
        expected.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    folder = tf.tokens_folder(spark)
    files = tf.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(4), folder, PATH, 2)
    assert files.count() > 3
    got = tf.read_tokens(spark, folder, files).orderBy("start").collect()
    assert [r.molecule_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        expected[r.molecule_id].remove(ids)
        at += len(ids)
    assert not any(expected.values())


def test_chunks_match_the_library_on_random_texts():
    rng = random.Random(3)
    letters = "abcDE \u00e9\u00df\u00d7'st.,!?<|>0123 \n\t\u00a0\u6f22\U0001f642 \u3000"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["x <|endoftext|> y", "a<|endoftext|>b", " ", "  ", "\n", "a \n", "\n a"]
    tokenizer = Tokenizer.from_file(PATH)
    table = tf._tokenizer(open(PATH, encoding="utf-8").read())
    for start in range(0, len(texts), 500):
        some = texts[start:start + 500]
        ids, counts = table.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


def test_single_record_and_wrong_dictionary():
    import pyarrow as pa

    arrays = [np.arange(i, i + 40, dtype="<u4") for i in range(60)]
    dictionary = tf.train_dictionary([a.tobytes() for a in arrays])
    zip_ = tf._compressor(dictionary)
    data = tf.file_bytes([zip_.compress(a.tobytes()) for a in arrays], [40] * 60, pa.array(range(60)), dictionary)
    assert tf.TokenFile(data, dictionary).record(17).tolist() == arrays[17].tolist()
    with pytest.raises(ValueError, match="another dictionary"):
        tf.TokenFile(data, dictionary + b"x")
    with pytest.raises(ValueError, match="not a token file"):
        tf.TokenFile(b"\0" * 100, dictionary)


def test_empty_table(spark):
    folder = tf.tokens_folder(spark)
    files = tf.write_tokens(spark.createDataFrame([], SCHEMA), folder, PATH, 2)
    assert files.count() == 0 and tf.read_tokens(spark, folder, files).count() == 0
