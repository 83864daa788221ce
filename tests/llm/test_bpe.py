import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import types as T

from siftrank.llm.bpe import PairTable, decode_tokens, encode_text, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = T.StructType([T.StructField("molecule_id", T.LongType()), T.StructField("evidence_summary_notes", T.StringType()),
                       T.StructField("token_ids", T.StringType()), T.StructField("decoded", T.StringType())])


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    letters = "abcdeté'ßΩ漢字🙂  \n\t 　.,!12’\0"
    out = [None, "", " ", "  ", "a", " a", "a ", "a  b", "it's don't we'll", "x\n y", "\n\n", "<|endoftext|> x", "tab\tb  c",
           "a" * 3000, " " * 500, "é" * 400, "word " * 2000, "ab" * 200 + " " + "漢" * 100]
    return out + ["".join(rng.choices(letters, k=rng.randint(1, 120))) for _ in range(400)]


def test_matches_the_library_and_decodes(spark, reference):
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(texts())] + [(4, "a", "x", "y")]
    encoded = encode_text(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, P.PATTERN)
    got = decode_tokens(encoded, PATH).collect()
    assert sorted((str(r.molecule_id), r.token_ids, bytes(r.decoded)) for r in got) == sorted(
        (str(i), reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)


def test_matrix_and_heap_agree():
    table, rng = PairTable(read_ranks(PATH)), random.Random(2)
    for width in (8, 64, 128):
        pieces = ["".join(rng.choices("etaonrisé", k=rng.randint(2, width // 2))).encode() for _ in range(200)]
        assert [x.tolist() for x in table._by_matrix(pieces, width)] == [table._by_heap(p).tolist() for p in pieces]


def test_unknown_ids_and_empty_table(spark):
    bad = spark.createDataFrame([(1, [10**6])], "molecule_id long, token_ids array<int>")
    with pytest.raises(Exception, match="token ids must lie in"):
        decode_tokens(bad, PATH).collect()
    none = spark.createDataFrame([(1, None), (2, [])], "molecule_id long, token_ids array<int>")
    assert [bytes(r.decoded) for r in decode_tokens(none, PATH).collect()] == [b"", b""]
    assert decode_tokens(encode_text(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN), PATH).collect() == []
