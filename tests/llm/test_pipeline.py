import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from siftrank.llm.bpe import read_ranks
from siftrank.llm.quality import PassageEncoder, learn_quality
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_near_duplicates import shingles
from tests.llm.test_simhash_dedup import brute_groups


def changed(text):
    words = text.split()
    words[len(words) // 2] = "another"
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(1), str(tmp_path_factory.mktemp("tables"))
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 8))) for _ in range(400)]
    items = [(j, " ".join(rng.choices(words, k=rng.randint(14, 25)))) for j in range(8)]
    passages = [" ".join(rng.choices(words, k=70)) for _ in range(3)]
    docs, labels = [], []
    for i in range(260):
        text = " ".join(rng.choices(words, k=rng.randint(40, 160)))
        good = rng.random() > .25
        if not good:
            text = " ".join(w.upper() + "$$" for w in text.split())
        if rng.random() < .1:
            text += " " + rng.choice(items)[1] + " " + rng.choice(words)
        if rng.random() < .1:
            text += " é" + rng.choice(passages) + "é " + rng.choice(words)
        docs.append((i, text, "en", "src", len(text)))
        labels.append((i, int(good), 0))
    docs += [(300 + i, docs[i][1], "en", "src", 1) for i in range(20)]
    docs += [(300 + i, changed(docs[i][1]), "en", "src", 1) for i in range(30, 45)]
    docs += [(400, None, "en", None, None), (401, "", None, "src", 0), (None, docs[3][1] + " more", "en", "src", 1), (5, docs[5][1], "en", "src", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_stages_match_brute_force(spark, folder):
    path, docs, items = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    from pyspark.sql import functions as F

    model = learn_quality(frame, spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("quality").alias("selected")),
                          id_col="doc_id", text_col="text")
    good = model.score(*PassageEncoder().passages([d[1] for d in docs])) >= .5
    kept = [d for d, g in zip(docs, good) if g]
    assert .6 * len(docs) < len(kept) < .9 * len(docs)
    sets = [shingles(d[1]) for d in kept]
    groups = brute_groups(range(len(kept)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert sum(30 <= d[0] < 45 or 330 <= d[0] < 345 for d in kept if d[0]) - len({groups[k] for k, d in enumerate(kept) if d[0] and d[0] % 300 in range(30, 45)}) > 4
    best = {}
    for k, g in groups.items():
        key = (kept[k][0] is None, kept[k][0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, k)
    kept = [kept[k] for _, k in best.values()]
    texts = [(d[1] or "").encode() for d in kept]
    places = {}
    for n, t in enumerate(texts):
        for p in range(len(t) - 199):
            places.setdefault(t[p:p + 200], []).append((n, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for n, p in found:
                gone[n][p:p + 200] = True
    cut = [(d[0], np.frombuffer(t, np.uint8)[~g].tobytes().decode("utf-8", "ignore")) for d, t, g in zip(kept, texts, gone)]
    assert any(g.any() for g in gone)
    leaking = {i for i, *_ in brute_leaks(cut, items)}
    assert leaking and None not in leaking
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                                 mergeable_ranks={t: i for i, t in enumerate(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))})
    expected = sorted(((i, encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in cut if i not in leaking), key=str)
    docs_now = frame
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_now = stage(spark, docs_now, path)
        if n < 4:
            assert docs_now.columns == frame.columns, name
    got = sorted(((r.doc_id, r.token_ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, path).collect()), key=str)
    assert got == expected


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "op10_histogram_top_k" in __spark_entry__.oracle_sql() and "pipeline" not in __spark_entry__.oracle_sql()
