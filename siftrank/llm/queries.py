"""The text operators over the test tables: one query for each numbered operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as records with notes."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("molecule_id"), F.col("text").alias("evidence_summary_notes"))


@query
def op1_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.lm_scoring import score_text

    return score_text(notes(spark, sf_dir)).withColumnRenamed("molecule_id", "doc_id")


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.suffix_dedup import remove_repeats

    return remove_repeats(notes(spark, sf_dir)).select(
        F.col("molecule_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.simhash_dedup import group_near_duplicates

    return group_near_duplicates(notes(spark, sf_dir)).withColumnRenamed("molecule_id", "doc_id")


@query
def op5_bpe_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftrank.llm.bpe import decode_tokens, encode_text

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_text(notes(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return decode_tokens(encoded, ranks).select(
        F.col("molecule_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftrank.llm.token_files import read_tokens, tokens_folder, write_tokens

    folder = tokens_folder(spark)
    files = write_tokens(notes(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, folder, files).select(
        F.col("molecule_id").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query
def op6_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.arrays import remainder_of_id
    from siftrank.llm.language_id import identify_language, learn_languages

    titles = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("molecule_id"), F.col("text").alias("patent_top_record_title"), "lang")
    models = learn_languages(titles, learn_from=remainder_of_id("molecule_id", 4) != 2)
    return identify_language(titles, models).withColumnRenamed("molecule_id", "doc_id")


def learned_quality(spark: SparkSession, sf_dir: str, records: DataFrame):
    """The quality model of ``labels.quality``, learned from the given records."""
    from siftrank.llm.quality import learn_quality

    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("molecule_id"), F.col("quality").alias("selected"))
    return learn_quality(records, marked)


@query
def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.quality import score_quality

    records = notes(spark, sf_dir)
    return score_quality(records, learned_quality(spark, sf_dir, records)).withColumnRenamed("molecule_id", "doc_id")


@query
def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.toxicity import learn_severity, score_severity

    reviews = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("molecule_id"), F.col("text").alias("review_note"))
    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("molecule_id"), F.col("toxic").alias("severity"))
    return score_severity(reviews, learn_severity(reviews, marked, graded=False)).withColumnRenamed("molecule_id", "doc_id")


@query
def op10_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.topk import top_matches

    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("molecule_id"), F.col("embedding").alias("descriptor_vector"))
    return top_matches(vectors, F.col("molecule_id") % 50 == 0).withColumnRenamed("molecule_id", "vec_id")


ORACLES["op10_histogram_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""


@query
def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.decontaminate import find_leaks

    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("known_compound_id"), F.col("text").alias("known_compound_name"))
    return find_leaks(notes(spark, sf_dir), items).select(
        F.col("molecule_id").alias("doc_id"), F.col("known_compound_id").alias("item_id"), "similarity", "first_word", "n_words")


@query
def op13_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.exact_dedup import mark_exact_copies

    return mark_exact_copies(notes(spark, sf_dir)).withColumnRenamed("molecule_id", "doc_id")


ORACLES["op13_bloom_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.arrays import remainder_of_id
    from siftrank.llm.merkle_manifest import dataset_manifest, leaf_digest, verify_manifest

    records = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("molecule_id"), F.col("source").alias("known_compound_source"), F.col("lang").alias("job_id"),
        F.col("n_chars").alias("patent_record_count"), F.col("text").alias("evidence_summary_notes"))
    columns = tuple(records.columns)
    lowered = F.translate("evidence_summary_notes", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    note = F.when(remainder_of_id("molecule_id", 3) == 0, lowered).otherwise(F.col("evidence_summary_notes"))
    received = leaf_digest([note if c == "evidence_summary_notes" else F.col(c) for c in columns])
    manifest = dataset_manifest(records, leaf_columns=columns, also={"received": received})
    text = {c: F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")}
    return verify_manifest(manifest, "received").select(
        F.col("molecule_id").alias("doc_id"), text["leaf"], text["subroot"], text["root"],
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), text["folded_root"], "verified")


@query
def op11_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftrank.llm.phrases import mine_phrases

    records = table(spark, sf_dir, "documents").select(
        F.col("text").alias("evidence_summary_notes"), F.col("lang").alias("evidence_summary_category"))
    return mine_phrases(records).withColumnRenamed("evidence_summary_category", "lang")


ORACLES["op11_phrase_tries"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, unnest(list_transform(range(1, CAST(len(ws) AS BIGINT) - k + 2),
                                          lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
    FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1
), cand AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS ids FROM f WHERE k > 1 AND a >= 10
), cut_keys AS MATERIALIZED (
  SELECT lang, k, phrase, a, j, array_to_string(ids[:j], ' ') AS head, array_to_string(ids[j + 1:], ' ') AS rest
  FROM cand, (SELECT unnest([1, 2]) AS j) WHERE j < k
), heads AS MATERIALIZED (
  SELECT c.*, x.a AS l FROM cut_keys c JOIN f x ON x.lang = c.lang AND x.phrase = c.head
), cuts AS MATERIALIZED (
  SELECT c.*, y.a AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(c.l AS HUGEINT) * y.a) AS score
  FROM heads c JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, array_to_string(ids[s:s + 1], ' ') AS phrase, max(a) AS longer
  FROM cand, (SELECT unnest([1, 2]) AS s) WHERE k = 3 GROUP BY ALL
), kept AS (
  SELECT b.lang, b.phrase, b.a, l, r, score
  FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS "rank" FROM kept
)
SELECT lang, "rank", phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE "rank" <= 2000
"""
