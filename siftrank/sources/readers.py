"""Readers: candidates, reference, results, runs, caches, annotations, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftrank import vocab as V
from siftrank.functions.keys import identity_key
from siftrank.functions.numbers import col
from siftrank.functions.text import clean_annotation, filled, strip
from siftrank.operators.identity import keyed_reference
from siftrank.operators.lookups import CACHE_STATUS, INVALID_ROW, LOOKUP_STATUS, fixed_result
from siftrank.sources.split_csv import read_csv_splits
from siftrank.schemas import ANNOTATION_MAP, ANNOTATION_SCHEMA, LOOKUP_RESULTS, RESULT_SCHEMA, RUN_SCHEMA, STORED_RESULT


def read_candidates(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Candidate CSV as strings plus ``ord``, the 1-based position in the input.

    Quoted line breaks are legal with ``multi_line``: large files are read by
    many tasks all the same (:mod:`siftrank.sources.split_csv`).  Extra
    columns are dropped, ``docking_score`` stays absent when the input has none.
    All files have to name the same columns in the same order; the read fails
    on a file whose header differs instead of taking its cells by position.
    """
    if multi_line:
        raw = read_csv_splits(spark, path)
        validate_columns(raw)
        return raw.select(*[c for c in V.REQUIRED_COLUMNS + V.OPTIONAL_COLUMNS if c in raw.columns], "ord")
    raw = (
        spark.read.option("header", True).option("enforceSchema", False)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    names = [c for c in V.REQUIRED_COLUMNS + V.OPTIONAL_COLUMNS if c in raw.columns]
    validate_columns(raw)
    return with_ordinals(raw, names)


def validate_columns(df: DataFrame, required: tuple[str, ...] = V.REQUIRED_COLUMNS) -> None:
    """Raise with the sorted missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"CSV is missing required columns: {', '.join(missing)}.")


def candidate_count(df: DataFrame, required: tuple[str, ...] = V.REQUIRED_COLUMNS) -> int:
    """Number of rows of a valid file; raises like :func:`validate_columns`."""
    validate_columns(df, required)
    return df.count()


def with_ordinals(files: DataFrame, names: list[str], ordinal: str = "ord") -> DataFrame:
    """Number the rows of a file scan from 1, by path, split and place inside the split.

    Only one row per file split is gathered to compute the offsets.
    """
    base = files.select(
        *names, F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = base.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    order = Window.orderBy("_file", "_start")
    offsets = splits.withColumn("_offset", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    return base.join(F.broadcast(offsets), ["_file", "_start"]).select(
        *names, (F.col("_id") - F.col("_first") + F.col("_offset") + 1).alias(ordinal)
    )


def read_reference(df: DataFrame, text: str = "smiles", ordinal: str = "ord") -> DataFrame:
    """Keyed reference ``(key, name, source, compound_id, …, position)`` from raw rows."""
    return keyed_reference(df.withColumn("key", identity_key(text)), "key", ordinal)


def read_result(spark: SparkSession, path: str, job_id: str, runs: DataFrame | None = None) -> DataFrame:
    """Rows of one run in rank order; empty for a failed run, an error for an unknown one."""
    if runs is not None:
        state = runs.where(F.col("job_id") == job_id).select("status").take(1)
        if not state:
            raise LookupError("Job not found.")
        if state[0]["status"] == "failed":
            return spark.createDataFrame([], RESULT_SCHEMA)
    return stored_results(spark, path).where(F.col("job_id") == job_id).orderBy("rank_position").select(
        *V.RESULT_COLUMNS
    )


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows of all runs; read with the declared schema, so an empty run is no error."""
    return spark.read.schema(STORED_RESULT).parquet(path)


def stored_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All stored annotation sets; cleared ones have no rows."""
    return spark.read.schema(ANNOTATION_SCHEMA).parquet(path).select(*ANNOTATION_SCHEMA.names)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per well-formed run file; malformed files and non-objects are skipped."""
    schema = T.StructType(RUN_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull()).drop("_corrupt_record")


def latest_runs(states: DataFrame) -> DataFrame:
    """Latest stored state per run."""
    names = [c for c in states.columns if c not in ("job_id", "updated_at")]
    return states.groupBy("job_id").agg(
        F.max_by(F.struct(*names), "updated_at").alias("_row")
    ).select("job_id", "_row.*")


def cached_result(payload: Column | str, source: str) -> tuple[Column, Column]:
    """``(is_hit, result)`` of a stored JSON payload.

    A payload that is no object is a miss; one whose ``result`` is no object is
    a hit with a failed lookup; missing fields get defaults.
    """
    text = col(payload)
    schema = LOOKUP_RESULTS[source]
    is_object = F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False))
    body = F.get_json_object(text, "$.result")
    whole = F.coalesce(body.startswith("{"), F.lit(False))
    parsed = F.from_json(body, schema)
    name = {"identity": "PubChem", "bioactivity": "ChEMBL", "document": "patent-context"}[source]
    status, cache = LOOKUP_STATUS[source], CACHE_STATUS[source]
    fields = []
    for f in schema.fields:
        value = parsed[f.name]
        if isinstance(f.dataType, T.BooleanType):
            value = F.coalesce(value, F.lit(False))
        elif f.name == status:
            value = F.coalesce(filled(value), F.lit("lookup_failed"))
        elif f.name == cache:
            value = F.coalesce(filled(value), F.lit("cache_hit"))
        elif f.name.endswith("_warning"):
            value = F.coalesce(value, F.lit(""))
        elif f.name == "chembl_similarity_status":
            value = F.coalesce(filled(value), F.lit("not_requested"))
        fields.append(value.alias(f.name))
    broken = {
        **INVALID_ROW[source], status: "lookup_failed", cache: "cache_hit",
        {"identity": "pubchem_warning", "bioactivity": "chembl_warning",
         "document": "patent_warning"}[source]: f"Cached {name} payload was malformed.",
    }
    if source == "bioactivity":
        broken["chembl_similarity_status"] = "lookup_failed"
    return is_object, F.when(whole, F.struct(*fields)).otherwise(fixed_result(source, broken))


def read_lookup_cache(raw: DataFrame, source: str, payload: str = "payload") -> DataFrame:
    """``(identity_key, cached_at, result)`` from ``(identity_key, cached_at, payload)``."""
    hit, result = cached_result(payload, source)
    return raw.where(hit).select("identity_key", "cached_at", result.alias("result"))


def read_annotations(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``(job_id, annotation_key, review_status, review_note)`` from JSON maps per job.

    Missing or malformed maps give no rows; keys are trimmed and empty ones dropped.
    """
    parsed = F.from_json(col(payload), T.StructType([T.StructField("annotations", ANNOTATION_MAP)]))
    rows = raw.select("job_id", F.explode(parsed["annotations"]).alias("key", "value"))
    return clean_annotations(
        rows.where(F.col("value").isNotNull()).select(
            "job_id", F.col("key").alias("annotation_key"), "value.review_status", "value.review_note"
        )
    )


def clean_annotations(rows: DataFrame) -> DataFrame:
    """Sanitise annotation rows."""
    cleaned = clean_annotation("review_status", "review_note")
    return (
        rows.withColumn("annotation_key", strip("annotation_key"))
        .where(filled("annotation_key").isNotNull())
        .select("job_id", "annotation_key", cleaned.alias("_a"))
        .select("job_id", "annotation_key", "_a.*")
    )


RUN_ENTRY = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("actual_bbb_model_status", T.StringType()),
    T.StructField("fallback_placeholder_used", T.BooleanType()),
    T.StructField("public_lookup_requested", T.BooleanType()),
    T.StructField("output_file", T.StringType()),
    T.StructField("row_count", T.LongType()),
])


def read_run_manifest(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per run of a nested manifest map; malformed text gives no rows."""
    shape = T.StructType([T.StructField("runs", T.MapType(T.StringType(), RUN_ENTRY))])
    runs = F.from_json(col(payload), shape)["runs"]
    return raw.select(F.explode(runs).alias("job_id", "run")).select("job_id", "run.*")
