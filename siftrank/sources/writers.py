"""Writers: results, run states, annotations, caches, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.numbers import utc_seconds
from siftrank.functions.text import csv_cell, filled, first_filled, plain_text, strip
from siftrank.schemas import STORED_RESULT, column_type
from siftrank.session import durable
from siftrank.sources.readers import clean_annotations, stored_annotations


def result_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """Exactly the named columns in order; absent ones are NULL of their declared type."""
    return df.select(*[
        F.col(n) if n in df.columns else F.lit(None).cast(column_type(n)).alias(n) for n in names
    ])


def write_ranked(df: DataFrame, path: str, job_id: str) -> None:
    """Store one run's rows in place of its earlier ones; other runs stay.

    Rows keep ``rank_position``, so their order survives without sorting files.
    The run's own folder is overwritten, so an empty run replaces its rows too
    and leaves a file with the full schema.
    """
    rows = df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in STORED_RESULT.fields if f.name != "job_id"
    ])
    rows.write.mode("overwrite").parquet(f"{path}/{partition_folder(df.sparkSession, 'job_id', job_id)}")


def partition_folder(spark: SparkSession, column: str, value: str) -> str:
    """Folder name of one partition value, escaped as the engine's readers expect it."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return escape(column, value)


def upsert_run(states: DataFrame, path: str) -> None:
    """Append run states; readers take the latest per run (:func:`latest_runs`)."""
    stamped = states if "updated_at" in states.columns else states.withColumn("updated_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def append_run_summary(summary: DataFrame, path: str) -> None:
    """Append the rollup of a run to a plain table; :mod:`siftrank.sources.run_manifest` keeps times and the latest run."""
    summary.write.mode("append").parquet(path)


def save_annotations(spark: SparkSession, path: str, rows: DataFrame, job_id: str | None = None) -> None:
    """Replace the whole annotation set of every job in ``rows``.

    With ``job_id`` only that job's set is replaced, by its rows; none clears it.
    """
    if job_id is not None:
        own = clean_annotations(rows.where(F.col("job_id") == job_id)).drop("job_id")
        own.write.mode("overwrite").parquet(f"{path}/{partition_folder(spark, 'job_id', job_id)}")
        return
    _replace_sets(clean_annotations(rows), path)


def _replace_sets(cleaned: DataFrame, path: str) -> None:
    cleaned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def merged_annotations(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Old annotations with changed keys replaced; the last change of a key wins.

    ``changes`` carries ``change_no``, the order in which the changes were made.
    """
    keys = ["job_id", "annotation_key"]
    last = clean_annotations(
        changes.withColumn("annotation_key", strip("annotation_key")).groupBy(*keys).agg(
            F.max_by(F.struct("review_status", "review_note"), "change_no").alias("_row")
        ).select(*keys, "_row.*")
    )
    return old.join(last, keys, "left_anti").unionByName(last)


def merge_annotations(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Apply ``changes`` (see :func:`merged_annotations`) to the stored sets; sets of other jobs are not touched.

    The merged sets are made durable before the folders that they were read from are overwritten.
    """
    touched = changes.select("job_id").distinct()
    old = stored_annotations(spark, path).join(touched, "job_id", "left_semi")
    _replace_sets(durable(merged_annotations(old, changes)), path)


def upsert_lookup_cache(results: DataFrame, source: str, path: str) -> None:
    """Append fresh results ``(identity_key, result)``; failures are cached too."""
    (
        results.select(F.lit(source).alias("source"), "identity_key", utc_seconds().alias("cached_at"), "result")
        .write.mode("append").partitionBy("source").parquet(path)
    )


def export_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns in first-seen order."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def export_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """Fixed column list; columns the table does not have become blank."""
    return result_columns(df, names)


def csv_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as one line of always-quoted cells."""
    cells = [csv_cell(F.col(f.name), f.dataType) for f in df.schema.fields]
    return df.select(F.concat_ws(",", *cells).alias(name))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with header, every cell quoted, line breaks as spaces."""
    texts = [
        F.regexp_replace(plain_text(F.col(f.name), f.dataType), "\n", " ").alias(f.name)
        for f in df.schema.fields
    ]
    (
        df.select(*texts).write.mode("overwrite").option("header", True).option("quoteAll", True)
        .option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
    )


def candidate_properties(df: DataFrame, usable: str = "valid_molecule") -> DataFrame:
    """Long table of the non-empty properties of every exportable row.

    A row is exportable with a usable text; the text itself is the first
    property.
    """
    text = strip(F.coalesce(first_filled("canonical_smiles", "input_smiles"), F.lit("")))
    kept = df.where((text != "") & F.coalesce(F.col(usable), F.lit(False)))
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in V.PROPERTY_COLUMNS if n in types]
    pairs = [F.struct(F.lit("source_smiles").alias("property"), text.alias("value"))] + [
        F.struct(F.lit(n).alias("property"), plain_text(F.col(n), types[n]).alias("value")) for n in names
    ]
    long = kept.select(F.col("molecule_id").alias("record_id"), F.explode(F.array(*pairs)).alias("_p"))
    return long.select("record_id", "_p.*").where(filled("value").isNotNull())


def export_counts(df: DataFrame, usable: str = "valid_molecule") -> DataFrame:
    """One row: how many rows a property export keeps and skips."""
    text = strip(F.coalesce(first_filled("canonical_smiles", "input_smiles"), F.lit("")))
    keep = (text != "") & F.coalesce(F.col(usable), F.lit(False))
    return df.agg(
        F.count_if(keep).alias("exported"), F.count_if(~keep).alias("skipped")
    )


def require_exported(counts: DataFrame) -> None:
    """Raise when nothing can be exported."""
    row = counts.first()
    if row["exported"] + row["skipped"] == 0:
        raise ValueError("Candidate list is empty.")
    if row["exported"] == 0:
        raise ValueError(
            f"No valid candidate structures were available for SDF export. Skipped {row['skipped']} row(s)."
        )

