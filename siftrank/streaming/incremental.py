"""Every newly arrived candidate file becomes one run."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftrank.functions.numbers import iso_text, utc_seconds
from siftrank.options import RunOptions
from siftrank.schemas import RUN_SCHEMA
from siftrank.sources.readers import read_candidates
from siftrank.sources.writers import partition_folder, upsert_run, write_ranked


@dataclass(frozen=True)
class RunTables:
    """Where results and run states are stored."""

    results: str
    runs: str


def run_id(path: str) -> Column:
    """Stable id of a file, so that a retried batch rewrites the same run."""
    return F.sha2(F.lit(path), 256)


def incremental_runs(
    spark: SparkSession, source_dir: str, tables: RunTables, checkpoint: str,
    run: Callable[[DataFrame], DataFrame], options: RunOptions = RunOptions(), files_per_batch: int = 16,
    available_now: bool = True, files_at_once: int = 4,
) -> StreamingQuery:
    """Start a stream over ``source_dir``; file tracking is exactly-once by the checkpoint.

    ``run`` turns the candidates of one file into result rows; ``options`` says
    which lookups it requests, for the run history.  Ranking and
    diversity are per run, so files are independent: the jobs of
    ``files_at_once`` files run side by side, and the driver only holds the
    names and states of at most ``files_per_batch`` files.  A file that fails
    marks its own run failed and does not stop the others.  A batch writes its
    states twice, before and after its files; a batch that is repeated rewrites
    the same runs.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch)
        .load(source_dir).select("path", "length")
    )

    def per_batch(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").distinct().orderBy("path").toLocalIterator()]
        if paths:
            run_files(spark, paths, tables, run, options, files_at_once)

    writer = arrivals.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_files(
    spark: SparkSession, paths: list[str], tables: RunTables, run: Callable[[DataFrame], DataFrame],
    options: RunOptions = RunOptions(), files_at_once: int = 4,
) -> None:
    """Validate, run and store some files side by side, with their states before and after in one write each."""
    begun = spark.createDataFrame([(p,) for p in paths], "path string").select("path", F.sha2("path", 256).alias("job_id"),
                                                                               iso_text(utc_seconds()).alias("at")).collect()
    jobs = {r["path"]: (r["job_id"], r["at"]) for r in begun}

    def one(path: str) -> tuple[str, int, str]:
        try:
            write_ranked(run(read_candidates(spark, path)), tables.results, jobs[path][0])
            # Only the run's own folder is listed: other runs are being replaced at the same time.
            own = f"{tables.results}/{partition_folder(spark, 'job_id', jobs[path][0])}"
            return "completed", spark.read.parquet(own).count(), ""
        except Exception as exc:  # noqa: BLE001 - the failure belongs to this run only
            return "failed", 0, str(exc) or type(exc).__name__

    _states(spark, tables, options, [(*jobs[p], p, "running", 0, "") for p in paths])
    with ThreadPoolExecutor(max(1, min(files_at_once, len(paths)))) as pool:
        ends = list(pool.map(one, paths))
    _states(spark, tables, options, [(*jobs[p], p, *end) for p, end in zip(paths, ends, strict=True)])


def one_file(
    spark: SparkSession, path: str, tables: RunTables, run: Callable[[DataFrame], DataFrame],
    options: RunOptions = RunOptions(),
) -> None:
    """:func:`run_files` of one file."""
    run_files(spark, [path], tables, run, options, 1)


def _states(spark: SparkSession, tables: RunTables, options: RunOptions, states: list[tuple]) -> None:
    """Append (job, created, path, status, rows, error) states of runs."""
    flags = {
        "public_lookup_requested": options.wants_any, "pubchem_lookup_requested": options.wants_identity,
        "chembl_lookup_requested": options.bioactivity_lookup, "patent_lookup_requested": options.document_lookup,
    }
    rows = spark.createDataFrame(
        states, "job_id string, created_at string, input_file string, status string, row_count bigint, error_message string")
    rows = rows.withColumns({
        **{name: F.lit(value) for name, value in flags.items()},
        "output_file": F.concat(F.lit(f"{tables.results}/job_id="), F.col("job_id")),
        "completed_at": F.when(F.col("status") != "running", iso_text(utc_seconds())),
    })
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None) for f in RUN_SCHEMA.fields]
    upsert_run(rows.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, RUN_SCHEMA.fields, strict=True)],
                           F.current_timestamp().alias("updated_at")), tables.runs)
