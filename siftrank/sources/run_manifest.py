"""Manifest of all runs as a log of numbered commits that several writers can append to."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions.numbers import iso_text, utc_seconds
from siftrank.operators.summaries import SOURCES, run_rollup, source_status

LOG = "commit string"
#: A local file system looks for the target and renames in two steps, so this process's writers do it one at a time.
_RENAMING = threading.Lock()


def run_records(rows: DataFrame, output_root: str, job_id: str = "job_id") -> DataFrame:
    """One record per run: its rollup, time, output file and, for each source, status, last success and error."""
    out = run_rollup(rows, job_id).withColumns({
        "timestamp": iso_text(utc_seconds()), "output_file": F.concat(F.lit(f"{output_root}/job_id="), F.col(job_id))})
    for source in SOURCES:
        state = source_status(rows, source, [job_id]).select(
            job_id, F.col("status").alias(f"{source}_status"), F.col("last_successful_lookup").alias(f"{source}_last_successful_lookup"),
            F.col("error_message").alias(f"{source}_error_message"))
        out = out.join(state, job_id)
    return out


@dataclass(frozen=True)
class RunManifest:
    """Run records below ``path``: rows in ``records/commit=…``, and a log whose numbered files name the commits.

    A commit counts from the moment its log file has its number: the file is renamed into place, which fails if
    another writer took the number first; then the next one is tried. Readers see whole commits only.
    """

    spark: SparkSession
    path: str

    def commit(self, records: DataFrame) -> int:
        """Append the records of finished runs and return the commit's number."""
        name = uuid.uuid4().hex
        records.write.parquet(f"{self.path}/records/commit={name}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs.Path
        waiting = hadoop(f"{self.path}/waiting/{name}")
        files = waiting.getFileSystem(conf)
        stream = files.create(waiting, False)
        stream.write(bytearray(json.dumps({"commit": name}).encode()))
        stream.close()
        log = hadoop(f"{self.path}/log")
        files.mkdirs(log)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        number = self.latest_number() + 1
        while True:
            try:
                with _RENAMING:
                    context.rename(waiting, hadoop(log, f"{number:012d}.json"), none)
                return number
            except Py4JJavaError as taken:
                if "FileAlreadyExists" not in taken.java_exception.getClass().getName():
                    raise
                number += 1

    def latest_number(self) -> int:
        """Number of the last commit, 0 for none."""
        return self._log().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] if self._exists("log") else 0

    def _exists(self, part: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).option("pathGlobFilter", "*.json").json(f"{self.path}/log").select(
            "commit", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("number"))

    def history(self, upto: int | None = None) -> DataFrame:
        """All committed records with their commit's ``number``, or those of a snapshot."""
        log = self._log() if upto is None else self._log().where(F.col("number") <= upto)
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/records").join(log, "commit").drop("commit")

    def runs(self, upto: int | None = None) -> DataFrame:
        """Latest record of every run; ``latest_run`` marks the run of the last commit (of several, the last by time and id)."""
        every = self.history(upto)
        names = [c for c in every.columns if c != "job_id"]
        latest = every.groupBy("job_id").agg(F.max_by(F.struct(*names), "number").alias("r")).select("job_id", "r.*")
        last = latest.agg(F.max(F.struct("number", "timestamp", "job_id")).alias("last")).select("last.*")
        return latest.crossJoin(F.broadcast(last.select(F.col("job_id").alias("_last")))).select(
            *latest.columns, (F.col("job_id") == F.col("_last")).alias("latest_run"))

    def last_success(self) -> DataFrame:
        """``(source, last_successful_lookup)`` over all runs; empty text for a source without one."""
        pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"{s}_last_successful_lookup").alias("at")) for s in SOURCES])
        return self.history().select(F.explode(pairs).alias("p")).groupBy("p.source").agg(F.max("p.at").alias("last_successful_lookup"))
