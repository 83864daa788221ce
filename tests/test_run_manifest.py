"""The run manifest: latest records, snapshots, unfinished commits and concurrent writers."""

from concurrent.futures import ThreadPoolExecutor

from siftrank.sources.run_manifest import RunManifest, run_records

COLUMNS = ("job_id string, pubchem_lookup_status string, pubchem_warning string, chembl_lookup_status string, chembl_warning string, "
           "patent_lookup_status string, patent_warning string, bbb_model_status string")


def records(spark, job, status="exact_match", rows=2):
    data = [(job, status, "w", "not_requested", "", "lookup_failed", "b" if i else "a", "model_available") for i in range(rows)]
    return run_records(spark.createDataFrame(data, COLUMNS), "out")


def test_latest_record_counts_and_snapshots_stay(spark, tmp_path):
    manifest = RunManifest(spark, str(tmp_path / "m"))
    assert manifest.latest_number() == 0
    assert [manifest.commit(records(spark, j, s, n)) for j, s, n in (("x", "exact_match", 1), ("y", "lookup_failed", 2), ("x", "lookup_failed", 3))] == [1, 2, 3]
    runs = {r.job_id: r for r in manifest.runs().collect()}
    assert (runs["x"].row_count, runs["x"].latest_run, runs["x"].identity_status) == (3, True, "lookup_failed")
    assert (runs["y"].latest_run, runs["y"].identity_error_message, runs["y"].document_error_message) == (False, "w", "a; b")
    assert runs["x"].output_file == "out/job_id=x" and runs["x"].timestamp.endswith("+00:00")
    early = {r.job_id: r for r in manifest.runs(upto=2).collect()}
    assert early["x"].row_count == 1 and early["y"].latest_run
    success = {r.source: r.last_successful_lookup for r in manifest.last_success().collect()}
    assert success["identity"] != "" and success["bioactivity"] == success["document"] == ""


def test_rows_of_an_unfinished_commit_do_not_count(spark, tmp_path):
    manifest = RunManifest(spark, str(tmp_path / "m"))
    manifest.commit(records(spark, "x"))
    records(spark, "lost").write.parquet(f"{tmp_path}/m/records/commit=never")
    assert [r.job_id for r in manifest.runs().collect()] == ["x"]


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    manifest = RunManifest(spark, str(tmp_path / "m"))
    jobs = [f"j{i}" for i in range(8)]
    frames = [records(spark, j) for j in jobs]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(manifest.commit, frames))
    assert sorted(numbers) == list(range(1, 9))
    runs = manifest.runs().collect()
    assert sorted(r.job_id for r in runs) == jobs and sum(r.latest_run for r in runs) == 1
