"""Readers, lookups, whole runs and the SQL comparison of a query sample."""

import os

import pytest
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.operators import lookups as E
from siftrank.operators import summaries as S
from siftrank.operators.compare import comparison_summary, compare_runs
from siftrank.plans.prioritise import prioritise
from siftrank.schemas import RESULT_SCHEMA
from siftrank.sources import readers as A
from siftrank.sources import writers as W
from tests.oracle import connect, difference, spark_rows, sql_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["rank_candidates", "keyed_reference", "lookup_identity", "lookup_documents", "evidence_signals",
          "compare_runs", "with_review", "run_history", "read_candidates", "similar_pairs", "nearest_neighbour",
          "candidate_properties", "incremental_runs"]


def write(path, text, bom=False):
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as handle:
        handle.write(text)
    return str(path)


def test_read_candidates(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'molecule_id,smiles,note\nx,"a\nb",1\n,CCO,2\n', bom=True)
    rows = A.read_candidates(spark, path).orderBy("ord").collect()
    assert [(r["ord"], r["molecule_id"], r["smiles"]) for r in rows] == [(1, "x", "a\nb"), (2, None, "CCO")]


def test_missing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="missing required columns: smiles."):
        A.read_candidates(spark, write(tmp_path / "a.csv", "molecule_id\nx\n"))


def test_header_only_keeps_the_schema(spark, tmp_path):
    rows = A.read_candidates(spark, write(tmp_path / "a.csv", "molecule_id,smiles\n"))
    W.write_ranked(prioritise(rows, diversity=False), str(tmp_path / "out"), "j1")
    assert prioritise(rows, diversity=False).count() == 0


def test_whole_run_keeps_invalid_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", "one two three four"), (2, "", "one two three four"), (3, "c", "  "), (4, "d", "other words here now")],
        "ord bigint, molecule_id string, smiles string")
    out = prioritise(rows, n_bits=64)
    assert out.columns[2:] == V.RESULT_COLUMNS
    assert [f.dataType for f in out.schema.fields[2:]] == [f.dataType for f in RESULT_SCHEMA.fields]
    got = {r["molecule_id"]: r for r in out.collect()}
    assert set(got) == {"a", "mol_2", "c", "d"}
    assert got["c"]["diversity_status"] == "not_run_invalid_molecule" and got["c"]["error"] == V.ERROR_EMPTY
    assert got["c"]["priority_score"] == 0.0 and got["c"]["diversity_representative"] is False
    assert got["a"]["nearest_neighbor_molecule_id"] == "mol_2" and got["a"]["nearest_neighbor_similarity"] == 1.0
    assert got["a"]["diversity_cluster_size"] == 2 and got["d"]["diversity_cluster_size"] == 1


def test_failed_lookups_stay_cached(spark):
    keys = spark.createDataFrame([("k1",), ("k2",)], "identity_key string")
    cache = spark.createDataFrame([("k1", "t")], "identity_key string, cached_at string").withColumn(
        "result", E.failed_result("identity", "boom"))
    hits, misses = E.cache_split(keys, cache, "identity")
    row = hits.first()["result"]
    assert row["pubchem_lookup_status"] == "lookup_failed" and row["pubchem_cache_status"] == "cache_hit"
    assert row["pubchem_warning"] == "boom" and [r[0] for r in misses.collect()] == ["k2"]
    assert E.cache_split(keys, cache, "identity", retry_failed=True)[1].count() == 2


def test_rollup_of_placeholders(spark):
    rows = spark.createDataFrame(
        [("j", "model_unavailable", "not_requested", "exact_match", "not_requested"),
         ("j", "not_run_invalid_molecule", "not_requested", "not_run_invalid_molecule", "not_requested")],
        "job_id string, bbb_model_status string, pubchem_lookup_status string, chembl_lookup_status string, patent_lookup_status string")
    row = S.run_rollup(rows).first()
    assert row["actual_bbb_model_status"] == "model_unavailable" and row["fallback_placeholder_used"]
    assert row["public_lookup_requested"] and row["row_count"] == 2


def test_empty_comparison(spark):
    empty = spark.createDataFrame([], "molecule_id string, canonical_smiles string, input_smiles string, rank_position bigint")
    assert set(comparison_summary(compare_runs(empty, empty)).first()) == {0}


def test_empty_summaries(spark):
    empty = spark.createDataFrame([], RESULT_SCHEMA).withColumn("rank_position", F.lit(0).cast("bigint"))
    assert S.run_summary(empty).count() == 0
    assert S.cluster_summary(empty).first()["diversity_summary"] == "Not available"
    assert list(S.padded_range(empty, "chemical_space_x").first()) == [-1.0, 1.0]
    with pytest.raises(ValueError, match="empty"):
        W.require_exported(W.export_counts(empty))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry

    got = spark_rows(entry.queries()[name](spark, SF))
    assert difference(got, sql_rows(connect(SF), entry.oracle_sql()[name])) is None


def test_queries_without_sql_are_the_iterative_ones():
    import __spark_entry__ as entry
    from siftrank.plans.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"project_2d", "diversity_analysis", "prioritise_documents"}


def test_one_failing_function_leaves_whole_error(spark, tmp_path):
    from siftrank.streaming.incremental import RunTables, one_file

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("molecule_id,smiles\nA,CC\n")
    (folder / "empty.csv").write_text("molecule_id,smiles\n")
    tables = RunTables(str(tmp_path / "results"), str(tmp_path / "runs"))
    long = "line one\n" + "x" * 2000

    def silent(_):
        raise ValueError

    def loud(_):
        raise ValueError(long)

    one_file(spark, f"file:{folder}/a.csv", tables, silent)
    assert [r.error_message for r in A.latest_runs(spark.read.parquet(tables.runs)).collect()] == ["ValueError"]
    one_file(spark, f"file:{folder}/a.csv", tables, loud)
    assert [r.error_message for r in A.latest_runs(spark.read.parquet(tables.runs)).collect()] == [long]
    one_file(spark, f"file:{folder}/empty.csv", tables, lambda rows: prioritise(rows, diversity=False))
    states = {r.input_file[-9:]: (r.status, r.row_count) for r in A.latest_runs(spark.read.parquet(tables.runs)).collect()}
    assert states["empty.csv"] == ("completed", 0)


def test_sixteen_files_run_side_by_side_and_a_broken_one_fails_alone(spark, tmp_path):
    from siftrank.streaming.incremental import RunTables, incremental_runs

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(15):
        (folder / f"f{i:02d}.csv").write_text("molecule_id,smiles\n" + "".join(f"m{j},C{'C' * j}\n" for j in range(i + 1)))
    (folder / "f15.csv").write_text("molecule_id\nbroken\n")
    tables = RunTables(str(tmp_path / "results"), str(tmp_path / "runs"))

    def outcome():
        states = A.latest_runs(spark.read.parquet(tables.runs)).collect()
        rows = {r.job_id: r["count"] for r in A.stored_results(spark, tables.results).groupBy("job_id").count().collect()}
        assert [(s.input_file[-7:], s.error_message[:300]) for s in states if rows.get(s.job_id, 0) != s.row_count] == []
        return sorted((s.input_file[-7:], s.status, s.row_count) for s in states)

    got = []
    for attempt in ("a", "b"):  # a stream without its checkpoint repeats the batch
        incremental_runs(spark, str(folder), tables, str(tmp_path / f"checkpoint-{attempt}"),
                         lambda rows: prioritise(rows, diversity=False), files_at_once=8).awaitTermination()
        got.append(outcome())
    assert got[0] == got[1] == [(f"f{i:02d}.csv", "completed", i + 1) for i in range(15)] + [("f15.csv", "failed", 0)]


def test_differing_headers_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("molecule_id,smiles\nA,CC\n")
    (tmp_path / "b.csv").write_text("smiles,molecule_id\nCCC,B\n")
    with pytest.raises(Exception, match="(?i)header"):
        A.read_candidates(spark, f"{tmp_path}/*.csv").collect()
    assert A.candidate_count(A.read_candidates(spark, f"{tmp_path}/a.csv")) == 1


def test_two_updated_runs_replace_both(spark):
    from siftrank import vocab as V
    from siftrank.operators.history import history_view, merge_history
    from siftrank.schemas import RUN_SCHEMA

    def run(job, at):
        row = {f.name: None for f in RUN_SCHEMA.fields} | {"job_id": job, "status": "completed", "completed_at": at}
        return tuple(row[f.name] for f in RUN_SCHEMA.fields)

    old = spark.createDataFrame([run("a", "1"), run("b", "2"), run("c", "3")], RUN_SCHEMA)
    new = spark.createDataFrame([run("a", "8"), run("b", "9")], RUN_SCHEMA)
    got = [(r.job_id, r.completed_at) for r in merge_history(history_view(old), new).collect()]
    assert got == [("b", "9"), ("a", "8"), ("c", "3")] and V.HISTORY_COLUMNS


def test_local_time_zone_gives_utc_text(spark):
    from siftrank.functions.numbers import iso_text

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        text = spark.sql("select timestamp_seconds(0) as t").select(iso_text("t")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert text == "1970-01-01T00:00:00+00:00"


def test_stored_result_can_be_scored_again(spark):
    columns = "ord long, molecule_id string, smiles string, mw double, tpsa double, hba int, hbd int, rotatable_bonds int, qed double"
    first = spark.createDataFrame([(1, "A", "CC", 300.0, 50.0, 2, 1, 3, .7)], columns)
    with_logp = first.selectExpr("*", "2.0D as logp")
    scored = prioritise(with_logp, diversity=False).first()
    again = first.selectExpr("*", f"{scored.lipinski_violations} as lipinski_violations", "true as lipinski_pass")
    repeated = prioritise(again, diversity=False).first()
    assert (repeated.priority_score, repeated.lipinski_violations, repeated.lipinski_pass) == (
        scored.priority_score, scored.lipinski_violations, True)
    assert scored.synthetic_feasibility_status == "not_run"


def test_long_chain_of_rising_priorities_settles(spark):
    from siftrank.operators.clustering import sphere_exclusion

    n = 1000
    points = spark.createDataFrame([(i, 1, i) for i in range(n)], "set_id long, members long, position long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    owner = {r.set_id: r.centroid for r in sphere_exclusion(points, edges).collect()}
    # Both ends have one neighbour, all others two: the chain is taken from its last inner point down.
    taken, free = {}, set(range(n))
    for p in sorted(free, key=lambda i: (1 if i in (0, n - 1) else 2, i), reverse=True):
        if p in free:
            taken |= {q: p for q in (p - 1, p, p + 1) if q in free}
            free -= {p - 1, p, p + 1}
    assert {p: o for p, o in owner.items() if o == p} == {p: o for p, o in taken.items() if o == p}


def test_written_reports_and_package_read_back(spark, tmp_path):
    from siftrank.operators.reports import render_package, write_package, write_reports

    rows = spark.createDataFrame([(1, "A b", "CC"), (2, "A/b", "CCC"), (3, None, "C")], "ord long, molecule_id string, smiles string")
    ranked = prioritise(rows, diversity=False)
    ranked = W.export_columns(ranked, [*V.RESULT_COLUMNS, "rank_position"]).withColumns({"review_status": F.lit("selected"), "review_note": F.lit("n")})
    write_reports(ranked, str(tmp_path / "reports"))
    stored = spark.read.parquet(str(tmp_path / "reports"))
    assert stored.count() == 3 and stored.where("length(report) > 100 and length(file_name) > 0").count() == 3
    write_package(ranked, str(tmp_path / "package"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "package")).collect()]
    expected = [line for r in render_package(ranked).collect() for line in r.text.split("\n")]
    assert sorted(lines) == sorted(expected)
