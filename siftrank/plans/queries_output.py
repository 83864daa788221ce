"""Queries of plug-ins, reports, streaming and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank import vocab as V
from siftrank.operators import reports as R
from siftrank.operators.filters import with_status_in
from siftrank.operators.joins import rank_positions
from siftrank.operators.lookups import LookupTables
from siftrank.operators.models import enrich_rows, score_with_model
from siftrank.options import RunOptions
from siftrank.plans import bindings as B
from siftrank.plans.prioritise import prioritise
from siftrank.plans.queries_lookup import (
    EVID, chemicals, compounds, doc_activities, doc_molecules, evidence_rows, records,
)
from siftrank.plans.registry import query
from siftrank.functions.evidence import with_evidence
from siftrank.operators.identity import keyed_reference
from siftrank.sources.readers import latest_runs
from siftrank.streaming.incremental import RunTables, incremental_runs

P = B.with_sql("cand_p")


def length_model():
    """Factory of a small deterministic model of the text length."""

    class LengthModel:
        def predict(self, texts):
            return [("Permeable" if len(t) % 2 == 0 else "non-permeable", (len(t) % 97) / 97) for t in texts]

    return LengthModel


@query("score_with_model", P + f""" select molecule_id, case when not valid_molecule then 'unavailable' when length(smiles) % 2 = 0 then 'high' else 'low' end as bbb_prediction,
  case when valid_molecule then {B.dp("(length(smiles) % 97) / 97.0", 3)} end as bbb_probability,
  case when valid_molecule then 'model_available' else 'not_run_invalid_molecule' end as bbb_model_status,
  case when valid_molecule then '' else 'BBB prediction skipped for invalid molecule.' end as bbb_warning from raw_p""")
def model_scores(spark, sf):
    """A user model, built once per task and fed in Arrow batches."""
    return score_with_model(B.parts(spark, sf), length_model(), text="smiles").select("molecule_id", *V.MODEL_COLUMNS)


@query("model_unavailable", P + """ select molecule_id, 'unavailable' as bbb_prediction, case when valid_molecule then 'model_unavailable' else 'not_run_invalid_molecule' end as bbb_model_status,
  case when valid_molecule then 'no model' else 'BBB prediction skipped for invalid molecule.' end as bbb_warning from raw_p""")
def no_model(spark, sf):
    out = score_with_model(B.parts(spark, sf), None, text="smiles", warning="no model")
    return out.select("molecule_id", "bbb_prediction", "bbb_model_status", "bbb_warning")


@query("enrich_rows", P + """ select molecule_id, case when valid_molecule and ord % 11 <> 0 then length(smiles) end as n_chars,
  case when valid_molecule and ord % 11 <> 0 then upper(smiles) end as shout, case when not valid_molecule then 'blank text' when ord % 11 = 0 then 'bad ' || ord end as error from raw_p""")
def enriched(spark, sf):
    """A user function per row; its exceptions become data."""

    def describe(row):
        if not row["smiles"]:
            raise ValueError("blank text")
        if row["ord"] % 11 == 0:
            raise ValueError(f"bad {row['ord']}")
        return {"n_chars": len(row["smiles"]), "shout": row["smiles"].upper()}

    fields = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("shout", T.StringType())])
    return enrich_rows(B.parts(spark, sf), describe, fields, ["ord", "smiles"]).select(
        "molecule_id", "n_chars", "shout", "error")


# ---- reports ----------------------------------------------------------------------


def _title(column: str) -> str:
    return f"array_to_string(list_transform(string_split({column}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _flag(column: str) -> str:
    return f"case when {column} then 'True' when not {column} then 'False' end"


STATUS = "upper(review_status[1]) || review_status[2:]"
CLOSEST = "case when closest_known_compound_name is null then similarity_check_status else closest_known_compound_name || coalesce(' (' || closest_known_compound_similarity::varchar || ')', '') end"
IDENTITY = "case when pubchem_exact_match then coalesce(pubchem_preferred_name, 'PubChem exact match') || ' (CID ' || pubchem_cid || ')' else pubchem_lookup_status end"
BIOACTIVITY = """case when chembl_exact_match then chembl_molecule_id || ' (' || coalesce(chembl_activity_count::varchar, 'Not available') || ' activities)'
  when chembl_similarity_match then chembl_similarity_molecule_id || ', similarity 0.9' else chembl_lookup_status end"""
DOCUMENT = """case when patent_public_evidence_match then 'SureChEMBL returned ' || case when patent_record_count > 0 then patent_record_count || ' returned records' else 'returned records' end || ' for this structure/query' else patent_lookup_status end"""
CLUSTER = "case when diversity_status = 'not_run_invalid_molecule' then 'Not run for invalid molecule' else 'Cluster ' || diversity_cluster_id || ' (' || diversity_cluster_size || ' molecules)' end"
NEIGHBOUR = "coalesce(nearest_neighbor_molecule_id || ': ', '') || nearest_neighbor_similarity::varchar"
YES = "case when diversity_representative then 'Yes' else 'No' end"
NONE = "null"


def _lines(pairs: list[tuple[str, str]]) -> str:
    return " || chr(10) || ".join(
        f"'- **{label}:** ' || coalesce(nullif(({expr})::varchar, ''), 'Not available')" for label, expr in pairs)


PACKAGE = _lines([
    ("Review status", STATUS), ("Review note", NONE), ("Priority score", "priority_score"), ("Input SMILES", NONE),
    ("Canonical SMILES", NONE), ("BBB prediction", NONE), ("BBB probability", NONE), ("Molecular weight", NONE), ("LogP", NONE),
    ("TPSA", NONE), ("QED", NONE), ("Known compound match", _flag("known_compound_match")), ("Closest known compound", CLOSEST),
    ("PubChem match", IDENTITY), ("ChEMBL context", BIOACTIVITY), ("Patent-context signal", DOCUMENT),
    ("Evidence summary", _title("evidence_summary_category")), ("Biopharma context level", _title("biopharma_context_level")),
    ("Recommended review focus", "'focus'"), ("Diversity cluster", CLUSTER), ("Cluster representative", YES),
    ("Nearest neighbor similarity", NEIGHBOUR), ("Chemical-space X", "chemical_space_x"), ("Chemical-space Y", "round(chemical_space_y, 2)"),
    ("Chemical-space method", NONE)])


def report_rows(spark, sf):
    rows = with_evidence(evidence_rows(spark, sf))
    return rows.withColumns({
        "recommended_review_focus": F.lit("focus"), "chemical_space_y": F.round("chemical_space_y", 2),
        "review_status": F.when(F.col("review_status") == "", "unreviewed").otherwise(F.col("review_status")),
    })


@query("render_package", EVID + f""", kept as (select *, row_number() over (order by priority_score desc, rank_position) - 1 as pos from evid where review_status in ('selected', 'watchlist'))
select pos as position, md5('## ' || (pos + 1) || '. ' || molecule_id || chr(10) || {PACKAGE} || chr(10)) as digest from kept
union all select -1, md5('# Candidate Handoff Package' || chr(10) || chr(10) || '{V.PACKAGE_DISCLAIMER}' || chr(10) || chr(10) || '## Package summary' || chr(10)
 || '- **Candidate rows:** ' || count(*) || chr(10) || '- **Selected:** ' || count(*) filter (review_status = 'selected') || chr(10)
 || '- **Watchlist:** ' || count(*) filter (review_status = 'watchlist') || chr(10) || '- **Included review metadata:** Review status and notes included' || chr(10)) from kept""")
def render_package(spark, sf):
    """Head and one numbered section per kept row, as digests of the whole texts."""
    kept = with_status_in(report_rows(spark, sf), ["selected", "watchlist"])
    placed = rank_positions(kept.withColumnRenamed("rank_position", "ord"))
    return R.render_package(placed).select("position", F.md5(F.col("text").cast("binary")).alias("digest"))


REPORT = " || ".join(["'# Compound Report: ' || molecule_id"] + [
    f"""case when {cond} then chr(10) || chr(10) || '## {title}' || chr(10) || {_lines(pairs)} else '' end"""
    for title, cond, pairs in [
        ("Compound identity", "true", [("Molecule ID", "molecule_id"), ("Input SMILES", NONE), ("Canonical SMILES", NONE), ("Valid molecule", _flag("valid_molecule"))]),
        ("Molecular prioritization", "true", [("Priority score", "priority_score"), ("Lipinski pass/fail", "case when k % 2 = 0 then 'Pass' else 'Fail' end")]),
        ("Computational screening summary", "true", [
            ("Review status", STATUS), ("Review note", NONE), ("Evidence summary", _title("evidence_summary_category")), ("Summary notes", "'notes'"),
            ("Public identity signal", _title("case when bad then 'invalid_molecule' else s1 end")), ("Public bioactivity signal", _title("case when bad then 'invalid_molecule' else s2 end")),
            ("Patent-context signal", _title("case when bad then 'invalid_molecule' else s3 end")), ("Local similarity signal", _title("case when bad then 'invalid_molecule' else s4 end")),
            ("Biopharma context level", _title("biopharma_context_level")), ("Recommended review focus", "'focus'"), ("Diversity cluster", CLUSTER),
            ("Cluster representative", YES), ("Nearest neighbor similarity", NEIGHBOUR), ("Diversity status", _title("diversity_status")),
            ("Chemical-space X", "chemical_space_x"), ("Chemical-space Y", "round(chemical_space_y, 2)"), ("Chemical-space method", NONE),
            ("Chemical-space status", _title("chemical_space_status"))]),
        ("BBB prediction", "true", [("BBB prediction", NONE), ("BBB probability", NONE), ("BBB model status", "bbb_model_status"), ("BBB model name", NONE)]),
        ("RDKit descriptors", "true", [("Molecular weight", NONE), ("TPSA", NONE), ("HBA", NONE), ("HBD", NONE), ("Rotatable bonds", NONE), ("QED", NONE)]),
        ("Docking score", "docking_status = 'provided'", [("Docking score", "(-k)::double"), ("Docking status", "docking_status")]),
        ("Synthetic feasibility", "true", [("SA score", NONE), ("Synthetic feasibility category", "synthetic_feasibility_category"), ("Synthetic feasibility status", NONE)]),
        ("Known-compound identity", "true", [("Known compound match", _flag("known_compound_match")), ("Known compound name", "known_compound_name"), ("Known compound ID", NONE),
            ("Known compound source", NONE), ("Identity check status", "identity_check_status")]),
        ("Public compound match", "true", [("PubChem exact match", _flag("pubchem_exact_match")), ("PubChem CID", "pubchem_cid"), ("PubChem preferred name", "pubchem_preferred_name"),
            ("PubChem lookup status", "pubchem_lookup_status"), ("PubChem cache status", NONE), ("PubChem warning", "pubchem_warning")]),
        ("Public bioactivity context", "true", [("ChEMBL exact match", _flag("chembl_exact_match")), ("ChEMBL molecule ID", "chembl_molecule_id"), ("ChEMBL preferred name", NONE),
            ("ChEMBL lookup status", "chembl_lookup_status"), ("ChEMBL cache status", NONE), ("ChEMBL warning", NONE), ("Known public bioactivity records", "chembl_activity_count"),
            ("Associated public targets", NONE), ("ChEMBL target summary", "chembl_target_summary"), ("ChEMBL similarity match", _flag("chembl_similarity_match")),
            ("ChEMBL similarity score", "case when k % 7 = 2 then 0.9 end"), ("ChEMBL similarity molecule ID", "chembl_similarity_molecule_id"),
            ("ChEMBL similarity preferred name", NONE), ("ChEMBL similarity status", NONE)]),
        ("Public patent-context evidence", "true", [("Patent-context signal", DOCUMENT), ("Patent lookup status", "patent_lookup_status"), ("Patent cache status", NONE),
            ("Public patent-associated evidence", _flag("patent_public_evidence_match")), ("Patent source", "'SureChEMBL'"),
            ("SureChEMBL returned records for this structure/query", "patent_record_count"), ("Record-count interpretation", f"'{V.COUNT_NOTE}'"), ("Top patent record ID", NONE),
            ("Top patent record title", NONE), ("Top patent record URL", NONE), ("Patent query identifier", NONE), ("Patent warning", NONE)]),
        ("Closest known compound similarity", "true", [("Closest known compound", "closest_known_compound_name"), ("Closest known compound ID", NONE),
            ("Closest known compound similarity", "closest_known_compound_similarity"), ("Closest known compound source", "'local'"), ("Similarity check status", "similarity_check_status")]),
    ]] + [f"chr(10) || chr(10) || '## Notes/disclaimer' || chr(10) || '{V.REPORT_DISCLAIMER}' || chr(10)"])


@query("render_reports", EVID + f" select molecule_id, molecule_id as file_name, md5({REPORT}) as digest from evid")
def render_reports(spark, sf):
    """One report per row, as digests of the whole texts."""
    k = F.col("rank_position")
    rows = report_rows(spark, sf).withColumns({
        "evidence_summary_notes": F.lit("notes"), "lipinski_pass": k % 2 == 0,
        "docking_score": F.when(F.col("docking_status") == "provided", (-k).cast("double")),
    })
    return R.render_reports(rows).select("molecule_id", "file_name", F.md5(F.col("report").cast("binary")).alias("digest"))


# ---- whole runs ---------------------------------------------------------------------


@query("incremental_runs", """with f as (select p_partkey, p_partkey % 3 as batch, case when p_partkey % 7 = 0 then null when p_partkey % 7 = 1 then 'high affinity' else '-' || p_size || '.5' end as d from part where p_partkey % 3 <> 2),
r as (select 'P' || p_partkey as molecule_id, batch, row_number() over (partition by batch order by p_partkey) - 1 as rank_position,
  case when d like '-%' then d::double end as docking_score, case when d like '-%' then 'provided' else 'invalid_docking_score' end as docking_status from f)
select molecule_id, rank_position, docking_score, docking_status, 'completed' as run_status from r
union all select null, null, null, null, 'failed'""")
def stream(spark, sf):
    """Three arriving files, one without a required column: two completed runs and a failed one."""
    source, out = B.scratch(spark, "arrivals"), B.scratch(spark, "stream")
    p = B.table(spark, sf, "part")
    k = F.col("p_partkey")
    docking = F.when(k % 7 == 1, "high affinity").when(k % 7 != 0, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".5")))
    rows = p.select((k % 3).alias("batch"), k.alias("key"), F.concat(F.lit("P"), k.cast("string")).alias("molecule_id"),
                    F.col("p_name").alias("smiles"), docking.alias("docking_score"))
    good = rows.where("batch < 2").repartition("batch").sortWithinPartitions("batch", "key").drop("key")
    good.write.partitionBy("batch").csv(source, header=True)
    rows.where("batch = 2").select("molecule_id").repartition(1, "molecule_id").write.csv(f"{source}/batch=2", header=True)
    tables = RunTables(f"{out}/results", f"{out}/runs")
    incremental_runs(spark, source, tables, f"{out}/checkpoint",
                     lambda rows: prioritise(rows, diversity=False)).awaitTermination()
    runs = latest_runs(spark.read.parquet(tables.runs)).select("job_id", F.col("status").alias("run_status"))
    results = spark.read.parquet(tables.results)
    return runs.join(results, "job_id", "left").select(
        "molecule_id", "rank_position", "docking_score", "docking_status", "run_status")


@query("prioritise_documents")
def whole_run(spark, sf):
    """Everything on: reference, all lookups, evidence, ranking, diversity, projection."""
    rows = B.document_rows(spark, sf).where(~F.col("source").isin(*B.REFERENCE_SOURCES))
    n = F.col("n_chars")
    described = rows.withColumns({
        "mw": (n % 750).cast("double"), "tpsa": (n % 200).cast("double"), "hba": (n % 15).cast("int"), "hbd": (n % 8).cast("int"),
        "rotatable_bonds": (n % 20).cast("int"), "qed": (n % 1000) / 1000, "logp": (n % 70) / 10,
    })
    reference = B.with_features(keyed_reference(B.reference_documents(spark, sf)), "key")
    key = F.concat(F.lit("k"), F.col("ord").cast("string"))
    ids = rows.select(F.col("key").alias("identity_key"), key.alias("k"))
    tables = LookupTables(
        compounds=compounds(spark, sf).withColumnRenamed("identity_key", "k").join(ids, "k").drop("k"),
        molecules=doc_molecules(spark, sf), activities=doc_activities(spark, sf),
        chemicals=chemicals(spark, sf).withColumnRenamed("identity_key", "k").join(ids, "k").drop("k"),
        documents=records(spark, sf),
    )
    options = RunOptions(public_lookup=True, bioactivity_lookup=True, document_lookup=True)
    out = prioritise(described, reference, options, tables, length_model())
    return out.select(*V.RESULT_COLUMNS)
