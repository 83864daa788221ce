"""Display labels and the first-match interpretation of a result row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.numbers import col, is_true, number_text, round_dp, to_number
from siftrank.functions.text import detail_text, filled, first_filled, title_label


def _or_status(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("not available"))


def closest_label() -> Column:
    name = filled("closest_known_compound_name")
    score = number_text("closest_known_compound_similarity")
    return (
        F.when(name.isNull(), _or_status("similarity_check_status"))
        .otherwise(F.concat(name, F.coalesce(F.concat(F.lit(" ("), score, F.lit(")")), F.lit(""))))
    )


def identity_label() -> Column:
    name = F.coalesce(filled("pubchem_preferred_name"), F.lit("PubChem exact match"))
    cid = F.coalesce(F.concat(F.lit("CID "), filled("pubchem_cid")), F.lit("PubChem"))
    return F.when(is_true("pubchem_exact_match"), F.format_string("%s (%s)", name, cid)).otherwise(
        _or_status("pubchem_lookup_status")
    )


def bioactivity_label() -> Column:
    exact = F.coalesce(first_filled("chembl_pref_name", "chembl_molecule_id"), F.lit("ChEMBL match"))
    analog = F.coalesce(
        first_filled("chembl_similarity_pref_name", "chembl_similarity_molecule_id"),
        F.lit("ChEMBL analog"),
    )
    score = F.coalesce(
        F.concat(F.lit(", similarity "), number_text(F.nullif(F.col("chembl_similarity_score"), F.lit(0.0)))),
        F.lit(""),
    )
    return (
        F.when(is_true("chembl_exact_match"),
               F.format_string("%s (%s activities)", exact, detail_text("chembl_activity_count")))
        .when(is_true("chembl_similarity_match"), F.concat(analog, score))
        .otherwise(_or_status("chembl_lookup_status"))
    )


def document_label() -> Column:
    count = filled(F.nullif(F.col("patent_record_count").cast("string"), F.lit("0")))
    returned = F.coalesce(F.concat(count, F.lit(" returned records")), F.lit("returned records"))
    source = F.coalesce(filled("patent_source"), F.lit(V.DOCUMENT_SOURCE))
    return F.when(
        is_true("patent_public_evidence_match"),
        F.format_string("%s returned %s for this structure/query", source, returned),
    ).otherwise(_or_status("patent_lookup_status"))


def cluster_label() -> Column:
    cluster = filled(F.col("diversity_cluster_id").cast("string"))
    return (
        F.when(F.col("diversity_status") == "not_run_invalid_molecule", "Not run for invalid molecule")
        .when(cluster.isNull(), title_label("diversity_status"))
        .otherwise(F.format_string("Cluster %s (%s molecules)", cluster, detail_text("diversity_cluster_size")))
    )


def neighbour_label() -> Column:
    prefix = F.coalesce(F.concat(filled("nearest_neighbor_molecule_id"), F.lit(": ")), F.lit(""))
    score = number_text("nearest_neighbor_similarity")
    return F.coalesce(F.concat(prefix, score), F.lit(V.NOT_AVAILABLE))


def model_label(suffix: str) -> Column:
    """Prediction and probability of one side of a run comparison."""
    label = filled(f"bbb_prediction_{suffix}")
    score = number_text(f"bbb_probability_{suffix}")
    return F.coalesce(
        F.concat(label, F.coalesce(F.concat(F.lit(" ("), score, F.lit(")")), F.lit(""))),
        F.lit(V.NOT_AVAILABLE),
    )


def yes_no(value: Column | str) -> Column:
    text = col(value).cast("string")
    return (
        F.when(text.isin("true", "True"), "Yes")
        .when(text.isin("false", "False"), "No")
        .otherwise(V.NOT_AVAILABLE)
    )


def pass_fail(value: Column | str) -> Column:
    return F.when(col(value), "Pass").when(~col(value), "Fail")


def run_label(job_id: Column | str, completed_at: Column | str, row_count: Column | str) -> Column:
    return F.concat_ws(
        " | ", col(job_id), filled(completed_at),
        F.concat(col(row_count).cast("string"), F.lit(" rows")),
    )


def lookup_sources() -> Column:
    """Names of the requested lookups of a run."""
    names = [F.when(is_true(flag), name) for flag, name in V.LOOKUP_FLAGS.items()]
    return F.coalesce(filled(F.concat_ws(", ", *names)), F.lit("None requested"))


def has_docking() -> Column:
    return F.coalesce(
        F.col("docking_score").isNotNull() & (F.col("docking_status") != "not_provided"), F.lit(False)
    )


def interpretation() -> Column:
    """Struct ``(label, message)``: the first of eight readings that applies."""
    synthesised = first_filled("evidence_summary_category", "evidence_summary_notes").isNotNull()
    invalid = (
        (F.col("valid_molecule") == False)  # noqa: E712 - NULL must not count
        | (F.col("similarity_check_status") == "not_run_invalid_molecule")
        | (F.col("identity_check_status") == "not_run_invalid_molecule")
    )
    closeness = to_number("closest_known_compound_similarity")
    known = detail_text("known_compound_name")
    closest = detail_text("closest_known_compound_name")
    readings = [
        (synthesised,
         title_label(F.coalesce(filled("evidence_summary_category"),
                                F.lit("computational_screening_summary"))),
         F.coalesce(filled("evidence_summary_notes"),
                    F.lit("Computational screening summary is not available for this row."))),
        (invalid, F.lit("Invalid molecule"),
         F.lit("Invalid molecule: local identity and similarity context were not run for this row.")),
        (is_true("known_compound_match"), F.lit("Exact known compound"),
         F.format_string("Exact known compound: this molecule matches %s in the local reference table.", known)),
        (is_true("pubchem_exact_match"), F.lit("Public compound match"),
         F.format_string("PubChem exact match: this molecule matched %s with CID %s. This is a public "
                         "identity signal only, not a legal conclusion.",
                         detail_text("pubchem_preferred_name"), detail_text("pubchem_cid"))),
        (is_true("chembl_exact_match") | is_true("chembl_similarity_match"),
         F.lit("Public bioactivity context"),
         F.format_string("ChEMBL match: %s. This is a public database signal, not a clinical conclusion.",
                         bioactivity_label())),
        (is_true("patent_public_evidence_match"), F.lit("Patent-context signal"),
         F.format_string("Public patent-associated evidence: %s. Record counts may include broad or "
                         "indirect public document associations. This is a public database signal only, "
                         "not a legal conclusion.", document_label())),
        (closeness >= V.HIGH_SIMILARITY, F.lit("Close analog signal"),
         F.format_string("Close analog signal: the closest local reference is %s with similarity %s.",
                         closest, F.format_string("%.3f", round_dp(closeness, 3)))),
    ]
    label, message = F.lit("No close local-reference match"), F.lit(
        "No close local-reference match: this row has no exact match and no closest-known similarity "
        "above the configured threshold."
    )
    for applies, name, text in reversed(readings):
        label = F.when(applies, name).otherwise(label)
        message = F.when(applies, text).otherwise(message)
    return F.struct(label.alias("label"), message.alias("message"))

