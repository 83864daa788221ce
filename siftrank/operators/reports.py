"""Markdown package and per-row reports, built as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank import vocab as V
from siftrank.functions import labels as L
from siftrank.functions.text import md_line, md_value, review_label, safe_filename, title_label

def _package_lines() -> list[tuple[str, str | Column]]:
    return [
        ("Review status", review_label("review_status")),
        ("Review note", "review_note"),
        ("Priority score", "priority_score"),
        ("Input SMILES", "input_smiles"),
        ("Canonical SMILES", "canonical_smiles"),
        ("BBB prediction", "bbb_prediction"),
        ("BBB probability", "bbb_probability"),
        ("Molecular weight", "mw"),
        ("LogP", "logp"),
        ("TPSA", "tpsa"),
        ("QED", "qed"),
        ("Known compound match", "known_compound_match"),
        ("Closest known compound", L.closest_label()),
        ("PubChem match", L.identity_label()),
        ("ChEMBL context", L.bioactivity_label()),
        ("Patent-context signal", L.document_label()),
        ("Evidence summary", title_label("evidence_summary_category")),
        ("Biopharma context level", title_label("biopharma_context_level")),
        ("Recommended review focus", "recommended_review_focus"),
        ("Diversity cluster", L.cluster_label()),
        ("Cluster representative", L.yes_no("diversity_representative")),
        ("Nearest neighbor similarity", L.neighbour_label()),
        ("Chemical-space X", "chemical_space_x"),
        ("Chemical-space Y", "chemical_space_y"),
        ("Chemical-space method", "chemical_space_method"),
    ]


def _report_sections() -> list[tuple[str, list[tuple[str, str | Column]]]]:
    return [
        ("Compound identity", [
            ("Molecule ID", "molecule_id"), ("Input SMILES", "input_smiles"),
            ("Canonical SMILES", "canonical_smiles"), ("Valid molecule", "valid_molecule"),
        ]),
        ("Molecular prioritization", [
            ("Priority score", "priority_score"), ("Lipinski pass/fail", L.pass_fail("lipinski_pass")),
        ]),
        ("Computational screening summary", [
            ("Review status", review_label("review_status")), ("Review note", "review_note"),
            ("Evidence summary", title_label("evidence_summary_category")),
            ("Summary notes", "evidence_summary_notes"),
            ("Public identity signal", title_label("public_identity_signal")),
            ("Public bioactivity signal", title_label("public_bioactivity_signal")),
            ("Patent-context signal", title_label("patent_context_signal")),
            ("Local similarity signal", title_label("local_similarity_signal")),
            ("Biopharma context level", title_label("biopharma_context_level")),
            ("Recommended review focus", "recommended_review_focus"),
            ("Diversity cluster", L.cluster_label()),
            ("Cluster representative", L.yes_no("diversity_representative")),
            ("Nearest neighbor similarity", L.neighbour_label()),
            ("Diversity status", title_label("diversity_status")),
            ("Chemical-space X", "chemical_space_x"), ("Chemical-space Y", "chemical_space_y"),
            ("Chemical-space method", "chemical_space_method"),
            ("Chemical-space status", title_label("chemical_space_status")),
        ]),
        ("BBB prediction", [
            ("BBB prediction", "bbb_prediction"), ("BBB probability", "bbb_probability"),
            ("BBB model status", "bbb_model_status"), ("BBB model name", "bbb_model_name"),
        ]),
        ("RDKit descriptors", [
            ("Molecular weight", "mw"), ("TPSA", "tpsa"), ("HBA", "hba"), ("HBD", "hbd"),
            ("Rotatable bonds", "rotatable_bonds"), ("QED", "qed"),
        ]),
        ("Docking score", [("Docking score", "docking_score"), ("Docking status", "docking_status")]),
        ("Synthetic feasibility", [
            ("SA score", "sa_score"), ("Synthetic feasibility category", "synthetic_feasibility_category"),
            ("Synthetic feasibility status", "synthetic_feasibility_status"),
        ]),
        ("Known-compound identity", [
            ("Known compound match", "known_compound_match"), ("Known compound name", "known_compound_name"),
            ("Known compound ID", "known_compound_id"), ("Known compound source", "known_compound_source"),
            ("Identity check status", "identity_check_status"),
        ]),
        ("Public compound match", [
            ("PubChem exact match", "pubchem_exact_match"), ("PubChem CID", "pubchem_cid"),
            ("PubChem preferred name", "pubchem_preferred_name"),
            ("PubChem lookup status", "pubchem_lookup_status"),
            ("PubChem cache status", "pubchem_cache_status"), ("PubChem warning", "pubchem_warning"),
        ]),
        ("Public bioactivity context", [
            ("ChEMBL exact match", "chembl_exact_match"), ("ChEMBL molecule ID", "chembl_molecule_id"),
            ("ChEMBL preferred name", "chembl_pref_name"), ("ChEMBL lookup status", "chembl_lookup_status"),
            ("ChEMBL cache status", "chembl_cache_status"), ("ChEMBL warning", "chembl_warning"),
            ("Known public bioactivity records", "chembl_activity_count"),
            ("Associated public targets", "chembl_target_count"),
            ("ChEMBL target summary", "chembl_target_summary"),
            ("ChEMBL similarity match", "chembl_similarity_match"),
            ("ChEMBL similarity score", "chembl_similarity_score"),
            ("ChEMBL similarity molecule ID", "chembl_similarity_molecule_id"),
            ("ChEMBL similarity preferred name", "chembl_similarity_pref_name"),
            ("ChEMBL similarity status", "chembl_similarity_status"),
        ]),
        ("Public patent-context evidence", [
            ("Patent-context signal", L.document_label()), ("Patent lookup status", "patent_lookup_status"),
            ("Patent cache status", "patent_cache_status"),
            ("Public patent-associated evidence", "patent_public_evidence_match"),
            ("Patent source", "patent_source"),
            ("SureChEMBL returned records for this structure/query", "patent_record_count"),
            ("Record-count interpretation", F.lit(V.COUNT_NOTE)),
            ("Top patent record ID", "patent_top_record_id"),
            ("Top patent record title", "patent_top_record_title"),
            ("Top patent record URL", "patent_top_record_url"),
            ("Patent query identifier", "patent_query_identifier"), ("Patent warning", "patent_warning"),
        ]),
        ("Closest known compound similarity", [
            ("Closest known compound", "closest_known_compound_name"),
            ("Closest known compound ID", "closest_known_compound_id"),
            ("Closest known compound similarity", "closest_known_compound_similarity"),
            ("Closest known compound source", "closest_known_compound_source"),
            ("Similarity check status", "similarity_check_status"),
        ]),
    ]


def _block(df: DataFrame, lines: list[tuple[str, str | Column]]) -> Column:
    types: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for label, value in lines:
        if isinstance(value, str):
            known = value in types
            parts.append(md_line(label, F.col(value) if known else F.lit(None), types.get(value)))
        else:
            parts.append(md_line(label, value))
    return F.concat_ws("\n", *parts)


def package_sections(df: DataFrame, position: str = "rank_position") -> DataFrame:
    """``(position, section)``: one numbered section per row, in rank order by ``position``.

    ``df[position]`` is the dense 0-based position among the rows of the package.
    """
    number = (F.col(position) + 1).cast("string")
    head = F.concat(F.lit("## "), number, F.lit(". "), md_value("molecule_id"))
    return df.select(
        F.col(position).alias("position"),
        F.concat_ws("\n", head, _block(df, _package_lines()), F.lit("")).alias("section"),
    )


def package_head(df: DataFrame) -> DataFrame:
    """One row ``head``: title, disclaimer and counts of a package."""
    status = F.coalesce("review_status", F.lit("unreviewed"))
    lines = [
        ("Candidate rows", F.count("*").cast("string")),
        ("Selected", F.count_if(status == "selected").cast("string")),
        ("Watchlist", F.count_if(status == "watchlist").cast("string")),
        ("Included review metadata", F.lit("Review status and notes included")),
    ]
    body = [md_line(label, value) for label, value in lines]
    return df.agg(F.concat_ws(
        "\n", F.lit(V.PACKAGE_TITLE), F.lit(""), F.lit(V.PACKAGE_DISCLAIMER), F.lit(""),
        F.lit("## Package summary"), *body, F.lit(""),
    ).alias("head"))


def render_package(df: DataFrame, position: str = "rank_position") -> DataFrame:
    """``(position, text)``: the head at -1, then the sections; sorted by position."""
    head = package_head(df).select(F.lit(-1).cast("bigint").alias("position"), F.col("head").alias("text"))
    sections = package_sections(df, position).select(
        F.col("position").cast("bigint").alias("position"), F.col("section").alias("text")
    )
    return head.unionByName(sections).orderBy("position")


def render_reports(df: DataFrame) -> DataFrame:
    """``(file_name, report)`` per row; the docking section only where a score exists."""
    parts: list[Column] = [F.concat(F.lit(V.REPORT_TITLE), md_value("molecule_id"))]
    for title, lines in _report_sections():
        text = F.concat_ws("\n", F.lit(""), F.lit(f"## {title}"), _block(df, lines))
        parts.append(F.when(L.has_docking(), text) if title == "Docking score" else text)
    parts += [F.lit(""), F.lit("## Notes/disclaimer"), F.lit(V.REPORT_DISCLAIMER), F.lit("")]
    return df.select(
        "molecule_id", safe_filename("molecule_id").alias("file_name"), F.concat_ws("\n", *parts).alias("report")
    )


def write_package(df: DataFrame, path: str, position: str = "rank_position") -> None:
    """The package as text files that read in order."""
    render_package(df, position).select("text").write.mode("overwrite").text(path)


def write_reports(df: DataFrame, path: str) -> None:
    """The reports as one table ``(molecule_id, file_name, report)``; names need not be unique."""
    render_reports(df).write.mode("overwrite").parquet(path)
