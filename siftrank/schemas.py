"""Declared schemas of all stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from siftrank import vocab as V

_BOOLEAN = {
    "valid_molecule", "known_compound_match", "pubchem_exact_match", "chembl_exact_match",
    "chembl_similarity_match", "patent_public_evidence_match", "diversity_representative",
    "lipinski_pass",
}
_INTEGER = {"hba", "hbd", "rotatable_bonds", "lipinski_violations"}
_LONG = {
    "chembl_activity_count", "chembl_target_count", "patent_record_count",
    "diversity_cluster_id", "diversity_cluster_size", "rank_position",
}
_DOUBLE = {
    "priority_score", "closest_known_compound_similarity", "chembl_similarity_score",
    "nearest_neighbor_similarity", "chemical_space_x", "chemical_space_y", "docking_score",
    "sa_score", "bbb_probability", "mw", "tpsa", "qed",
}


def column_type(name: str) -> T.DataType:
    """Type of a result column."""
    if name in _BOOLEAN:
        return T.BooleanType()
    if name in _INTEGER:
        return T.IntegerType()
    if name in _LONG:
        return T.LongType()
    if name in _DOUBLE:
        return T.DoubleType()
    return T.StringType()


def struct_of(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, column_type(n)) for n in names])


RESULT_SCHEMA = struct_of(list(V.RESULT_COLUMNS))
STORED_RESULT = T.StructType(
    RESULT_SCHEMA.fields + [T.StructField("rank_position", T.LongType()), T.StructField("job_id", T.StringType())]
)
CANDIDATE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in V.REQUIRED_COLUMNS + V.OPTIONAL_COLUMNS]
)
RUN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("job_id", "upload_id", "status", "input_file", "output_file", "created_at", "completed_at",
      "error_message")]
    + [T.StructField("row_count", T.LongType())]
    + [T.StructField(n, T.BooleanType()) for n in ("public_lookup_requested", *V.LOOKUP_FLAGS)]
)
ANNOTATION_VALUE = T.StructType(
    [T.StructField("review_status", T.StringType()), T.StructField("review_note", T.StringType())]
)
ANNOTATION_MAP = T.MapType(T.StringType(), ANNOTATION_VALUE)
ANNOTATION_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ("job_id", "annotation_key", "review_status", "review_note")]
)
LOOKUP_RESULTS = {
    "identity": struct_of(V.IDENTITY_COLUMNS),
    "bioactivity": struct_of(V.BIOACTIVITY_COLUMNS),
    "document": struct_of(V.DOCUMENT_COLUMNS),
}
