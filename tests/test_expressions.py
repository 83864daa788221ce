"""Decision tables and edge values of the row expressions."""

import pytest
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions import keys as K
from siftrank.functions import numbers as N
from siftrank.functions import scoring as S
from siftrank.functions import text as X
from siftrank.functions.evidence import with_evidence
from siftrank.schemas import RESULT_SCHEMA, struct_of

EVIDENCE_IN = [
    "valid_molecule", "known_compound_match", "known_compound_name", "identity_check_status",
    "closest_known_compound_name", "closest_known_compound_similarity", "similarity_check_status",
    "pubchem_exact_match", "pubchem_cid", "pubchem_preferred_name", "pubchem_lookup_status",
    "chembl_exact_match", "chembl_similarity_match", "chembl_activity_count", "chembl_target_summary",
    "chembl_lookup_status", "patent_public_evidence_match", "patent_record_count", "patent_lookup_status",
]
BASE = {
    "valid_molecule": True, "known_compound_match": False, "identity_check_status": "no_exact_match",
    "closest_known_compound_name": "Near", "closest_known_compound_similarity": 0.2,
    "similarity_check_status": "closest_match_found", "pubchem_exact_match": False,
    "pubchem_lookup_status": "not_requested", "chembl_exact_match": False, "chembl_similarity_match": False,
    "chembl_lookup_status": "not_requested", "patent_public_evidence_match": False,
    "patent_lookup_status": "not_requested",
}
CASES = [
    ({"valid_molecule": False}, "invalid_molecule", "invalid_molecule", V.INVALID_NOTE),
    ({"known_compound_match": True, "known_compound_name": "Sample K1"}, "identity_context",
     "moderate_evidence_context", "match found (Sample K1)"),
    ({"pubchem_exact_match": True, "pubchem_cid": "90017", "pubchem_lookup_status": "exact_match"}, "identity_context",
     "moderate_evidence_context", "exact match found (90017)"),
    ({"chembl_exact_match": True, "chembl_activity_count": 19, "chembl_lookup_status": "exact_match"},
     "public_bioactivity_context", "moderate_evidence_context", "returned 19 activity records"),
    ({"patent_public_evidence_match": True, "patent_record_count": 12, "patent_lookup_status": "match_found"},
     "patent_context_signal", "moderate_evidence_context", "returned 12 records"),
    ({"closest_known_compound_similarity": 0.91, "closest_known_compound_name": "Sample R4"},
     "local_similarity_context", "moderate_evidence_context", "closest local reference is Sample R4 (0.91)."),
    ({"valid_molecule": None}, "limited_public_context", "limited_public_context", "was not requested"),
    ({"closest_known_compound_similarity": 0.69}, "limited_public_context", "limited_public_context", "was not requested"),
    ({}, "limited_public_context", "limited_public_context", "was not requested"),
    ({"pubchem_exact_match": True, "pubchem_lookup_status": "exact_match", "chembl_exact_match": True,
      "chembl_lookup_status": "exact_match", "patent_public_evidence_match": True, "patent_record_count": 3,
      "patent_lookup_status": "match_found"}, "combined_public_context", "high_evidence_context", "(PubChem)"),
    ({"pubchem_lookup_status": "lookup_failed", "chembl_lookup_status": "lookup_failed",
      "patent_lookup_status": "lookup_failed"}, "limited_public_context", "limited_public_context",
     "Public identity lookup failed; missing data is not interpreted as no signal."),
    ({"pubchem_lookup_status": "no_exact_match", "chembl_lookup_status": "no_match",
      "patent_lookup_status": "no_match"}, "limited_public_context", "limited_public_context", V.NO_NOTES),
]


def test_evidence_decision_table(spark):
    rows = [tuple({**BASE, **over}.get(c) for c in EVIDENCE_IN) for over, *_ in CASES]
    schema = struct_of(EVIDENCE_IN)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))
    out = with_evidence(df).orderBy("i").collect()
    for row, (_, category, level, note) in zip(out, CASES):
        assert row["evidence_summary_category"] == category
        assert row["biopharma_context_level"] == level
        assert note in row["evidence_summary_notes"]
        assert row["recommended_review_focus"] == V.REVIEW_FOCUS[category]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_priority_score(spark):
    args = dict(mw=F.lit(300.0), tpsa=F.lit(60.0), rotatable=F.lit(5), qed=F.lit(0.5), rules_pass=F.lit(True),
                label=F.lit("high"), probability=F.lit(0.8), valid=F.lit(True))
    score = S.priority_score(**args)
    low = S.priority_score(**{**args, "label": F.lit("low")})
    none = S.priority_score(**{**args, "label": F.lit(None).cast("string"), "probability": F.lit(None).cast("double")})
    invalid = S.priority_score(**{**args, "valid": F.lit(False)})
    empty = S.priority_score(**{**args, "mw": F.lit(None).cast("double")})
    row = one(spark, *[c.alias(f"c{i}") for i, c in enumerate([score, low, none, invalid, empty])])
    assert list(row) == [0.815, 0.735, 0.775, 0.0, 0.0]


def test_rules(spark):
    ok = S.rule_violations(F.lit(212.5), F.lit(4), F.lit(2), F.lit(1.3))
    bad = S.rule_violations(F.lit(731.2), F.lit(14), F.lit(8), F.lit(6.4))
    assert list(one(spark, ok.alias("a"), bad.alias("b"))) == [0, 4]


@pytest.mark.parametrize("raw,value,status", [
    ("-6.15", -6.15, "provided"), (" 1_000 ", 1000.0, "provided"), ("high affinity", None, "invalid_docking_score"),
    ("1d", None, "invalid_docking_score"), ("", None, "invalid_docking_score"), (None, None, "invalid_docking_score"),
    (".5e1", 5.0, "provided"), ("1__0", None, "invalid_docking_score"),
])
def test_docking(spark, raw, value, status):
    d = one(spark, S.parse_docking(F.lit(raw).cast("string")).alias("d"))["d"]
    assert (d["docking_score"], d["docking_status"]) == (value, status)


def test_docking_absent(spark):
    assert one(spark, S.parse_docking("x", present=False).alias("d"))["d"]["docking_status"] == "not_provided"


@pytest.mark.parametrize("raw,label", [
    ("permeable", "high"), ("non-permeable", "low"), ("LABEL_1", "high"), ("10", "low"), ("maybe", "uncertain"),
    ("IMPERMEABLE", "low"), (None, "uncertain"),
])
def test_label(spark, raw, label):
    assert one(spark, S.normalize_label(F.lit(raw).cast("string")).alias("v"))["v"] == label


@pytest.mark.parametrize("raw,number", [
    ("1.5", 1.5), (" 2 ", 2.0), ("", None), ("x", None), ("inf", None), ("nan", None), (None, None)])
def test_to_number(spark, raw, number):
    assert one(spark, N.to_number(F.lit(raw).cast("string")).alias("v"))["v"] == number


def test_small_texts(spark):
    row = one(
        spark, X.title_label(F.lit("a_dNA__x")).alias("title"), X.title_label(F.lit("")).alias("none"),
        X.safe_filename(F.lit("  --a b/c?  ")).alias("file"), X.safe_filename(F.lit("??")).alias("fallback"),
        X.csv_cell(F.lit('a"b\nc')).alias("cell"), X.md_line("L", F.lit(None).cast("string")).alias("line"),
        N.number_text(F.lit(0.000123)).alias("tiny"), N.signed_text(F.lit(0.5)).alias("plus"),
        K.word_shingles(F.lit("a b")).alias("short"), K.word_shingles(F.lit("a b c a b c")).alias("long"),
        K.annotation_key(F.lit(" "), F.lit(3)).alias("key"),
        K.comparison_key(F.lit(""), F.lit(None).cast("string"), F.lit(" x "), F.lit(1)).alias("ck"),
    )
    assert row["title"] == "A DNA X" and row["none"] == "Not available"
    assert row["file"] == "a-b-c" and row["fallback"] == "compound"
    assert row["cell"] == '"a""b c"' and row["line"] == "- **L:** Not available"
    assert row["tiny"] == "0.000123" and row["plus"] == "+0.500"
    assert row["short"] == ["a b"] and row["long"] == ["a b c", "b c a", "c a b"]
    assert row["key"] == "row_3" and row["ck"] == "input:x"


def test_annotation_cleaning(spark):
    a = one(spark, X.clean_annotation(F.lit(" MAYBE "), F.lit("  " + "n" * 600)).alias("a"))["a"]
    assert a["review_status"] == "unreviewed" and len(a["review_note"]) == 500


def test_result_columns_are_fixed():
    assert len(V.RESULT_COLUMNS) == 82 == len(set(V.RESULT_COLUMNS)) == len(RESULT_SCHEMA.fields)
    assert len(V.PROPERTY_COLUMNS) == 41 and len(V.COMPARISON_COLUMNS) == 33
