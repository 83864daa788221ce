"""Queries of row expressions, ranking, filters and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions import keys as K
from siftrank.functions import labels as L
from siftrank.functions import numbers as N
from siftrank.functions import scoring as S
from siftrank.functions import text as X
from siftrank.operators import filters as D
from siftrank.operators.identity import identity_join
from siftrank.operators.identity import keyed_reference as keyed
from siftrank.operators.joins import rank_positions
from siftrank.operators.ranking import ranked
from siftrank.plans import bindings as B
from siftrank.plans.prioritise import base_columns, prioritise, with_scores
from siftrank.plans.registry import query
from siftrank.sources.readers import clean_annotations, with_ordinals

P = B.with_sql("cand_p")
D_SQL = B.with_sql("docs")


def scored_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates from ``part`` with every row-level column."""
    raw = B.modelled_parts(spark, sf)
    return with_scores(base_columns(raw, ("bbb_prediction", "bbb_probability", "bbb_model_status")))


@query("rank_candidates", P + """,
known as (select molecule_id from scored_p where ord % 10 = 0 and valid_molecule)
select s.molecule_id, s.valid_molecule, s.priority_score,
  case when not s.valid_molecule then 'SMILES is empty.' end as error,
  case when not s.valid_molecule then 'not_run_invalid_molecule' when k.molecule_id is not null then 'exact_match'
       else 'no_exact_match' end as identity_check_status,
  row_number() over (order by priority_score desc, ord) - 1 as rank_position
from scored_p s left join known k using (molecule_id)""")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship flow: key, validate, score, match exactly, rank."""
    rows = rank_positions(scored_parts(spark, sf))
    known = base_columns(B.parts(spark, sf)).where((F.col("ord") % 10 == 0) & F.col("valid_molecule"))
    reference = known.select(F.col("canonical_smiles").alias("key"), F.col("molecule_id").alias("name"),
                             F.lit("part").alias("source"), F.col("molecule_id").alias("compound_id"))
    return identity_join(rows, reference).select(
        "molecule_id", "valid_molecule", "priority_score", "error", "identity_check_status", "rank_position")


@query("priority_score", P + " select molecule_id, priority_score, lipinski_violations, lipinski_pass, bbb_prediction, bbb_probability from scored_p")
def priority(spark, sf):
    return scored_parts(spark, sf).select(
        "molecule_id", "priority_score", "lipinski_violations", "lipinski_pass", "bbb_prediction", "bbb_probability")


@query("bounded_preference", f"""select p_partkey,
  {B.dp("case when p_size*15 < 150 then p_size*15/150.0 when p_size*15 > 500 then greatest(0, 1-(p_size*15-500)/500.0) else 1 end", 6)} as mw_part,
  {B.dp("case when p_size*4 < 20 then p_size*4/20.0 when p_size*4 > 140 then greatest(0, 1-(p_size*4-140)/140.0) else 1 end", 6)} as tpsa_part
from part""")
def preference(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select("p_partkey", N.round_dp(N.bounded_preference(F.col("p_size") * 15, 150, 500), 6).alias("mw_part"),
                    N.round_dp(N.bounded_preference(F.col("p_size") * 4, 20, 140), 6).alias("tpsa_part"))


@query("complexity_score", P + f""", s as (select molecule_id, valid_molecule,
  {B.dp("greatest(1::double, least(10::double, 1 + heavy_atoms/25.0 + rings*0.35 + bridgeheads*0.75 + spiro_atoms*0.75 + chiral_centers*0.5 + hetero_atoms/20.0))", 3)} as raw from cand_p)
select molecule_id, case when valid_molecule then raw end as sa_score,
  case when not valid_molecule then 'not_available' when raw <= 3 then 'easy' when raw <= 6 then 'moderate' else 'difficult' end as synthetic_feasibility_category,
  case when valid_molecule then 'heuristic_synthetic_accessibility' else 'not_run_invalid_molecule' end as synthetic_feasibility_status
from s""")
def complexity_score(spark, sf):
    p = B.parts(spark, sf)
    c = S.complexity("heavy_atoms", "rings", "bridgeheads", "spiro_atoms", "chiral_centers", "hetero_atoms", "valid_molecule")
    return p.select("molecule_id", c.alias("c")).select("molecule_id", "c.*")


@query("parse_docking", P + " select molecule_id, docking_score, docking_status from cand_p")
def docking(spark, sf):
    return B.parts(spark, sf).select("molecule_id", S.parse_docking("docking_score").alias("d")).select("molecule_id", "d.*")


@query("normalize_label", P + f" select ord, raw_label, {B.LABEL_SQL} as label from raw_p")
def label(spark, sf):
    return B.parts(spark, sf).select("ord", "raw_label", S.normalize_label("raw_label").alias("label"))


@query("assign_ids", """select e.event_id + 1 as ord, case when event_type = 'error' or user_id % 9 = 0 then 'mol_' || (event_id + 1)
  else 'U' || user_id end as molecule_id from events e""")
def assign_ids(spark, sf):
    e = B.table(spark, sf, "events")
    given = F.when(F.col("event_type") == "error", None).when(F.col("user_id") % 9 == 0, "").otherwise(
        F.concat(F.lit("U"), F.col("user_id").cast("string")))
    ord_ = F.col("event_id") + 1
    return e.select(ord_.alias("ord"), K.candidate_id(given, ord_).alias("molecule_id"))


@query("assign_ordinals", P + " select ord + 1 as ord, molecule_id from raw_p")
def assign_ordinals(spark, sf):
    """Ordinals of rows in files, from the file order itself."""
    path = B.scratch(spark, "ordinals")
    B.parts(spark, sf).select("ord", "molecule_id").orderBy("ord").drop("ord").write.csv(path, header=True)
    raw = spark.read.option("header", True).csv(path)
    return with_ordinals(raw, ["molecule_id"])


@query("validity", D_SQL + """ select ord, length(coalesce(text, '')) as n_input, md5(key) as key_digest, key is not null as valid_molecule,
  case when key is null then 'SMILES is empty.' end as error from docs""")
def validity(spark, sf):
    return B.document_rows(spark, sf).select("ord", K.validity("smiles").alias("v")).select(
        "ord", F.length("v.input_smiles").cast("bigint").alias("n_input"),
        F.md5(F.col("v.canonical_smiles").cast("binary")).alias("key_digest"), "v.valid_molecule", "v.error")


@query("identity_key", D_SQL + " select key, count(*) as copies from docs group by key")
def identity_key(spark, sf):
    return B.document_rows(spark, sf).groupBy("key").agg(F.count("*").alias("copies"))


@query("lookup_key", "select c_custkey, sha256(c_name) as digest from customer")
def lookup_key(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", K.lookup_key("c_name").alias("digest"))


@query("row_label", """select event_id, coalesce(nullif(case when event_type = 'view' then '' else event_type end, ''),
  nullif(case when user_id % 2 = 0 then cast(user_id as varchar) end, ''), 'e' || event_id) as label from events""")
def row_label(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", K.row_label(
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")),
        F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("label"))


@query("feature_set", D_SQL + r""", w as (select ord, key, string_split(key, ' ') as words from docs where key is not null),
sh as (select ord, unnest(case when len(words) < 3 then [key]
   else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) end) as s from w),
b as (select distinct ord, ('0x' || substr(md5(s), 1, 8))::bigint % 2048 as bit from sh)
select ord, count(*) as n_bits, min(bit) as low, max(bit) as high, sum(bit)::bigint as total from b group by ord""")
def feature_set(spark, sf):
    """Fixed-width feature bits of whole texts."""
    d = B.document_rows(spark, sf).where(F.col("key").isNotNull()).select("ord", K.feature_set("key").alias("bits"))
    b = d.select("ord", F.explode_outer("bits").alias("bit"))
    return b.groupBy("ord").agg(F.count("*").alias("n_bits"), F.min("bit").cast("bigint").alias("low"),
                                F.max("bit").cast("bigint").alias("high"), F.sum("bit").alias("total"))


@query("title_label", "select distinct replace(lower(o_orderpriority), ' ', '_') || '_' || 'dNA_x' as raw, array_to_string(list_transform(list_filter(string_split(replace(lower(o_orderpriority), ' ', '_') || '_' || 'dNA_x', '_'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') as label from orders")
def title(spark, sf):
    raw = F.concat(F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("_")), F.lit("_dNA_x"))
    return B.table(spark, sf, "orders").select(raw.alias("raw")).distinct().withColumn("label", X.title_label("raw"))


@query("safe_filename", r"""select url, coalesce(nullif(substring(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'compound') as file_name from pages""")
def filename(spark, sf):
    return B.table(spark, sf, "pages").select("url", X.safe_filename("url").alias("file_name"))


@query("csv_cell", """select conv_id, turn, md5('"' || replace(replace(coalesce(text, ''), '"', '""'), chr(10), ' ') || '"') as digest from conversations""")
def cell(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.csv_cell("text").cast("binary")).alias("digest"))


@query("report_line", P + """ select molecule_id, '- **Valid:** ' || case when valid_molecule then 'True' else 'False' end as valid_line,
  '- **Score:** ' || coalesce(docking_score::varchar, 'Not available') as score_line,
  '- **Input:** ' || coalesce(nullif(smiles, ''), 'Not available') as input_line from cand_p""")
def report_line(spark, sf):
    p = B.parts(spark, sf).select("molecule_id", "valid_molecule", "smiles", S.parse_docking("docking_score")["docking_score"].alias("d"))
    t = {f.name: f.dataType for f in p.schema.fields}
    return p.select("molecule_id", X.md_line("Valid", "valid_molecule", t["valid_molecule"]).alias("valid_line"),
                    X.md_line("Score", "d", t["d"]).alias("score_line"), X.md_line("Input", "smiles").alias("input_line"))


@query("clean_annotation", B.with_sql("ann") + " select job_id, annotation_key, review_status, review_note from ann")
def clean_annotation(spark, sf):
    return clean_annotations(B.annotations(spark, sf))


@query("coerce_values", """select event_id, lower(props) like '%1%' as is_t, lower(props) not like '%1%' as is_f,
  case when event_type = 'error' then null when event_type = 'view' then null else cast(value as double) end as num from events""")
def coerce_values(spark, sf):
    e = B.table(spark, sf, "events")
    has = F.col("props").contains("1")
    flag = F.when(has, F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("1")).otherwise("False")
    num = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", " ").otherwise(
        F.col("value").cast("string"))
    return e.select("event_id", N.is_true(flag).alias("is_t"), N.is_false(flag).alias("is_f"), N.to_number(num).alias("num"))


@query("signed_text", """select event_id, case when event_type = 'error' then 'Not available' else
  case when value - 50 > 0 then '+' else '' end || printf('%.3f', cast(round(cast(value - 50 as decimal(28,9)), 3) as double)) end as change from events""")
def signed(spark, sf):
    v = F.when(F.col("event_type") != "error", F.col("value") - 50)
    return B.table(spark, sf, "events").select("event_id", N.signed_text(v).alias("change"))


@query("flag_labels", """select doc_id, case when quality = 1 then 'Yes' else 'No' end as yes_no,
  case when toxic = 1 then 'Pass' else 'Fail' end as pass_fail from labels""")
def flag_labels(spark, sf):
    lab = B.table(spark, sf, "labels")
    return lab.select("doc_id", L.yes_no((F.col("quality") == 1).cast("string")).alias("yes_no"),
                      L.pass_fail(F.col("toxic") == 1).alias("pass_fail"))


@query("round_decimal", f"select l_orderkey, l_linenumber, {B.dp('l_extendedprice * l_discount / 7', 3)} as r from lineitem")
def round_decimal(spark, sf):
    return B.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", N.round_dp(F.col("l_extendedprice") * F.col("l_discount") / 7, 3).alias("r"))


@query("utc_seconds", "select count(*) as rows, true as whole_second, true as iso from events")
def utc_seconds(spark, sf):
    now = N.utc_seconds()
    return B.table(spark, sf, "events").agg(
        F.count("*").alias("rows"), (F.max(F.date_format(now, "SSS")) == "000").alias("whole_second"),
        F.max(N.iso_text(now)).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$").alias("iso"))


@query("preview", P + " select molecule_id, priority_score from scored_p where valid_molecule order by priority_score desc, ord limit 5")
def first_rows(spark, sf):
    rows = D.evidence_filter(scored_parts(spark, sf), {"valid_molecule": "valid"})
    return ranked(rows).limit(V.PREVIEW_LIMIT).select("molecule_id", "priority_score")


@query("evidence_filter", P + """ select molecule_id, priority_score, bbb_prediction from scored_p
  where bbb_prediction = 'high' and priority_score >= 0.6 and valid_molecule""")
def evidence_filter(spark, sf):
    return D.evidence_filter(scored_parts(spark, sf), {
        "bbb_prediction": "high", "priority_score_min": "0.6", "valid_molecule": "valid", "review_status": "",
    }).select("molecule_id", "priority_score", "bbb_prediction")


@query("filter_invalid", P + " select molecule_id from scored_p where not valid_molecule")
def filter_invalid(spark, sf):
    return D.evidence_filter(scored_parts(spark, sf), {"valid_molecule": "invalid"}).select("molecule_id")


@query("filter_options", "select o_orderpriority as value, o_orderpriority as label from orders group by 1")
def filter_options(spark, sf):
    return D.filter_options(B.table(spark, sf, "orders"), "o_orderpriority")


@query("keyed_reference", D_SQL + " select md5(key) as k, name, source, compound_id, position from ref")
def keyed_reference(spark, sf):
    r = B.reference_documents(spark, sf)
    return keyed(r).select(F.md5(F.col("key").cast("binary")).alias("k"), "name", "source", "compound_id", "position")


@query("identity_join", D_SQL + """ select c.ord, r.key is not null as known_compound_match, r.name as known_compound_name,
  r.source as known_compound_source, r.compound_id as known_compound_id,
  case when not c.valid_molecule then 'not_run_invalid_molecule' when r.key is null then 'no_exact_match' else 'exact_match' end as identity_check_status
from cand_d c left join ref r on c.canonical_smiles = r.key""")
def identity(spark, sf):
    joined = identity_join(B.candidate_documents(spark, sf), keyed(B.reference_documents(spark, sf)))
    return joined.select("ord", *V.KNOWN_COLUMNS)


@query("stage_defaults", P + """ select molecule_id, valid_molecule, 'not_run' as identity_check_status, 'not_run' as similarity_check_status,
  'not_requested' as pubchem_lookup_status, 'not_requested' as chembl_lookup_status, 'not_requested' as patent_lookup_status,
  case when valid_molecule then 'Model is not available.' else 'BBB prediction skipped for invalid molecule.' end as bbb_warning,
  case when valid_molecule then 'limited_public_context' else 'invalid_molecule' end as evidence_summary_category,
  case when valid_molecule then 'Public identity lookup was not requested. ChEMBL public bioactivity lookup was not requested. SureChEMBL patent-context lookup was not requested.'
       else 'Invalid molecule: evidence synthesis was not run for this row.' end as evidence_summary_notes,
  docking_status, case when valid_molecule then mw end as mw, case when valid_molecule then lipinski_violations end as lipinski_violations, lipinski_pass
from scored_p""")
def stage_defaults(spark, sf):
    """The whole record when every optional stage is off."""
    out = prioritise(B.parts(spark, sf), diversity=False)
    return out.select("molecule_id", "valid_molecule", "identity_check_status", "similarity_check_status",
                      "pubchem_lookup_status", "chembl_lookup_status", "patent_lookup_status", "bbb_warning",
                      "evidence_summary_category", "evidence_summary_notes", "docking_status", "mw",
                      "lipinski_violations", "lipinski_pass")


