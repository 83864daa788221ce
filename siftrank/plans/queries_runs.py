"""Queries of runs, comparison, review and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions import keys as K
from siftrank.functions import labels as L
from siftrank.functions.evidence import with_evidence
from siftrank.functions.text import values_differ
from siftrank.operators import compare as C
from siftrank.operators import filters as D
from siftrank.operators import history as H
from siftrank.operators import review as R
from siftrank.operators.joins import dense_positions, rank_positions
from siftrank.operators.summaries import SOURCES
from siftrank.plans import bindings as B
from siftrank.plans.queries_lookup import EVID, STATUS_JOBS, evidence_rows, status_jobs, status_sql
from siftrank.plans.queries_rows import scored_parts
from siftrank.plans.registry import query
from siftrank.session import durable
from siftrank.sources import readers as A
from siftrank.sources import writers as W
from siftrank.sources.run_manifest import RunManifest, run_records

RUNS = B.with_sql("runs")
DONE = RUNS + ", done as (select * from runs where status = 'completed')"
HISTORY = """job_id, created_at, completed_at, status, input_file, output_file, row_count,
  pubchem_lookup_requested or coalesce(chembl_lookup_requested, false) or patent_lookup_requested as public_lookup_requested,
  pubchem_lookup_requested, coalesce(chembl_lookup_requested, false) as chembl_lookup_requested, patent_lookup_requested"""
CMP = "with " + B.run_cte("a", B.EARLY) + "," + B.run_cte("b", B.LATE)
ONE_RUN = "with " + B.run_cte("a", B.WHOLE)


def _key(side: str) -> str:
    return f"""{side}k as (select *, case when trim(molecule_id) <> '' then 'molecule:' || trim(molecule_id)
  when canonical_smiles is not null then 'canonical:' || canonical_smiles else 'input:' || input_smiles end as key from {side}),
{side}d as (select * from {side}k qualify row_number() over (partition by key order by rank_position) = 1)"""


COMPARED = CMP + "," + _key("a") + "," + _key("b") + f""",
cmp as (select coalesce(x.key, y.key) as comparison_key, coalesce(x.molecule_id, y.molecule_id) as molecule_id,
  case when x.key is not null and y.key is not null then 'both' when x.key is not null then 'only_in_run_a' else 'only_in_run_b' end as presence,
  x.priority_score as priority_score_a, y.priority_score as priority_score_b, {B.dp("y.priority_score - x.priority_score", 6)} as priority_score_change,
  x.evidence_summary_category as evidence_summary_category_a, y.evidence_summary_category as evidence_summary_category_b,
  x.bbb_prediction as bbb_prediction_a, y.bbb_prediction as bbb_prediction_b, x.bbb_probability as bbb_probability_a, y.bbb_probability as bbb_probability_b,
  x.canonical_smiles as canonical_smiles_a, y.canonical_smiles as canonical_smiles_b,
  coalesce(x.evidence_summary_category <> y.evidence_summary_category, false) as changed_evidence, false as changed_review_status,
  coalesce(x.public_identity_signal <> y.public_identity_signal or x.public_bioactivity_signal <> y.public_bioactivity_signal
    or x.patent_context_signal <> y.patent_context_signal, false) as changed_public_signals,
  coalesce(x.bbb_prediction <> y.bbb_prediction, false) as changed_bbb_prediction,
  case when x.key is not null then coalesce(nullif(trim(x.molecule_id), ''), x.canonical_smiles, '') else coalesce(nullif(trim(y.molecule_id), ''), y.canonical_smiles, '') end as sort_label
from ad x full join bd y on x.key = y.key)"""
CMP_NAMES = ["comparison_key", "molecule_id", "presence", "priority_score_a", "priority_score_b", "priority_score_change",
             "evidence_summary_category_a", "evidence_summary_category_b", "bbb_prediction_a", "bbb_prediction_b",
             "bbb_probability_a", "bbb_probability_b", "canonical_smiles_a", "canonical_smiles_b", *V.CHANGE_FLAGS, "sort_label"]


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_runs(B.customer_run(spark, sf, B.EARLY), B.customer_run(spark, sf, B.LATE))


# ---- runs -----------------------------------------------------------------------


@query("history_view", RUNS + f" select {HISTORY} from runs")
def history_view(spark, sf):
    return H.history_view(B.day_runs(spark, sf))


@query("completed_runs", DONE + " select job_id, completed_at from done")
def completed(spark, sf):
    return D.completed_runs(B.day_runs(spark, sf)).select("job_id", "completed_at")


@query("run_history", DONE + f" select {HISTORY} from done order by completed_at desc, job_id limit 25")
def run_history(spark, sf):
    return H.run_history(B.day_runs(spark, sf))


@query("latest_run", DONE + " select job_id, row_count from done order by completed_at desc, job_id limit 1")
def latest_run(spark, sf):
    return H.latest_run(B.day_runs(spark, sf)).select("job_id", "row_count")


@query("latest_rows", DONE + """, l as (select job_id from done order by completed_at desc, job_id limit 1)
select event_id, event_type from events join l on strftime(ts, '%Y-%m-%d') = l.job_id""")
def latest_rows(spark, sf):
    """Rows of the newest run from a table partitioned by run."""
    path = B.scratch(spark, "results")
    ev = B.table(spark, sf, "events").withColumn("job_id", F.date_format("ts", "yyyy-MM-dd"))
    ev.select("event_id", "event_type", "job_id").repartition("job_id").write.partitionBy("job_id").parquet(path)
    stored = spark.read.schema("event_id bigint, event_type string, job_id string").parquet(path)
    return H.latest_rows(B.day_runs(spark, sf), stored).select("event_id", "event_type")


@query("merge_history", DONE + f""", h as (select {HISTORY} from done), r as (select {HISTORY} from runs order by job_id desc limit 1)
select job_id, status from h where job_id not in (select job_id from r) union all select job_id, status from r""")
def merge_history(spark, sf):
    runs = B.day_runs(spark, sf)
    newest = runs.orderBy(F.desc("job_id")).limit(1)
    return H.merge_history(H.history_view(D.completed_runs(runs)), newest).select("job_id", "status")


@query("lookup_sources", RUNS + """ select job_id, coalesce(nullif(concat_ws(', ', case when pubchem_lookup_requested then 'PubChem' end,
  case when chembl_lookup_requested then 'ChEMBL' end, case when patent_lookup_requested then 'SureChEMBL' end), ''), 'None requested') as sources,
  job_id || ' | ' || completed_at || ' | ' || row_count || ' rows' as label from runs""")
def lookup_sources(spark, sf):
    return B.day_runs(spark, sf).select("job_id", L.lookup_sources().alias("sources"),
                                        L.run_label("job_id", "completed_at", "row_count").alias("label"))


@query("known_jobs", RUNS + """ select strftime(ts, '%Y-%m-%d') as job_id, count(*) as requests from events where event_type <> 'view' group by 1""")
def known_jobs(spark, sf):
    """Requested ids: unsafe names and unknown runs are dropped."""
    ev = B.table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    kind = F.col("event_id") % 2
    asked = ev.select(F.when((F.col("event_type") == "view") & (kind == 0), F.concat(F.lit("../"), day))
                      .when(F.col("event_type") == "view", F.lit("unknown")).otherwise(day).alias("job_id"))
    return D.known_jobs(asked, B.day_runs(spark, sf)).groupBy("job_id").agg(F.count("*").alias("requests"))


@query("run_files", RUNS + " select job_id, status, row_count, completed_at, pubchem_lookup_requested from runs where day(strptime(job_id, '%Y-%m-%d')) % 6 <> 0")
def run_files(spark, sf):
    """Run metadata as JSON files; malformed files are skipped."""
    path = B.scratch(spark, "runs")
    runs = B.day_runs(spark, sf).drop("public_lookup_requested")
    broken = F.dayofmonth(F.to_date("job_id")) % 6 == 0
    text = F.to_json(F.struct(*runs.columns))
    files = runs.select(F.when(broken, F.substring(text, 1, 20)).otherwise(text).alias("value"), "job_id")
    files.repartition("job_id").write.partitionBy("job_id").text(path)
    read = A.read_runs(spark, f"{path}/*/*.txt")
    return read.select("job_id", "status", "row_count", "completed_at", "pubchem_lookup_requested")


@query("run_states", RUNS + """ select job_id, case when status = 'failed' then 'failed' else 'completed' end as status,
  case when status = 'failed' then 0 else row_count end as row_count from runs""")
def run_states(spark, sf):
    """States appended over time; the latest per run counts."""
    path = B.scratch(spark, "states")
    runs = B.day_runs(spark, sf)
    at = F.to_timestamp("created_at")
    started = runs.select("job_id", F.lit("running").alias("status"), F.lit(0).cast("bigint").alias("row_count"), at.alias("updated_at"))
    ended = runs.select("job_id", "status", F.when(F.col("status") == "failed", 0).otherwise(F.col("row_count")).cast("bigint").alias("row_count"),
                        (at + F.expr("interval 1 hour")).alias("updated_at"))
    W.upsert_run(started, path)
    W.upsert_run(ended, path)
    return A.latest_runs(spark.read.parquet(path))


@query("run_manifest", RUNS + " select job_id, row_count, status = 'failed' as fallback_placeholder_used, output_file from runs where status = 'completed' or row_count > 0")
def run_manifest(spark, sf):
    """Nested run maps, one map per week, exploded to rows."""
    runs = B.day_runs(spark, sf)
    entry = F.struct(F.col("row_count"), (F.col("status") == "failed").alias("fallback_placeholder_used"), "output_file")
    week = runs.groupBy(F.weekofyear(F.to_date("job_id")).alias("w")).agg(
        F.map_from_entries(F.collect_list(F.struct("job_id", entry.alias("run")))).alias("runs"))
    raw = week.select(F.to_json(F.struct("runs")).alias("payload"))
    broken = week.limit(1).select(F.lit("{bad").alias("payload"))
    return A.read_run_manifest(raw.unionByName(broken)).select(
        "job_id", "row_count", "fallback_placeholder_used", "output_file")


MANIFEST = STATUS_JOBS + """ select job_id, case when bool_or(bbb_model_status = 'model_available') then 'model_available' else 'model_unavailable' end as actual_bbb_model_status,
  string_agg(distinct bbb_model_status, '; ' order by bbb_model_status) as bbb_model_status_values,
  bool_or(bbb_model_status <> 'model_available') as fallback_placeholder_used,
  bool_or(pubchem_lookup_status <> 'not_requested' or chembl_lookup_status <> 'not_requested' or patent_lookup_status <> 'not_requested') as public_lookup_requested,
  string_agg(distinct pubchem_lookup_status, '; ' order by pubchem_lookup_status) as pubchem_lookup_status_values,
  string_agg(distinct chembl_lookup_status, '; ' order by chembl_lookup_status) as chembl_lookup_status_values,
  string_agg(distinct patent_lookup_status, '; ' order by patent_lookup_status) as patent_lookup_status_values, count(*) as row_count,
  'results/job_id=' || job_id as output_file, true as has_time, job_id = 'run3' as latest_run, """ + ", ".join(
    f"{status_sql(s)[0]} as {s}_status, {status_sql(s)[1]} as {s}_has_success, {status_sql(s)[2]} as {s}_error_message" for s in SOURCES) + " from j group by job_id"


@query("run_summary_table", MANIFEST)
def run_summary_table(spark, sf):
    """Records of four runs committed to the manifest, the first two again with all their rows, and read back."""
    manifest = RunManifest(spark, B.scratch(spark, "manifest"))
    records = durable(run_records(status_jobs(spark, sf), "results"))
    manifest.commit(records.where("job_id < 'run2'").withColumn("row_count", F.lit(0).cast("bigint")))
    for job in ("run0", "run1", "run2", "run3"):
        manifest.commit(records.where(F.col("job_id") == job))
    out = manifest.runs().withColumn("has_time", F.col("timestamp").isNotNull())
    for source in SOURCES:
        out = out.withColumn(f"{source}_has_success", F.col(f"{source}_last_successful_lookup") != "").drop(f"{source}_last_successful_lookup")
    return out.drop("timestamp", "number")


# ---- comparison -----------------------------------------------------------------


@query("compare_runs", COMPARED + " select " + ", ".join(CMP_NAMES) + " from cmp")
def compare_runs(spark, sf):
    return comparison(spark, sf).select(*CMP_NAMES)


@query("comparison_summary", COMPARED + """ select count(*) as total_rows, count(*) filter (presence = 'both') as shared,
  count(*) filter (presence = 'only_in_run_a') as only_in_run_a, count(*) filter (presence = 'only_in_run_b') as only_in_run_b,
  count(*) filter (changed_evidence) as changed_evidence, count(*) filter (changed_review_status) as changed_review_status,
  count(*) filter (changed_public_signals) as changed_public_signals, count(*) filter (changed_bbb_prediction) as changed_bbb_prediction from cmp""")
def comparison_summary(spark, sf):
    return C.comparison_summary(comparison(spark, sf))


@query("largest_changes", COMPARED + """ select comparison_key, priority_score_change from cmp where presence = 'both' and priority_score_change is not null
  order by abs(priority_score_change) desc, sort_label, comparison_key limit 5""")
def largest_changes(spark, sf):
    return C.largest_changes(comparison(spark, sf)).select("comparison_key", "priority_score_change")


@query("comparison_order", COMPARED + " select comparison_key, row_number() over (order by sort_label, comparison_key) - 1 as place from cmp")
def comparison_order(spark, sf):
    """Place of every row in the output order."""
    rows = comparison(spark, sf).select("comparison_key", "sort_label")
    return dense_positions(rows, [F.col("sort_label"), F.col("comparison_key")], "place").select("comparison_key", "place")


@query("comparison_export", COMPARED + """ select presence, molecule_id, changed_evidence, priority_score_change, null::varchar as review_note_a from cmp""")
def comparison_export(spark, sf):
    out = W.export_columns(comparison(spark, sf), V.COMPARISON_COLUMNS)
    return out.select("presence", "molecule_id", "changed_evidence", "priority_score_change", "review_note_a")


@query("comparison_key", ONE_RUN + "," + _key("a") + " select rank_position, key as comparison_key from ak")
def comparison_key(spark, sf):
    return C.with_comparison_key(B.customer_run(spark, sf, B.WHOLE)).select("rank_position", "comparison_key")


@query("dedupe_first", ONE_RUN + "," + _key("a") + " select key as comparison_key, rank_position, priority_score from ad")
def dedupe_first(spark, sf):
    rows = C.with_comparison_key(B.customer_run(spark, sf, B.WHOLE)).select("comparison_key", "rank_position", "priority_score")
    return C.dedupe_first(rows, "comparison_key", "rank_position")


@query("model_labels", COMPARED + """ select comparison_key, coalesce(bbb_prediction_a || ' (' || bbb_probability_a::varchar || ')', 'Not available') as a,
  coalesce(bbb_prediction_b || ' (' || bbb_probability_b::varchar || ')', 'Not available') as b from cmp""")
def model_labels(spark, sf):
    return comparison(spark, sf).select("comparison_key", L.model_label("a").alias("a"), L.model_label("b").alias("b"))


@query("values_differ", """select o_orderkey, trim(o_orderpriority) <> '5-LOW' as differs, false as blank_differs from orders""")
def differ(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.select("o_orderkey", values_differ(F.concat(F.lit("  "), "o_orderpriority"), F.lit("5-LOW ")).alias("differs"),
                    values_differ(F.lit(None).cast("string"), F.lit(" ")).alias("blank_differs"))


@query("key_union", CMP + " select distinct molecule_id from (select molecule_id from a union all select molecule_id from b)")
def key_union(spark, sf):
    return C.key_union(B.customer_run(spark, sf, B.EARLY), B.customer_run(spark, sf, B.LATE), "molecule_id")


@query("key_classes", CMP + """, s as (select molecule_id, bool_or(x = 1) as l, bool_or(x = 2) as r from
  (select molecule_id, 1 as x from a union all select molecule_id, 2 from b) group by 1)
select molecule_id, case when l and r then 'both' when l then 'only_in_run_a' else 'only_in_run_b' end as presence from s""")
def key_classes(spark, sf):
    return C.key_classes(B.customer_run(spark, sf, B.EARLY), B.customer_run(spark, sf, B.LATE), "molecule_id")


# ---- review ---------------------------------------------------------------------

REVIEWED = B.with_sql("docs", "ann") + """,
res as (select 'job' || (d.ord % 4) as job_id, case when d.ord % 9 = 0 then ' ' else molecule_id end as molecule_id, d.ord as rank_position from docs d),
rev as (select res.job_id, res.molecule_id, rank_position, coalesce(nullif(trim(molecule_id), ''), 'row_' || rank_position) as review_annotation_key,
  coalesce(nullif(ann.review_status, ''), 'unreviewed') as review_status, coalesce(ann.review_note, '') as review_note
  from res left join ann on ann.job_id = res.job_id and ann.annotation_key = coalesce(nullif(trim(molecule_id), ''), 'row_' || rank_position))"""


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents")
    k = F.col("doc_id")
    rows = d.select(F.concat(F.lit("job"), (k % 4).cast("string")).alias("job_id"),
                    F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("D"), k.cast("string"))).alias("molecule_id"),
                    k.alias("rank_position"))
    return R.with_review(rows, A.clean_annotations(B.annotations(spark, sf)))


@query("with_review", REVIEWED + " select * from rev")
def with_review(spark, sf):
    return reviewed(spark, sf)


@query("with_status_in", REVIEWED + " select molecule_id, rank_position, review_status from rev where review_status in ('selected', 'watchlist', 'unreviewed')")
def with_status_in(spark, sf):
    return D.with_status_in(reviewed(spark, sf), ["selected", "watchlist", "unreviewed"]).select(
        "molecule_id", "rank_position", "review_status")


@query("review_counts", REVIEWED + """, st as (select * from (values (0, 'unreviewed', 'Unreviewed'), (1, 'selected', 'Selected'), (2, 'watchlist', 'Watchlist'),
  (3, 'deprioritized', 'Deprioritized'), (4, 'rejected', 'Rejected')) t(position, review_status, label))
select position, st.review_status, label, count(rev.job_id) as rows from st left join rev using (review_status) group by 1, 2, 3""")
def review_counts(spark, sf):
    return R.review_counts(reviewed(spark, sf))


@query("review_text", REVIEWED + """ select 'Unreviewed: ' || count(*) filter (review_status = 'unreviewed') || ', Selected: ' || count(*) filter (review_status = 'selected')
 || ', Watchlist: ' || count(*) filter (review_status = 'watchlist') || ', Deprioritized: 0, Rejected: ' || count(*) filter (review_status = 'rejected') as review_summary from rev""")
def review_text(spark, sf):
    return R.review_text(reviewed(spark, sf))


@query("save_annotations", B.with_sql("ann") + """ select job_id, annotation_key, review_status from ann where job_id = 'job0'
 union all select job_id, annotation_key, review_status from ann where job_id = 'job1' and review_status = 'selected'""")
def save_annotations(spark, sf):
    """Saving a job replaces its whole set and leaves other jobs alone."""
    path = B.scratch(spark, "annotations")
    raw = B.annotations(spark, sf)
    W.save_annotations(spark, path, raw)
    W.save_annotations(spark, path, raw.where("job_id = 'job1' and review_status = 'SELECTED'"))
    return A.stored_annotations(spark, path).select("job_id", "annotation_key", "review_status")


@query("clear_annotations", B.with_sql("ann") + """ select job_id, annotation_key, review_status, review_note from ann where job_id <> 'job1'""")
def clear_annotations(spark, sf):
    """An empty set clears one job's stored annotations and leaves other jobs alone."""
    path = B.scratch(spark, "annotations")
    raw = B.annotations(spark, sf)
    W.save_annotations(spark, path, raw)
    W.save_annotations(spark, path, raw.limit(0), "job1")
    return A.stored_annotations(spark, path)


@query("read_annotations", B.with_sql("ann") + " select job_id, annotation_key, review_status, review_note from ann")
def read_annotations(spark, sf):
    """JSON maps of annotations, some jobs malformed, back to clean rows."""
    raw = B.annotations(spark, sf).withColumn("part", F.pmod(F.xxhash64("annotation_key"), F.lit(64)))
    maps = raw.groupBy("job_id", "part").agg(F.map_from_entries(F.collect_list(F.struct(
        "annotation_key", F.struct("review_status", "review_note").alias("v")))).alias("annotations"))
    payload = maps.select("job_id", F.to_json(F.struct("annotations")).alias("payload"))
    broken = payload.limit(1).select(F.lit("job9").alias("job_id"), F.lit("[").alias("payload"))
    return A.read_annotations(payload.unionByName(broken))


@query("merge_annotations", B.with_sql("ann") + """, ch as (select job_id, annotation_key, case when substring(annotation_key, 2)::bigint % 6 = 0 then 'deprioritized' else 'selected' end as review_status, 'changed' as review_note
  from ann where substring(annotation_key, 2)::bigint % 3 = 0)
select * from ch union all select * from ann where substring(annotation_key, 2)::bigint % 3 <> 0""")
def merge_annotations(spark, sf):
    """Changed keys replace stored ones, the last change of a key wins."""
    raw = B.annotations(spark, sf)
    path = B.scratch(spark, "annotations")
    W.save_annotations(spark, path, raw)
    number = F.substring(F.trim("annotation_key"), 2, 20).cast("bigint")
    base = raw.where(number % 3 == 0).select("job_id", "annotation_key", number.alias("k"))
    first = base.select("job_id", "annotation_key", F.lit("rejected").alias("review_status"), F.lit("old").alias("review_note"), F.lit(1).alias("change_no"))
    last = base.select("job_id", "annotation_key", F.when(F.col("k") % 6 == 0, "deprioritized").otherwise("selected").alias("review_status"),
                       F.lit(" changed").alias("review_note"), F.lit(2).alias("change_no"))
    W.merge_annotations(spark, path, first.unionByName(last))
    return A.stored_annotations(spark, path)


@query("annotation_key", REVIEWED + " select rank_position, review_annotation_key from rev")
def annotation_key(spark, sf):
    k = F.col("doc_id")
    return B.table(spark, sf, "documents").select(k.alias("rank_position"), K.annotation_key(
        F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("D"), k.cast("string"))), k).alias("review_annotation_key"))


# ---- stored candidates and results ------------------------------------------------


@query("read_candidates", B.with_sql("cand_p") + """ select ord + 1 as ord, molecule_id, nullif(replace(smiles, ' ', chr(10)), '') as smiles, nullif(docking_text, '') as docking_score from raw_p""")
def read_candidates(spark, sf):
    """CSV with quoted line breaks, an extra column and a byte-order mark; order and ids survive."""
    path = B.scratch(spark, "csv")
    p = B.parts(spark, sf).orderBy("ord")
    p.select("molecule_id", F.replace("smiles", F.lit(" "), F.lit("\n")).alias("smiles"), "docking_score", "mw").write.csv(
        path, header=True, quoteAll=True, escape='"', nullValue="", emptyValue="")
    return A.read_candidates(spark, path).select("ord", "molecule_id", "smiles", "docking_score")


@query("validate_columns", "select count(*) as rows, 'CSV is missing required columns: molecule_id, smiles.' as message from part")
def validate_columns(spark, sf):
    p = B.table(spark, sf, "part")
    try:
        A.validate_columns(p)
        message = ""
    except ValueError as exc:
        message = str(exc)
    return p.agg(F.count("*").alias("rows")).withColumn("message", F.lit(message))


@query("write_ranked", B.with_sql("cand_p") + """ select 'run' || (ord % 2) as job_id, molecule_id, priority_score,
  row_number() over (partition by ord % 2 order by priority_score desc, ord) - 1 as rank_position, 83 as n_columns from scored_p""")
def write_ranked(spark, sf):
    """Runs stored by run id, each in place of its earlier rows: one replaced by others, one by none."""
    path = B.scratch(spark, "ranked")
    rows = scored_parts(spark, sf)
    W.write_ranked(rank_positions(rows.limit(0)), path, "empty")
    W.write_ranked(rank_positions(rows), path, "run1")
    W.write_ranked(rank_positions(rows), path, "cleared")
    W.write_ranked(rank_positions(rows.limit(0)), path, "cleared")
    for i in (0, 1):
        W.write_ranked(rank_positions(rows.where(F.col("ord") % 2 == i)), path, f"run{i}")
    stored = A.stored_results(spark, path)
    width = len(stored.columns) - 1
    return stored.select("job_id", "molecule_id", "priority_score", "rank_position", F.lit(width).alias("n_columns"))


@query("read_result", B.with_sql("cand_p") + " select molecule_id, priority_score from scored_p")
def read_result(spark, sf):
    path = B.scratch(spark, "result")
    W.write_ranked(rank_positions(scored_parts(spark, sf).where(F.col("ord") % 2 == 0)), path, "r1")
    W.write_ranked(rank_positions(scored_parts(spark, sf)), path, "r0")
    return A.read_result(spark, path, "r0").select("molecule_id", "priority_score")


@query("export_rows", """select p_partkey as key, p_name as name, null::varchar as phone, null::bigint as balance from part
 union all select s_suppkey, s_name, 'ph' || s_suppkey, s_nationkey from supplier""")
def export_rows(spark, sf):
    """Union of rows under the union of their columns, through CSV."""
    path = B.scratch(spark, "export")
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    s = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.concat(F.lit("ph"), F.col("s_suppkey").cast("string")).alias("phone"),
        F.col("s_nationkey").cast("bigint").alias("balance"))
    W.write_csv(W.export_rows([p, s]), path)
    return spark.read.schema("key bigint, name string, phone string, balance bigint").option("header", True).option("escape", '"').csv(path)


@query("package_columns", EVID + " select molecule_id, null::varchar as bbb_model_name, null::varchar as logp, priority_score, 80 as width from ev where k % 4 < 2")
def package_columns(spark, sf):
    """Fixed column list; columns no stage produces are blank."""
    rows = D.with_status_in(evidence_rows(spark, sf), ["selected", "watchlist"])
    out = W.export_columns(rows, V.PACKAGE_COLUMNS)
    return out.select("molecule_id", "bbb_model_name", "logp", "priority_score", F.lit(len(out.columns)).alias("width"))


@query("csv_lines", """select '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || c_acctbal::varchar || '"' as line from customer""")
def csv_lines(spark, sf):
    return W.csv_lines(B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))


# Properties of the export that the evidence rows have, with their SQL text.
FLAGS = ("valid_molecule", "known_compound_match", "patent_public_evidence_match", "diversity_representative")
PROPERTIES = [
    "molecule_id", "priority_score", "valid_molecule", "bbb_model_status", "synthetic_feasibility_category", "known_compound_match",
    "known_compound_name", "closest_known_compound_name", "closest_known_compound_similarity", "pubchem_cid", "pubchem_preferred_name",
    "chembl_molecule_id", "chembl_activity_count", "patent_public_evidence_match", "patent_record_count", "evidence_summary_category",
    "biopharma_context_level", "diversity_cluster_id", "diversity_cluster_size", "diversity_representative", "nearest_neighbor_molecule_id",
    "nearest_neighbor_similarity", "diversity_status", "chemical_space_status", "review_status"]


def property_sql(name: str) -> str:
    if name == "review_status":  # blank in these rows
        return "nullif(review_status, 'unreviewed')"
    return f"case when {name} then 'True' when not {name} then 'False' end" if name in FLAGS else f"{name}::varchar"


@query("candidate_properties", EVID + ", u as (select molecule_id, unnest([{'p': 'source_smiles', 'v': molecule_id}, " + ", ".join(
    f"{{'p': '{n}', 'v': {property_sql(n)}}}" for n in PROPERTIES) + """]) as e from evid where coalesce(valid_molecule, false))
select molecule_id as record_id, e.p as property, e.v as value from u where coalesce(e.v, '') <> ''""")
def candidate_properties(spark, sf):
    """Long property table of exportable rows, with every exported property that the rows have."""
    rows = with_evidence(evidence_rows(spark, sf)).select(
        *PROPERTIES, F.col("molecule_id").alias("canonical_smiles"), F.lit("").alias("input_smiles"))
    return W.candidate_properties(rows)


@query("export_counts", EVID + " select count(*) filter (coalesce(valid_molecule, false)) as exported, count(*) filter (not coalesce(valid_molecule, false)) as skipped from ev")
def export_counts(spark, sf):
    rows = evidence_rows(spark, sf).select(
        "molecule_id", F.col("molecule_id").alias("canonical_smiles"), F.lit("").alias("input_smiles"), "valid_molecule")
    return W.export_counts(rows)
