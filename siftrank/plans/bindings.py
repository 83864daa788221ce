"""How the test tables stand in for candidates, references, lookups and runs.

Every binding is given twice: as a DataFrame and as the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions.keys import hashed_features, identity_key, validity, word_shingles
from siftrank.functions.numbers import round_dp
from siftrank.functions.scoring import normalize_label
from siftrank.session import durable, scratch_path, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LABEL_OF_TYPE = {"PROMO": "permeable", "SMALL": "non-permeable", "LARGE": "LABEL_1", "MEDIUM": "LABEL_0"}


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from ``part``; docking text from the largest ordered quantity."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.max("l_quantity").cast("int").alias("q")
    )
    k, size = F.col("p_partkey"), F.col("p_size")
    label = F.lit("other")
    for kind, text in LABEL_OF_TYPE.items():
        label = F.when(F.col("p_type") == kind, text).otherwise(label)
    docking = (
        F.when(k % 7 == 0, "").when(k % 7 == 1, "high affinity").when(F.col("q").isNull(), None)
        .otherwise(F.concat(F.lit("-"), F.col("q").cast("string"), F.lit("."), (k % 10).cast("string")))
    )
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", k.cast("string"))
    return part.join(lines, k == F.col("l_partkey"), "left").select(
        k.alias("ord"),
        F.concat(F.lit("P"), k.cast("string")).alias("molecule_id"),
        F.when(size > 1, text).otherwise("").alias("smiles"),
        docking.alias("docking_score"),
        (size * 15).cast("double").alias("mw"), (size * 4).cast("double").alias("tpsa"),
        (k % 15).cast("int").alias("hba"), (k % 8).cast("int").alias("hbd"),
        (size % 20).cast("int").alias("rotatable_bonds"), ((k % 1000) / 1000).alias("qed"),
        ((k % 70) / 10).alias("logp"),
        size.alias("heavy_atoms"), (k % 6).alias("rings"), (k % 3).alias("bridgeheads"),
        (k % 2).alias("spiro_atoms"), (k % 5).alias("chiral_centers"), (k % 9).alias("hetero_atoms"),
        label.alias("raw_label"), ((k % 97) / 97).alias("raw_probability"),
        (size > 1).alias("valid_molecule"),
    )


def modelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`parts` with model columns taken from the raw label and probability."""
    valid = F.col("valid_molecule")
    return parts(spark, sf_dir).withColumns({
        "bbb_prediction": F.when(valid, normalize_label("raw_label")).otherwise("unavailable"),
        "bbb_probability": F.when(valid, round_dp("raw_probability", 3)),
        "bbb_model_status": F.when(valid, "model_available").otherwise("not_run_invalid_molecule"),
    })


REFERENCE_SOURCES = ["src0", "src1", "src2", "src3", "src4"]


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as keyed rows."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("molecule_id"),
        F.col("text").alias("smiles"), "source", "lang", "n_chars", identity_key("text").alias("key"),
    )


def reference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rows(spark, sf_dir).where(F.col("source").isin(*REFERENCE_SOURCES)).select(
        "ord", "key", F.concat(F.lit("Doc "), F.col("ord").cast("string")).alias("name"), "source",
        F.concat(F.lit("REF"), F.col("ord").cast("string")).alias("compound_id"),
    )


def candidate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the reference sources with validity columns and shingle features."""
    rows = document_rows(spark, sf_dir).where(~F.col("source").isin(*REFERENCE_SOURCES))
    return validated(rows)


def validated(rows: DataFrame) -> DataFrame:
    rows = durable(rows)  # normalise every text once, whatever is derived from the key
    return rows.withColumn("_v", validity("smiles", F.col("key"))).select(
        "ord", "molecule_id", "source", "_v.*",
        ((F.col("ord") % 101) / 100).alias("_raw"),
    ).withColumn("priority_score", F.least(round_dp("_raw", 3), F.lit(1.0))).drop("_raw")


def with_features(rows: DataFrame, key: str = "canonical_smiles") -> DataFrame:
    return rows.withColumn("features", hashed_features(word_shingles(key)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-bit positions (sign bits) of ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    on = F.filter(
        F.transform("embedding", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull()
    )
    return e.select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("molecule_id"),
        "label", on.alias("features"),
    )


def day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per day of ``events``; it failed if more than a fifth of the events are errors."""
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    errors = F.count_if(F.col("event_type") == "error")
    day = F.dayofmonth("day")
    runs = ev.groupBy("day").agg(
        F.count("*").alias("row_count"), F.max("ts").alias("completed_at"), F.min("ts").alias("created_at"),
        F.when(errors * 5 > F.count("*"), "failed").otherwise("completed").alias("status"),
    )
    return runs.select(
        F.date_format("day", "yyyy-MM-dd").alias("job_id"), "status",
        F.concat(F.lit("in/"), F.date_format("day", "yyyy-MM-dd")).alias("input_file"),
        F.concat(F.lit("out/"), F.date_format("day", "yyyy-MM-dd")).alias("output_file"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"),
        "row_count", F.lit(None).cast("boolean").alias("public_lookup_requested"),
        (day % 2 == 0).alias("pubchem_lookup_requested"),
        F.when(day % 7 != 0, day % 3 == 0).alias("chembl_lookup_requested"),
        (day % 5 == 0).alias("patent_lookup_requested"),
    )


# The two runs of all orders that comparisons use, and all of them as one run.
EARLY, LATE, WHOLE = "o_orderdate < date '1993-01-01'", "o_orderdate >= date '1993-01-01'", "true"


def customer_run(spark: SparkSession, sf_dir: str, span: str) -> DataFrame:
    """A run of the orders in ``span``: a customer's orders as one result row."""
    o = table(spark, sf_dir, "orders").where(span)
    k = F.col("o_custkey")
    per_priority = o.groupBy(k, "o_orderpriority").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"),
        F.count_if(F.col("o_orderstatus") == "P").alias("p"),
    )
    rows = per_priority.groupBy("o_custkey").agg(
        (F.sum("total") / F.sum("n")).cast("double").alias("mean_price"),
        F.min_by("o_orderpriority", F.struct((-F.col("n")).alias("n"), "o_orderpriority")).alias("cat"),
        F.sum("f").alias("f"), F.sum("o").alias("o"), F.sum("p").alias("p"), F.sum("n").alias("n"),
    )

    def signal(name: str):
        return F.when(F.col(name) > 0, f"{name}_present").otherwise(f"no_{name}")

    blank = k % 50 == 0
    return rows.select(
        k.alias("rank_position"),
        F.when(blank, " ").otherwise(F.concat(F.lit("C"), (k - k % 40 % 2).cast("string"))).alias("molecule_id"),
        F.concat(F.lit("cust "), k.cast("string")).alias("input_smiles"),
        F.when(k % 100 != 0, F.concat(F.lit("cust "), k.cast("string"))).alias("canonical_smiles"),
        round_dp(F.col("mean_price") / 500000, 3).alias("priority_score"),
        F.col("cat").alias("evidence_summary_category"),
        F.when(F.col("n") > 3, "high_evidence_context").otherwise("moderate_evidence_context")
        .alias("biopharma_context_level"),
        signal("f").alias("public_identity_signal"), signal("o").alias("public_bioactivity_signal"),
        signal("p").alias("patent_context_signal"),
        F.when(F.col("n") > 1, "high").otherwise("low").alias("bbb_prediction"),
        round_dp(F.col("f") / F.col("n"), 3).alias("bbb_probability"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review annotations from ``labels``: raw, with odd case and blanks to be cleaned."""
    lab = table(spark, sf_dir, "labels")
    status = (
        F.when(F.col("toxic") == 1, " Rejected ").when(F.col("quality") == 1, "SELECTED")
        .when(F.col("doc_id") % 3 == 0, "watchlist").otherwise("maybe")
    )
    return lab.select(
        F.format_string("job%d", F.col("doc_id") % 2).alias("job_id"),
        F.concat(F.lit(" D"), F.col("doc_id").cast("string")).alias("annotation_key"),
        status.alias("review_status"),
        F.repeat(F.concat(F.lit(" note "), F.col("doc_id").cast("string")), (F.col("doc_id") % 80).cast("int"))
        .alias("review_note"),
    )


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


# ---- the same rows as SQL ---------------------------------------------------


def dp(x: str, digits: int) -> str:
    """Rounding rule in SQL."""
    return f"cast(round(cast({x} as decimal(28,9)), {digits}) as double)"


LABEL_SQL = """case when regexp_matches(lower(raw_label), 'non|imperme|negative|false|0') then 'low'
     when regexp_matches(lower(raw_label), 'perme|positive|true|1') then 'high' else 'uncertain' end"""

KEY_SQL = r"nullif(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '')"

CTE = {
    "cand_p": r"""
lines as (select l_partkey, cast(max(l_quantity) as integer) as q from lineitem group by 1),
raw_p as (
  select p_partkey as ord, 'P' || p_partkey as molecule_id,
    case when p_size > 1 then p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_partkey else '' end as smiles,
    case when p_partkey % 7 = 0 then '' when p_partkey % 7 = 1 then 'high affinity' when q is null then null
         else '-' || q || '.' || (p_partkey % 10) end as docking_text,
    cast(p_size * 15 as double) as mw, cast(p_size * 4 as double) as tpsa,
    cast(p_partkey % 15 as integer) as hba, cast(p_partkey % 8 as integer) as hbd,
    cast(p_size % 20 as integer) as rotatable_bonds,
    cast(p_partkey % 1000 as double) / 1000 as qed, cast(p_partkey % 70 as double) / 10 as logp,
    p_size as heavy_atoms, p_partkey % 6 as rings, p_partkey % 3 as bridgeheads, p_partkey % 2 as spiro_atoms,
    p_partkey % 5 as chiral_centers, p_partkey % 9 as hetero_atoms,
    case p_type when 'PROMO' then 'permeable' when 'SMALL' then 'non-permeable' when 'LARGE' then 'LABEL_1'
         when 'MEDIUM' then 'LABEL_0' else 'other' end as raw_label,
    cast(p_partkey % 97 as double) / 97 as raw_probability, p_size > 1 as valid_molecule
  from part left join lines on p_partkey = l_partkey),
cand_p as (
  select *,
    case when valid_molecule then """ + LABEL_SQL + r""" else 'unavailable' end as bbb_prediction,
    case when valid_molecule then """ + dp("raw_probability", 3) + r""" end as bbb_probability,
    case when valid_molecule then 'model_available' else 'not_run_invalid_molecule' end as bbb_model_status,
    case when valid_molecule then (mw > 500)::integer + (hba > 10)::integer + (hbd > 5)::integer + (logp > 5)::integer end
      as lipinski_violations,
    case when docking_text similar to '-[0-9]+\.[0-9]+' then cast(docking_text as double) end as docking_score,
    case when docking_text similar to '-[0-9]+\.[0-9]+' then 'provided' else 'invalid_docking_score' end as docking_status
  from raw_p),
scored_p as (
  select *, coalesce(lipinski_violations <= 1, false) as lipinski_pass,
    case when valid_molecule then """ + dp("""greatest(0::double, least(1::double,
      0.45::double * qed
      + 0.25::double * (case when lipinski_violations <= 1 then 1::double else 0.4::double end)
      + 0.15::double * (case when mw < 150 then greatest(0::double, mw / 150)
                             when mw > 500 then greatest(0::double, 1 - (mw - 500) / 500) else 1::double end)
      + 0.1::double * (case when tpsa < 20 then greatest(0::double, tpsa / 20)
                            when tpsa > 140 then greatest(0::double, 1 - (tpsa - 140) / 140) else 1::double end)
      + 0.05::double * greatest(0::double, 1 - greatest(0::double, cast(rotatable_bonds as double) - 10) / 10)
      + 0.05::double * (case bbb_prediction when 'high' then bbb_probability when 'low' then -bbb_probability
                        else 0::double end)))""", 3) + r""" else 0::double end as priority_score
  from cand_p)""",
    "docs": r"""
docs as (select doc_id as ord, 'D' || doc_id as molecule_id, text, source, lang,
    """ + KEY_SQL.format("text") + r""" as key from documents),
ref_all as (select ord, key, 'Doc ' || ord as name, source, 'REF' || ord as compound_id from docs
    where source in ('src0','src1','src2','src3','src4') and key is not null),
ref as (select key, max_by(name, ord) as name, max_by(source, ord) as source,
    max_by(compound_id, ord) as compound_id, min(ord) as position from ref_all group by key),
all_d as (select ord, molecule_id, source, coalesce(text, '') as input_smiles, key as canonical_smiles,
    key is not null as valid_molecule, least(""" + dp("cast(ord % 101 as double) / 100", 3) + r""", 1::double) as priority_score
    from docs),
cand_d as (select * from all_d where source not in ('src0','src1','src2','src3','src4'))""",
    "runs": r"""
runs as (select strftime(d, '%Y-%m-%d') as job_id,
    case when count(*) filter (event_type = 'error') * 5 > count(*) then 'failed' else 'completed' end as status,
    'in/' || strftime(d, '%Y-%m-%d') as input_file, 'out/' || strftime(d, '%Y-%m-%d') as output_file,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') as created_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as completed_at,
    count(*) as row_count, null::boolean as public_lookup_requested,
    day(d) % 2 = 0 as pubchem_lookup_requested,
    case when day(d) % 7 <> 0 then day(d) % 3 = 0 end as chembl_lookup_requested,
    day(d) % 5 = 0 as patent_lookup_requested
  from (select *, cast(ts as date) as d from events) group by d)""",
    "ann": r"""
ann_raw as (select 'job' || (doc_id % 2) as job_id, ' D' || doc_id as annotation_key,
    case when toxic = 1 then ' Rejected ' when quality = 1 then 'SELECTED' when doc_id % 3 = 0 then 'watchlist'
         else 'maybe' end as review_status,
    repeat(' note ' || doc_id, cast(doc_id % 80 as integer)) as review_note from labels),
ann as (select job_id, trim(annotation_key) as annotation_key,
    case when lower(trim(review_status)) in ('unreviewed','selected','watchlist','deprioritized','rejected')
         then lower(trim(review_status)) else 'unreviewed' end as review_status,
    substring(trim(review_note), 1, 500) as review_note from ann_raw)""",
}


def run_cte(name: str, span: str) -> str:
    """SQL of :func:`customer_run` as CTEs ending in ``name``."""
    return rf"""
{name}_p as (select o_custkey as k, o_orderpriority as pr, count(*) as n,
    sum(cast(o_totalprice as decimal(18,2))) as total, count(*) filter (o_orderstatus = 'F') as f,
    count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p
  from orders where {span} group by 1, 2),
{name}_g as (select k, cast(sum(total) as double) / sum(n) as mean_price, arg_min(pr, (-n, pr)) as cat,
    sum(f) as f, sum(o) as o, sum(p) as p, sum(n) as n from {name}_p group by k),
{name} as (select k as rank_position,
    case when k % 50 = 0 then ' ' else 'C' || (k - k % 40 % 2) end as molecule_id,
    'cust ' || k as input_smiles, case when k % 100 <> 0 then 'cust ' || k end as canonical_smiles,
    {dp("mean_price / 500000", 3)} as priority_score, cat as evidence_summary_category,
    case when n > 3 then 'high_evidence_context' else 'moderate_evidence_context' end as biopharma_context_level,
    case when f > 0 then 'f_present' else 'no_f' end as public_identity_signal,
    case when o > 0 then 'o_present' else 'no_o' end as public_bioactivity_signal,
    case when p > 0 then 'p_present' else 'no_p' end as patent_context_signal,
    case when n > 1 then 'high' else 'low' end as bbb_prediction,
    {dp("f::double / n", 3)} as bbb_probability from {name}_g)"""


def with_sql(*names: str) -> str:
    """``with`` clause of the named bindings."""
    return "with " + ",".join(CTE[n] for n in names)
