"""Queries of lookups, caches, payloads and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions import labels as L
from siftrank.functions import payloads as J
from siftrank.functions.evidence import with_evidence
from siftrank.functions.numbers import round_dp
from siftrank.operators import lookups as E
from siftrank.operators import summaries as S
from siftrank.operators.filters import plottable
from siftrank.plans import bindings as B
from siftrank.plans.registry import ORACLES, query
from siftrank.session import durable
from siftrank.sources.lookup_cache import LookupCache
from siftrank.sources.readers import read_lookup_cache
from siftrank.sources.writers import upsert_lookup_cache

# ---- bindings -----------------------------------------------------------------
# Rows are customers keyed by the number in their name; every 17th is invalid.


def look_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer")
    k = F.col("c_custkey")
    key = F.when(k % 17 != 0, F.concat(F.lit("k"), (k - k % 3).cast("string")))
    return c.select(
        k.alias("ord"), F.concat(F.lit("C"), k.cast("string")).alias("molecule_id"),
        F.col("c_name").alias("input_smiles"), key.alias("canonical_smiles"),
        key.isNotNull().alias("valid_molecule"), "c_acctbal", "c_mktsegment",
    )


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer").where("c_nationkey < 20")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("k"), k.cast("string")).alias("identity_key"), k.alias("ord"),
        F.concat(F.lit("CID"), k.cast("string")).alias("cid"),
        F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("title"),
        F.when(k % 10 != 0, F.col("c_name")).alias("systematic"),
    )


def chemicals(spark: SparkSession, sf: str) -> DataFrame:
    s = B.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("k"), (k * 3).cast("string")).alias("identity_key"), k.alias("ord"),
        F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("CH"), k.cast("string"))).alias("chemical_id"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").where("l_suppkey % 7 <> 0")
    return li.select(
        F.concat(F.lit("CH"), F.col("l_suppkey").cast("string")).alias("chemical_id"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("pos"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("doc_id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
    )


def identity_cache(spark: SparkSession, sf: str) -> DataFrame:
    """JSON payloads of earlier identity lookups: good, failed and malformed ones."""
    c = B.table(spark, sf, "customer").where("c_custkey % 4 = 0")
    k = F.col("c_custkey")
    result = F.to_json(F.struct(
        (k % 8 == 0).alias("pubchem_exact_match"), F.concat(F.lit("OLD"), k.cast("string")).alias("pubchem_cid"),
        F.when(k % 16 == 0, "lookup_failed").when(k % 8 == 0, "exact_match").alias("pubchem_lookup_status"),
    ))
    payload = (
        F.when(k % 20 == 0, F.lit("[1]"))
        .when(k % 12 == 0, F.concat(F.lit('{"source":"PubChem","result":"'), k.cast("string"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"source":"PubChem","result":'), result, F.lit("}")))
    )
    return c.select(F.concat(F.lit("k"), k.cast("string")).alias("identity_key"),
                    F.lit("2024-01-01").alias("cached_at"), payload.alias("payload"))


LOOK = """with rows_ as (select c_custkey as ord, 'C' || c_custkey as molecule_id,
    case when c_custkey % 17 <> 0 then 'k' || (c_custkey - c_custkey % 3) end as key from customer),
comp as (select 'k' || c_custkey as key, 'CID' || c_custkey as cid,
    coalesce(case when c_custkey % 5 <> 0 then c_mktsegment end, case when c_custkey % 10 <> 0 then c_name end) as name
    from customer where c_nationkey < 20),
cache as (select 'k' || c_custkey as key, c_custkey as k, c_custkey % 12 = 0 as broken from customer
    where c_custkey % 4 = 0 and c_custkey % 20 <> 0)"""

IDENTITY_SELECT = """select r.ord,
  case when r.key is null then false when h.key is not null then (not h.broken and h.k % 8 = 0) else c.key is not null end as pubchem_exact_match,
  case when r.key is null then null when h.key is not null then case when not h.broken then 'OLD' || h.k end else c.cid end as pubchem_cid,
  case when r.key is null or h.key is not null then null else c.name end as pubchem_preferred_name,
  case when r.key is null then 'not_run_invalid_molecule' when h.key is not null then
       case when h.broken or h.k % 16 = 0 then 'lookup_failed' when h.k % 8 = 0 then 'exact_match' else 'lookup_failed' end
       when c.key is not null then 'exact_match' else 'no_exact_match' end as pubchem_lookup_status,
  case when r.key is null then 'not_used' when h.key is not null then 'cache_hit' else 'fresh_lookup' end as pubchem_cache_status,
  case when r.key is null then 'Public lookup skipped for invalid molecule.' when h.broken then 'Cached PubChem payload was malformed.' else '' end as pubchem_warning
from rows_ r left join cache h on r.key = h.key left join comp c on r.key = c.key"""


@query("lookup_identity", LOOK + " " + IDENTITY_SELECT)
def identity_lookup(spark, sf):
    """Cache first, then the snapshot; every row gets its result."""
    cache = read_lookup_cache(identity_cache(spark, sf), "identity")
    rows = E.with_identity(look_rows(spark, sf), compounds(spark, sf), cache)
    return rows.select("ord", *V.IDENTITY_COLUMNS)


@query("lookup_cache_read", LOOK + """ select key as identity_key, not broken and k % 8 = 0 as hit,
  case when broken then null else 'OLD' || k end as cid,
  case when broken or k % 16 = 0 then 'lookup_failed' when k % 8 = 0 then 'exact_match' else 'lookup_failed' end as status,
  'cache_hit' as cache_status, case when broken then 'Cached PubChem payload was malformed.' else '' end as warning from cache""")
def cache_read(spark, sf):
    c = read_lookup_cache(identity_cache(spark, sf), "identity")
    r = F.col("result")
    return c.select("identity_key", r["pubchem_exact_match"].alias("hit"), r["pubchem_cid"].alias("cid"),
                    r["pubchem_lookup_status"].alias("status"), r["pubchem_cache_status"].alias("cache_status"),
                    r["pubchem_warning"].alias("warning"))


@query("lookup_cache_write", LOOK + """, k as (select distinct key from rows_ where key is not null)
select k.key as identity_key, c.key is not null as hit, coalesce(c.cid, '-') as cid from k left join comp c using (key)""")
def cache_write(spark, sf):
    """Fresh results appended to the cache table and read back as the latest per key."""
    keys = E.distinct_keys(look_rows(spark, sf))
    path = B.scratch(spark, "cache")
    fresh = E.lookup_identity(keys, compounds(spark, sf))
    upsert_lookup_cache(fresh, "identity", path)
    stored = spark.read.parquet(path).where(F.col("source") == "identity")
    hits, _ = E.cache_split(keys, stored, "identity")
    return hits.select("identity_key", F.col("result.pubchem_exact_match").alias("hit"),
                       F.coalesce("result.pubchem_cid", F.lit("-")).alias("cid"))


@query("lookup_cache_split", LOOK + """, k as (select distinct key from rows_ where key is not null)
select 'hit' as part, count(*) as keys from k semi join cache using (key)
union all select 'miss', count(*) from k anti join cache using (key)
union all select 'miss_with_retry', count(*) from k anti join (select * from cache where not broken and k % 8 = 0 and k % 16 <> 0) using (key)""")
def cache_split(spark, sf):
    cache = read_lookup_cache(identity_cache(spark, sf), "identity")
    keys = E.distinct_keys(look_rows(spark, sf))
    hits, misses = E.cache_split(keys, cache, "identity")
    _, again = E.cache_split(keys, cache, "identity", retry_failed=True)
    parts = {"hit": hits, "miss": misses, "miss_with_retry": again}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("keys")).select(F.lit(name).alias("part"), "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("activity_summary", """with t as (select o_custkey as molecule_id, o_orderpriority as t, count(*) as n from orders group by 1, 2),
a as (select molecule_id, sum(n)::bigint as activity_count, count(*) filter (t <> '5-LOW') as target_count,
      list_sort(list(t) filter (t <> '5-LOW'))[1:5] as ts from t group by 1)
select molecule_id, activity_count, target_count, nullif(array_to_string(ts, '; '), '') as target_summary from a""")
def activity(spark, sf):
    o = B.table(spark, sf, "orders")
    target = F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return E.activity_summary(o.select(F.col("o_custkey").alias("molecule_id"), target.alias("target_name")))


def doc_molecules(spark, sf) -> DataFrame:
    ref = B.with_features(B.reference_documents(spark, sf).where(F.col("key").isNotNull()), "key")
    return ref.select(F.col("key").alias("identity_key"), "ord", F.col("compound_id").alias("molecule_id"),
                      F.col("name").alias("pref_name"), "features")


def doc_activities(spark, sf) -> DataFrame:
    return B.table(spark, sf, "orders").select(
        F.concat(F.lit("REF"), F.col("o_custkey").cast("string")).alias("molecule_id"),
        F.col("o_orderpriority").alias("target_name"))


SHINGLES = r""",
words as (select ord, key, string_split(key, ' ') as w from docs where key is not null),
sh as (select distinct ord, s from (select ord, unnest(case when len(w) < 3 then [key]
   else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) end) as s from words)),
size_ as (select ord, count(*) as n from sh group by ord)"""


@query("lookup_bioactivity", B.with_sql("docs") + SHINGLES + f""",
c as (select * from cand_d where valid_molecule),
ck as (select canonical_smiles as key, min(ord) as ord from c group by 1),
m as (select key, min(ord) as ord from ref_all group by key),
miss as (select ck.* from ck anti join m using (key)),
pairs as (select a.ord as a, b.ord as b, count(*) as shared from sh a join sh b on a.s = b.s
   join miss on miss.ord = a.ord join ref_all r on r.ord = b.ord group by 1, 2),
sims as (select a, b, shared::double / (x.n + y.n - shared) as sim from pairs join size_ x on x.ord = a join size_ y on y.ord = b),
best as (select a, max(sim) as sim, arg_min(b, (-sim, b)) as b from sims where sim >= 0.85 group by a),
hit as (select ck.key, 'exact' as kind, m.ord as mol, null::double as sim from ck join m using (key)
   union all select miss.key, 'similar', b, sim from best join miss on miss.ord = best.a),
act as (select o_custkey as k, count(*) as n, count(distinct o_orderpriority) as t,
   array_to_string(list_sort(list(distinct o_orderpriority))[1:5], '; ') as s from orders group by 1)
select cd.ord, coalesce(kind = 'exact', false) as chembl_exact_match,
  case when kind = 'exact' then 'REF' || mol end as chembl_molecule_id, case when kind = 'exact' then 'Doc ' || mol end as chembl_pref_name,
  case when not cd.valid_molecule then 'not_run_invalid_molecule' when kind = 'exact' then 'exact_match' when kind = 'similar' then 'similarity_match' else 'no_match' end as chembl_lookup_status,
  case when cd.valid_molecule then coalesce(case when kind is not null then act.n end, 0) end as chembl_activity_count,
  case when cd.valid_molecule then coalesce(case when kind is not null then act.t end, 0) end as chembl_target_count, act.s as chembl_target_summary,
  coalesce(kind = 'similar', false) as chembl_similarity_match, {B.dp("sim", 3)} as chembl_similarity_score,
  case when kind = 'similar' then 'REF' || mol end as chembl_similarity_molecule_id,
  case when not cd.valid_molecule then 'not_run_invalid_molecule' when kind = 'exact' then 'not_run_exact_match_found' when kind = 'similar' then 'similarity_match' else 'no_match' end as chembl_similarity_status
from cand_d cd left join hit on cd.canonical_smiles = hit.key left join act on act.k = hit.mol""")
def bioactivity_lookup(spark, sf):
    """Waterfall: exact key, then similarity of at least 0.85, then no match."""
    rows = B.with_features(B.candidate_documents(spark, sf))
    out = E.with_bioactivity(rows, doc_molecules(spark, sf), doc_activities(spark, sf))
    names = [c for c in V.BIOACTIVITY_COLUMNS
             if c not in ("chembl_cache_status", "chembl_warning", "chembl_similarity_pref_name")]
    return out.select("ord", *names)


DOCUMENTS = """, chem as (select 'k' || s_suppkey * 3 as key, case when s_suppkey % 13 <> 0 then 'CH' || s_suppkey end as id, s_suppkey as sk from supplier),
rec as (select l_suppkey as sk, count(*) as hits, arg_min(l_orderkey || '-' || l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) as doc,
   arg_min('Part ' || l_partkey, (l_shipdate, l_orderkey, l_linenumber)) as title from lineitem where l_suppkey % 7 <> 0 group by 1),
looked as (select r.ord, r.key, p.cid, ch.key as chem_key, ch.id, coalesce(case when ch.id is not null then rec.hits end, 0) as hits,
   case when ch.id is not null then rec.doc end as doc, case when ch.id is not null then rec.title end as title
  from rows_ r left join comp p on r.key = p.key left join chem ch on r.key = ch.key left join rec on rec.sk = ch.sk)"""


@query("lookup_documents", LOOK + DOCUMENTS + """
select ord, case when key is null then 'not_run_invalid_molecule' when hits > 0 then 'match_found' else 'no_match' end as patent_lookup_status,
  case when key is null then 'not_used' else 'fresh_lookup' end as patent_cache_status,
  key is not null and hits > 0 as patent_public_evidence_match, 'SureChEMBL' as patent_source,
  case when key is not null then hits end as patent_record_count, doc as patent_top_record_id, title as patent_top_record_title,
  'https://www.surechembl.org/document/' || doc as patent_top_record_url,
  case when id is null then key else 'surechembl_chemical_id:' || id || '|smiles:' || key || '|pubchem_cid:' || coalesce(cid, '') || '|chembl_id:' end as patent_query_identifier,
  case when key is null then 'Patent-context lookup skipped for invalid molecule.' when chem_key is not null and id is null
       then 'SureChEMBL chemical match did not include a chemical ID.' else '' end as patent_warning
from looked""")
def document_lookup(spark, sf):
    """Two hops; the ids of the identity lookup travel into the composite identifier."""
    rows = E.with_identity(look_rows(spark, sf), compounds(spark, sf))
    rows = E.not_requested(rows, "bioactivity")
    out = E.with_documents(rows, chemicals(spark, sf), records(spark, sf))
    return out.select("ord", *V.DOCUMENT_COLUMNS)


# ---- stored cache -------------------------------------------------------------
# A first run fills the cache; in the second the sources are empty, so all it returns was read from the cache.


def filled_cache(spark: SparkSession, found: DataFrame, source: str) -> LookupCache:
    """A cache with a failed version of every second key and the given results after it."""
    cache = LookupCache(spark, B.scratch(spark, "lookup-cache"), buckets=8)
    stale = found.where(F.xxhash64("identity_key") % 2 == 0).select("identity_key", E.failed_result(source, "late").alias("result"))
    cache.write(stale, source)
    cache.write(found, source)
    return cache


@query("lookup_cache_identity", LOOK + """ select r.ord, c.key is not null as pubchem_exact_match, c.cid as pubchem_cid,
  c.name as pubchem_preferred_name, case when r.key is null then 'not_run_invalid_molecule' when c.key is not null then 'exact_match' else 'no_exact_match' end as pubchem_lookup_status,
  case when r.key is null then 'not_used' else 'cache_hit' end as pubchem_cache_status,
  case when r.key is null then 'Public lookup skipped for invalid molecule.' else '' end as pubchem_warning
from rows_ r left join comp c on r.key = c.key""")
def cache_identity(spark, sf):
    """All identity results out of the stored cache, after compaction."""
    rows = look_rows(spark, sf)
    cache = filled_cache(spark, E.lookup_identity(E.distinct_keys(rows), compounds(spark, sf)), "identity")
    cache.compact("identity")
    return E.with_identity(rows, compounds(spark, sf).limit(0), cache).select("ord", *V.IDENTITY_COLUMNS)


@query("lookup_cache_bioactivity", "select q.*, case when chembl_lookup_status = 'not_run_invalid_molecule' then 'not_used' else 'cache_hit' end"
       " as chembl_cache_status from (" + ORACLES["lookup_bioactivity"] + ") q")
def cache_bioactivity(spark, sf):
    """All bioactivity results out of the stored cache, older versions beside them."""
    rows = durable(B.with_features(B.candidate_documents(spark, sf)))
    keys = durable(E.distinct_keys(rows, ["features"]))  # read by every branch of the waterfall
    molecules, activities = doc_molecules(spark, sf), doc_activities(spark, sf)
    cache = filled_cache(spark, durable(E.bioactivity_results(keys, molecules, activities)), "bioactivity")
    out = E.with_bioactivity(rows, molecules.limit(0), activities.limit(0), cache)
    return out.select("ord", *[c for c in V.BIOACTIVITY_COLUMNS if c not in ("chembl_warning", "chembl_similarity_pref_name")])


@query("lookup_cache_document", ORACLES["lookup_documents"].replace("'fresh_lookup'", "'cache_hit'"))
def cache_document(spark, sf):
    """All document results out of the stored cache; the ids of the second run are ignored on a hit."""
    rows = E.not_requested(E.with_identity(look_rows(spark, sf), compounds(spark, sf)), "bioactivity")
    ids = rows.withColumns({"cid": F.col("pubchem_cid"), "molecule_id": F.col("chembl_molecule_id")})
    keys = E.distinct_keys(ids, ["cid", "molecule_id"])
    cache = filled_cache(spark, E.document_results(keys, chemicals(spark, sf), records(spark, sf)), "document")
    again = rows.withColumns({"pubchem_cid": F.lit("other"), "chembl_molecule_id": F.lit("other")})
    return E.with_documents(again, chemicals(spark, sf).limit(0), records(spark, sf).limit(0), cache).select("ord", *V.DOCUMENT_COLUMNS)


@query("lookup_cache_compact", LOOK + """, k as (select distinct key from rows_ where key is not null)
select count(*) as keys, count(*) as versions, count(*) as hits, 0::bigint as misses from k""")
def cache_compact(spark, sf):
    """After compaction one version of every key is left, and every key is a hit."""
    keys = E.distinct_keys(look_rows(spark, sf))
    cache = filled_cache(spark, E.lookup_identity(keys, compounds(spark, sf)), "identity")
    cache.compact("identity")
    hits, misses = cache.split(keys, "identity")
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("versions", cache.entries("identity")), ("hits", hits), ("misses", misses))]
    out = keys.agg(F.count("*").alias("keys"))
    for one in counts:
        out = out.crossJoin(one)  # one row each
    return out


# ---- payloads -----------------------------------------------------------------


@query("first_identifier", "select event_id, case when event_type <> 'error' then cast(user_id as varchar) end as cid from events")
def first_identifier(spark, sf):
    e = B.table(spark, sf, "events")
    ids = F.when(F.col("event_type") == "error", F.array().cast("array<bigint>")).otherwise(F.array("user_id", "event_id"))
    body = F.to_json(F.struct(F.struct(ids.alias("CID")).alias("IdentifierList")))
    return e.select("event_id", J.first_identifier(body).alias("cid"))


@query("preferred_name", LOOK + " select key as identity_key, name from comp")
def preferred(spark, sf):
    return compounds(spark, sf).select("identity_key", J.preferred_name("title", "systematic").alias("name"))


@query("payload_status", """select event_id, case event_type when 'error' then case when user_id % 2 = 0 then 'bad ' || user_id else 'Unknown SureChEMBL error.' end
  when 'signup' then 'late' end as error, case event_type when 'view' then '' when 'click' then 'ch' || user_id when 'purchase' then 'id' || user_id end as chemical,
  case when event_type = 'click' then event_id else 0 end as hits from events""")
def payload_status(spark, sf):
    e = B.table(spark, sf, "events")
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    status = F.when(kind == "error", "failed").when(kind == "signup", "ERROR").when(kind == "view", "ok")
    chem = F.when(kind.isin("view", "click", "purchase"), F.create_map(F.lit("x"), F.struct(
        F.when(kind == "click", F.concat(F.lit("ch"), user)).alias("chemical_id"),
        F.when(kind == "purchase", F.concat(F.lit("id"), user)).alias("id"))))
    body = F.to_json(F.struct(
        status.alias("status"),
        F.when((kind == "error") & (F.col("user_id") % 2 == 0), F.concat(F.lit("bad "), user)).alias("error_message"),
        F.when(kind == "signup", "late").alias("errorMessage"), chem.alias("data")))
    docs = F.to_json(F.struct(F.struct(F.struct(
        F.when(kind == "click", F.col("event_id")).alias("total_hits")).alias("results")).alias("data")))
    return e.select("event_id", J.payload_error(body).alias("error"), J.first_chemical_id(body).alias("chemical"),
                    J.documents_of(docs)["total_hits"].alias("hits"))


@query("document_title", """select doc_id, case when n_chars % 3 = 0 then null when n_chars % 3 = 1 then 'A' || doc_id else lang end as title,
  'https://www.surechembl.org/document/' || doc_id as url from documents""")
def document_title(spark, sf):
    d = B.table(spark, sf, "documents")
    k, n = F.col("doc_id").cast("string"), F.col("n_chars") % 3

    def group(*titles):
        return F.struct(F.array(*titles).cast("array<string>").alias("titles"))

    groups = (F.when(n == 0, F.array(group())).when(n == 1, F.array(group(), group(F.concat(F.lit("A"), k), F.lit("z"))))
              .otherwise(F.array(group(F.col("lang")), group(k))))
    body = F.to_json(F.struct(F.struct(F.struct(F.lit(1).alias("total_hits"), F.array(F.struct(
        k.alias("docId"), F.struct(groups.alias("titles")).alias("metadata"))).alias("documents")).alias("results")).alias("data")))
    doc = J.documents_of(body)["document"]
    return d.select("doc_id", J.document_title(doc).alias("title"), J.document_url(doc["docId"]).alias("url"))


# ---- evidence -----------------------------------------------------------------
# Rows with every lookup state, derived from customers and their orders.


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "customer")
    per = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    k = F.col("c_custkey")

    def pick(mod: int, values: list[str]):
        out = F.lit(values[-1])
        for i, v in enumerate(values[:-1]):
            out = F.when(k % mod == i, v).otherwise(out)
        return out

    s = (k % 101) / 100
    rows = c.join(per, k == F.col("o_custkey"), "left")
    return rows.select(
        k.alias("rank_position"), F.concat(F.lit("C"), k.cast("string")).alias("molecule_id"),
        F.when(k % 19 != 0, k % 13 != 0).alias("valid_molecule"),
        (k % 6 == 0).alias("known_compound_match"),
        F.when(k % 12 == 0, F.concat(F.lit("Known "), k.cast("string"))).alias("known_compound_name"),
        F.when(k % 13 == 0, "not_run_invalid_molecule").when(k % 6 == 0, "exact_match").otherwise("no_exact_match")
        .alias("identity_check_status"),
        F.when(k % 3 != 0, F.concat(F.lit("Near "), k.cast("string"))).alias("closest_known_compound_name"),
        F.lit("local").alias("closest_known_compound_source"),
        F.when(k % 4 != 0, s).alias("closest_known_compound_similarity"),
        F.when(k % 4 == 0, "not_run").otherwise("closest_match_found").alias("similarity_check_status"),
        (k % 5 == 1).alias("pubchem_exact_match"),
        F.when(k % 5 == 1, k.cast("string")).alias("pubchem_cid"),
        F.when(k % 10 == 1, F.col("c_mktsegment")).alias("pubchem_preferred_name"),
        pick(5, ["not_requested", "exact_match", "lookup_failed", "no_exact_match"]).alias("pubchem_lookup_status"),
        F.when(k % 5 == 2, F.concat(F.lit("w"), (k % 3).cast("string"))).otherwise("").alias("pubchem_warning"),
        (k % 7 == 1).alias("chembl_exact_match"), (k % 7 == 2).alias("chembl_similarity_match"),
        F.when(k % 7 == 1, F.concat(F.lit("M"), k.cast("string"))).alias("chembl_molecule_id"),
        F.lit(None).cast("string").alias("chembl_pref_name"),
        F.when(k % 7 == 2, 0.9).alias("chembl_similarity_score"),
        F.when(k % 7 == 2, F.concat(F.lit("S"), k.cast("string"))).alias("chembl_similarity_molecule_id"),
        F.lit(None).cast("string").alias("chembl_similarity_pref_name"),
        F.col("n").alias("chembl_activity_count"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("chembl_target_summary"),
        pick(7, ["not_requested", "exact_match", "similarity_match", "lookup_failed", "no_match"]).alias("chembl_lookup_status"),
        F.lit("").alias("chembl_warning"),
        (k % 9 == 1).alias("patent_public_evidence_match"), F.lit("SureChEMBL").alias("patent_source"),
        F.when(k % 9 == 1, k % 8).alias("patent_record_count"),
        pick(9, ["not_requested", "match_found", "lookup_failed", "no_match"]).alias("patent_lookup_status"),
        F.lit("").alias("patent_warning"),
        pick(4, ["selected", "watchlist", "", "rejected"]).alias("review_status"),
        F.when(k % 13 != 0, k % 37).alias("diversity_cluster_id"),
        F.when(k % 13 != 0, (k % 37) % 11 + 1).alias("diversity_cluster_size"),
        (k % 37 == k).alias("diversity_representative"),
        F.when(k % 13 == 0, "not_run_invalid_molecule").otherwise("clustered").alias("diversity_status"),
        F.when(k % 3 == 1, F.concat(F.lit("C"), (k - 1).cast("string"))).alias("nearest_neighbor_molecule_id"),
        F.when(k % 13 != 0, s).alias("nearest_neighbor_similarity"),
        F.when(k % 13 != 0, F.col("c_acctbal")).alias("chemical_space_x"),
        F.when(k % 13 != 0, F.col("c_acctbal") % 100).alias("chemical_space_y"),
        F.when(k % 13 == 0, "not_run_invalid_molecule").otherwise("projected").alias("chemical_space_status"),
        s.alias("priority_score"),
        pick(3, ["model_available", "model_unavailable", "not_run_invalid_molecule"]).alias("bbb_model_status"),
        F.when(k % 3 == 1, F.concat(F.lit("missing "), (k % 4).cast("string"))).otherwise(" ").alias("bbb_warning"),
        pick(5, ["provided", "invalid_docking_score", "not_provided"]).alias("docking_status"),
        pick(6, ["easy", "moderate", "not_available", "difficult"]).alias("synthetic_feasibility_category"),
    )


EVID = """with per as (select o_custkey, count(*) as n from orders group by 1),
ev as (select c_custkey as k, c_custkey as rank_position, 'C' || c_custkey as molecule_id,
  case when c_custkey % 19 <> 0 then c_custkey % 13 <> 0 end as valid_molecule, c_custkey % 6 = 0 as known_compound_match,
  case when c_custkey % 12 = 0 then 'Known ' || c_custkey end as known_compound_name,
  case when c_custkey % 13 = 0 then 'not_run_invalid_molecule' when c_custkey % 6 = 0 then 'exact_match' else 'no_exact_match' end as identity_check_status,
  case when c_custkey % 3 <> 0 then 'Near ' || c_custkey end as closest_known_compound_name,
  case when c_custkey % 4 <> 0 then cast(c_custkey % 101 as double) / 100 end as closest_known_compound_similarity,
  case when c_custkey % 4 = 0 then 'not_run' else 'closest_match_found' end as similarity_check_status,
  c_custkey % 5 = 1 as pubchem_exact_match, case when c_custkey % 5 = 1 then c_custkey::varchar end as pubchem_cid,
  case when c_custkey % 10 = 1 then c_mktsegment end as pubchem_preferred_name,
  case c_custkey % 5 when 0 then 'not_requested' when 1 then 'exact_match' when 2 then 'lookup_failed' else 'no_exact_match' end as pubchem_lookup_status,
  case when c_custkey % 5 = 2 then 'w' || (c_custkey % 3) else '' end as pubchem_warning,
  c_custkey % 7 = 1 as chembl_exact_match, c_custkey % 7 = 2 as chembl_similarity_match,
  case when c_custkey % 7 = 1 then 'M' || c_custkey end as chembl_molecule_id,
  case when c_custkey % 7 = 2 then 'S' || c_custkey end as chembl_similarity_molecule_id,
  n as chembl_activity_count, case when c_custkey % 2 = 0 then c_mktsegment end as chembl_target_summary,
  case c_custkey % 7 when 0 then 'not_requested' when 1 then 'exact_match' when 2 then 'similarity_match' when 3 then 'lookup_failed' else 'no_match' end as chembl_lookup_status,
  c_custkey % 9 = 1 as patent_public_evidence_match, case when c_custkey % 9 = 1 then c_custkey % 8 end as patent_record_count,
  case c_custkey % 9 when 0 then 'not_requested' when 1 then 'match_found' when 2 then 'lookup_failed' else 'no_match' end as patent_lookup_status,
  case c_custkey % 4 when 0 then 'selected' when 1 then 'watchlist' when 2 then 'unreviewed' else 'rejected' end as review_status,
  case when c_custkey % 13 <> 0 then c_custkey % 37 end as diversity_cluster_id,
  case when c_custkey % 13 <> 0 then (c_custkey % 37) % 11 + 1 end as diversity_cluster_size,
  c_custkey % 37 = c_custkey as diversity_representative,
  case when c_custkey % 13 = 0 then 'not_run_invalid_molecule' else 'clustered' end as diversity_status,
  case when c_custkey % 3 = 1 then 'C' || (c_custkey - 1) end as nearest_neighbor_molecule_id,
  case when c_custkey % 13 <> 0 then cast(c_custkey % 101 as double) / 100 end as nearest_neighbor_similarity,
  case when c_custkey % 13 <> 0 then c_acctbal end as chemical_space_x, case when c_custkey % 13 <> 0 then c_acctbal % 100 end as chemical_space_y,
  case when c_custkey % 13 = 0 then 'not_run_invalid_molecule' else 'projected' end as chemical_space_status,
  cast(c_custkey % 101 as double) / 100 as priority_score,
  case c_custkey % 3 when 0 then 'model_available' when 1 then 'model_unavailable' else 'not_run_invalid_molecule' end as bbb_model_status,
  case when c_custkey % 3 = 1 then 'missing ' || (c_custkey % 4) else ' ' end as bbb_warning,
  case c_custkey % 5 when 0 then 'provided' when 1 then 'invalid_docking_score' else 'not_provided' end as docking_status,
  case c_custkey % 6 when 0 then 'easy' when 1 then 'moderate' when 2 then 'not_available' else 'difficult' end as synthetic_feasibility_category
 from customer left join per on o_custkey = c_custkey),
sig as (select *, coalesce(not valid_molecule, false) as bad,
  case when pubchem_lookup_status = 'not_requested' then case when known_compound_match then 'local_identity_signal_present' else 'not_requested' end
       when pubchem_exact_match then 'public_identity_signal_present' when known_compound_match then 'local_identity_signal_present'
       when pubchem_lookup_status = 'lookup_failed' then 'lookup_failed' else 'no_public_identity_signal' end as s1,
  case when chembl_lookup_status = 'not_requested' then 'not_requested' when chembl_exact_match or chembl_similarity_match or coalesce(chembl_activity_count, 0) > 0
       then 'public_bioactivity_signal_present' when chembl_lookup_status = 'lookup_failed' then 'lookup_failed' else 'no_public_bioactivity_signal' end as s2,
  case when patent_lookup_status = 'not_requested' then 'not_requested' when patent_public_evidence_match or coalesce(patent_record_count, 0) > 0
       then 'patent_context_signal_present' when patent_lookup_status = 'lookup_failed' then 'lookup_failed' else 'no_patent_context_signal' end as s3,
  case when known_compound_match then 'local_exact_identity_signal_present' when coalesce(closest_known_compound_similarity >= 0.7, false)
       then 'high_local_similarity_signal_present' when similarity_check_status in ('not_run', 'not_run_invalid_molecule') then 'not_run'
       else 'no_high_local_similarity_signal' end as s4 from ev),
cat as (select *, (s1 like '%identity_signal_present')::int + (s2 = 'public_bioactivity_signal_present')::int + (s3 = 'patent_context_signal_present')::int as pub,
  (s4 = 'high_local_similarity_signal_present')::int as near from sig),
evid as (select *, case when bad then 'invalid_molecule' when pub >= 2 then 'combined_public_context' when s1 like '%identity_signal_present' then 'identity_context'
    when s2 = 'public_bioactivity_signal_present' then 'public_bioactivity_context' when s3 = 'patent_context_signal_present' then 'patent_context_signal'
    when near = 1 then 'local_similarity_context' else 'limited_public_context' end as evidence_summary_category,
  case when bad then 'invalid_molecule' when pub + near >= 3 then 'high_evidence_context' when pub + near >= 1 then 'moderate_evidence_context'
    else 'limited_public_context' end as biopharma_context_level from cat)"""


@query("evidence_signals", EVID + """ select molecule_id, case when bad then 'invalid_molecule' else s1 end as public_identity_signal,
  case when bad then 'invalid_molecule' else s2 end as public_bioactivity_signal, case when bad then 'invalid_molecule' else s3 end as patent_context_signal,
  case when bad then 'invalid_molecule' else s4 end as local_similarity_signal, evidence_summary_category, biopharma_context_level from evid""")
def signals(spark, sf):
    return with_evidence(evidence_rows(spark, sf)).select(
        "molecule_id", "public_identity_signal", "public_bioactivity_signal", "patent_context_signal",
        "local_similarity_signal", "evidence_summary_category", "biopharma_context_level")


FOCUS = "case evidence_summary_category " + " ".join(f"when '{k}' then '{v}'" for k, v in V.REVIEW_FOCUS.items()) + " end"


@query("review_focus", EVID + f" select evidence_summary_category, count(*) as rows, min({FOCUS}) as focus from evid group by 1")
def focus(spark, sf):
    return with_evidence(evidence_rows(spark, sf)).groupBy("evidence_summary_category").agg(
        F.count("*").alias("rows"), F.min("recommended_review_focus").alias("focus"))


@query("evidence_notes", EVID + """ select molecule_id, case when bad then 'Invalid molecule: evidence synthesis was not run for this row.' else
 coalesce(nullif(concat_ws(' ',
  case s1 when 'public_identity_signal_present' then 'Public identity signal: PubChem exact match found (' || coalesce(pubchem_preferred_name, pubchem_cid, 'PubChem') || ').'
    when 'local_identity_signal_present' then 'Public identity signal: local exact known-compound match found (' || coalesce(known_compound_name, 'local reference') || ').'
    when 'not_requested' then 'Public identity lookup was not requested.' when 'lookup_failed' then 'Public identity lookup failed; missing data is not interpreted as no signal.' end,
  case when pubchem_lookup_status = 'not_requested' and s1 <> 'not_requested' then 'PubChem public identity lookup was not requested.' end,
  case s2 when 'public_bioactivity_signal_present' then case when chembl_activity_count is not null then 'Public bioactivity signal: ChEMBL returned ' || chembl_activity_count || ' activity records.'
      else 'Public bioactivity signal: ChEMBL returned molecule context.' end
    when 'not_requested' then 'ChEMBL public bioactivity lookup was not requested.' when 'lookup_failed' then 'ChEMBL lookup failed; missing data is not interpreted as no signal.' end,
  case when s2 = 'public_bioactivity_signal_present' then 'ChEMBL target summary: ' || chembl_target_summary || '.' end,
  case s3 when 'patent_context_signal_present' then 'Patent-context signal: SureChEMBL returned ' || coalesce(patent_record_count::varchar, 'public') || ' records for this structure/query. Record counts may include broad or indirect public document associations.'
    when 'not_requested' then 'SureChEMBL patent-context lookup was not requested.' when 'lookup_failed' then 'SureChEMBL lookup failed; missing data is not interpreted as no signal.' end,
  case s4 when 'local_exact_identity_signal_present' then 'Local similarity signal: local exact identity match is present.'
    when 'high_local_similarity_signal_present' then 'Local similarity signal: closest local reference is ' || coalesce(closest_known_compound_name, 'local reference') || ' (' || closest_known_compound_similarity::varchar || ').' end), ''),
  'Limited public context: no configured evidence signals were detected.') end as notes from evid""")
def notes(spark, sf):
    return with_evidence(evidence_rows(spark, sf)).select("molecule_id", F.col("evidence_summary_notes").alias("notes"))


@query("interpretation", EVID + """ select molecule_id, case
  when valid_molecule = false or identity_check_status = 'not_run_invalid_molecule' then 'Invalid molecule'
  when known_compound_match then 'Exact known compound' when pubchem_exact_match then 'Public compound match'
  when chembl_exact_match or chembl_similarity_match then 'Public bioactivity context' when patent_public_evidence_match then 'Patent-context signal'
  when closest_known_compound_similarity >= 0.7 then 'Close analog signal' else 'No close local-reference match' end as label,
  length(case
  when valid_molecule = false or identity_check_status = 'not_run_invalid_molecule' then 'Invalid molecule: local identity and similarity context were not run for this row.'
  when known_compound_match then 'Exact known compound: this molecule matches ' || coalesce(known_compound_name, 'Not available') || ' in the local reference table.'
  when pubchem_exact_match then 'PubChem exact match: this molecule matched ' || coalesce(pubchem_preferred_name, 'Not available') || ' with CID ' || pubchem_cid || '. This is a public identity signal only, not a legal conclusion.'
  when chembl_exact_match then 'ChEMBL match: ' || chembl_molecule_id || ' (' || coalesce(chembl_activity_count::varchar, 'Not available') || ' activities). This is a public database signal, not a clinical conclusion.'
  when chembl_similarity_match then 'ChEMBL match: ' || chembl_similarity_molecule_id || ', similarity 0.9. This is a public database signal, not a clinical conclusion.'
  when patent_public_evidence_match then 'Public patent-associated evidence: SureChEMBL returned ' || case when patent_record_count > 0 then patent_record_count || ' returned records' else 'returned records' end || ' for this structure/query. Record counts may include broad or indirect public document associations. This is a public database signal only, not a legal conclusion.'
  when closest_known_compound_similarity >= 0.7 then 'Close analog signal: the closest local reference is ' || coalesce(closest_known_compound_name, 'Not available') || ' with similarity ' || printf('%.3f', closest_known_compound_similarity) || '.'
  else 'No close local-reference match: this row has no exact match and no closest-known similarity above the configured threshold.' end) as n_message from ev""")
def interpretation(spark, sf):
    """Readings of rows that carry no synthesised evidence yet."""
    rows = evidence_rows(spark, sf).withColumns({
        "evidence_summary_category": F.lit(None).cast("string"), "evidence_summary_notes": F.lit("")})
    return rows.select("molecule_id", L.interpretation().alias("i")).select(
        "molecule_id", "i.label", F.length("i.message").cast("bigint").alias("n_message"))


@query("interpretation_synthesised", EVID + """ select evidence_summary_category as category, count(*) as rows,
  min(array_to_string(list_transform(string_split(evidence_summary_category, '_'), lambda w: upper(w[1]) || w[2:]), ' ')) as label from evid group by 1""")
def interpretation_done(spark, sf):
    rows = with_evidence(evidence_rows(spark, sf))
    return rows.select("evidence_summary_category", L.interpretation()["label"].alias("label")).groupBy(
        F.col("evidence_summary_category").alias("category")).agg(F.count("*").alias("rows"), F.min("label").alias("label"))


@query("display_labels", EVID + """ select molecule_id,
  case when closest_known_compound_name is null then similarity_check_status else closest_known_compound_name || coalesce(' (' || closest_known_compound_similarity::varchar || ')', '') end as closest,
  case when pubchem_exact_match then coalesce(pubchem_preferred_name, 'PubChem exact match') || ' (CID ' || pubchem_cid || ')' else pubchem_lookup_status end as identity,
  case when chembl_exact_match then chembl_molecule_id || ' (' || coalesce(chembl_activity_count::varchar, 'Not available') || ' activities)'
       when chembl_similarity_match then chembl_similarity_molecule_id || ', similarity 0.9' else chembl_lookup_status end as bioactivity,
  case when patent_public_evidence_match then 'SureChEMBL returned ' || case when patent_record_count > 0 then patent_record_count || ' returned records' else 'returned records' end || ' for this structure/query' else patent_lookup_status end as document,
  case when diversity_status = 'not_run_invalid_molecule' then 'Not run for invalid molecule' else 'Cluster ' || diversity_cluster_id || ' (' || diversity_cluster_size || ' molecules)' end as cluster,
  coalesce(coalesce(nearest_neighbor_molecule_id || ': ', '') || nearest_neighbor_similarity::varchar, 'Not available') as neighbour from ev""")
def display_labels(spark, sf):
    return evidence_rows(spark, sf).select(
        "molecule_id", L.closest_label().alias("closest"), L.identity_label().alias("identity"),
        L.bioactivity_label().alias("bioactivity"), L.document_label().alias("document"),
        L.cluster_label().alias("cluster"), L.neighbour_label().alias("neighbour"))


# ---- summaries of evidence rows -------------------------------------------------


def counts_sql(column: str, source: str = "evid", name: str = "t") -> str:
    return (f"(select string_agg(v || ': ' || n, ', ' order by f) from (select {column} as v, count(*) as n, "
            f"min(rank_position) as f from {source} where {column} is not null group by 1))")


SUMMARY_FIGURES = """count(*) filter (known_compound_match) as exact_matches, count(*) filter (pubchem_exact_match) as identity_matches,
  count(*) filter (chembl_exact_match or chembl_similarity_match) as bioactivity_matches, count(*) filter (patent_public_evidence_match) as document_signals,
  count(*) filter (closest_known_compound_similarity >= 0.7) as high_similarity, count(distinct diversity_cluster_id) as cluster_count,
  max(diversity_cluster_size) as largest_cluster"""
SUMMARY_DETAILS = f"""{counts_sql("pubchem_lookup_status")} as identity_detail, {counts_sql("chembl_lookup_status")} as bioactivity_detail,
  {counts_sql("patent_lookup_status")} as document_detail, {counts_sql("evidence_summary_category")} as category_detail,
  (select array_to_string(list_transform(string_split(v, '_'), lambda w: upper(w[1]) || w[2:]), ' ') from (select evidence_summary_category as v, count(*) as n, min(rank_position) as f
     from evid group by 1 order by n desc, f limit 1)) as top_category,
  """ + " || ', ' || ".join(f"'{label}: ' || count(*) filter (coalesce(nullif(review_status, ''), 'unreviewed') = '{status}')"
                            for status, label in V.REVIEW_LABELS.items()) + " as review_summary"


@query("value_counts", EVID + " select pubchem_lookup_status as value, count(*) as rows, min(rank_position) as first_seen from evid group by 1")
def value_counts(spark, sf):
    return S.value_counts(evidence_rows(spark, sf), "pubchem_lookup_status")


@query("mode_label", EVID + " select evidence_summary_category as mode from evid group by 1 order by count(*) desc, min(rank_position) limit 1")
def mode_label(spark, sf):
    return S.mode_label(with_evidence(evidence_rows(spark, sf)), "evidence_summary_category")


@query("context_summary", EVID + f""" select {SUMMARY_FIGURES}, count(*) filter (not known_compound_match) as no_exact_matches,
  count(closest_known_compound_similarity) as similarity_count,
  printf('%.3f', round(avg(closest_known_compound_similarity::decimal(28,9))::decimal(28,9), 3)::double) as average_similarity, {SUMMARY_DETAILS} from evid""")
def context_summary(spark, sf):
    return S.context_summary(with_evidence(evidence_rows(spark, sf)))


@query("report_summary", EVID + f""" select 'run-7' as job_id, count(*) as total_rows, count(*) filter (valid_molecule) as valid_rows,
  count(*) filter (priority_score >= 0.75) as high_priority, {SUMMARY_FIGURES}, {SUMMARY_DETAILS} from evid""")
def report_summary(spark, sf):
    return S.report_summary(with_evidence(evidence_rows(spark, sf)), job_id="run-7")


@query("run_summary", EVID + f""" select count(*) as total_rows, count(*) filter (valid_molecule) as valid_rows, count(*) filter (priority_score >= 0.75) as high_priority,
  'Available' as model_summary, count(*) filter (bbb_model_status = 'model_available') || ' available, ' || count(*) filter (bbb_model_status <> 'model_available') || ' unavailable' as model_detail,
  count(*) filter (docking_status = 'provided') || ' provided' as docking_summary,
  count(*) filter (docking_status = 'not_provided') || ' not provided, ' || count(*) filter (docking_status = 'invalid_docking_score') || ' invalid' as docking_detail,
  {counts_sql("nullif(synthetic_feasibility_category, 'not_available')").replace("where nullif", "where nullif")} as complexity_summary, '' as complexity_detail, '2024-05-01T10:00:00Z' as completed_at from evid""")
def run_summary(spark, sf):
    return S.run_summary(evidence_rows(spark, sf), completed_at="2024-05-01T10:00:00Z")


@query("cluster_summary", EVID + """ select count(distinct diversity_cluster_id) as cluster_count, max(diversity_cluster_size) as largest_cluster,
  count(*) filter (diversity_representative) as representatives, count(distinct diversity_cluster_id) || ' clusters, largest cluster ' || max(diversity_cluster_size)
  || ', ' || count(*) filter (diversity_representative) || ' representatives' as diversity_summary from ev""")
def cluster_summary(spark, sf):
    return S.cluster_summary(evidence_rows(spark, sf))


@query("space_summary", EVID + """ select count(chemical_space_x) as plotted, count(*) filter (chemical_space_status = 'not_run_invalid_molecule') as skipped,
  count(distinct diversity_cluster_id) as plotted_clusters, count(*) filter (chemical_space_x is not null and review_status in ('selected', 'watchlist')) as plotted_selected from ev""")
def space_summary(spark, sf):
    return S.space_summary(evidence_rows(spark, sf))


@query("plot_points", EVID + f""", r as (select min(chemical_space_x) - (max(chemical_space_x) - min(chemical_space_x)) * 0.08::double as xl, max(chemical_space_x) + (max(chemical_space_x) - min(chemical_space_x)) * 0.08::double as xh,
  min(chemical_space_y) - (max(chemical_space_y) - min(chemical_space_y)) * 0.08::double as yl, max(chemical_space_y) + (max(chemical_space_y) - min(chemical_space_y)) * 0.08::double as yh from ev)
select molecule_id, {B.dp("(chemical_space_x - xl) / (xh - xl) * 100", 3)} as plot_x, {B.dp("(chemical_space_y - yl) / (yh - yl) * 100", 3)} as plot_y
from ev, r where chemical_space_x is not null""")
def plot_points(spark, sf):
    return S.plot_points(plottable(evidence_rows(spark, sf))).select("molecule_id", "plot_x", "plot_y")


@query("padded_range", f"""select {B.dp("min(c_acctbal) - (max(c_acctbal) - min(c_acctbal)) * 0.08", 6)} as low, {B.dp("max(c_acctbal) + (max(c_acctbal) - min(c_acctbal)) * 0.08", 6)} as high from customer""")
def padded(spark, sf):
    span = S.padded_range(B.table(spark, sf, "customer"), "c_acctbal")
    return span.select(round_dp("low", 6).alias("low"), round_dp("high", 6).alias("high"))


@query("status_values", EVID + " select string_agg(distinct chembl_lookup_status, '; ' order by chembl_lookup_status) as status_values from ev")
def status_values(spark, sf):
    return S.status_values(evidence_rows(spark, sf), "chembl_lookup_status")


# Four runs of all rows; in the last one, every lookup that was asked for has failed.
STATUS_JOBS = EVID + ", jev as (select *, 'late ' || (k % 3) as chembl_warning, ' none ' || (k % 2) as patent_warning from ev), j as (select * replace (" + ", ".join(
    f"case when k % 4 = 3 and {c} <> 'not_requested' then 'lookup_failed' else {c} end as {c}"
    for c, _, _ in S.SOURCES.values()) + "), 'run' || (k % 4) as job_id from jev)"


def status_sql(source: str) -> tuple[str, str, str]:
    """Status, whether there is a last success, and error text of a source, in SQL."""
    status, warning, done = S.SOURCES[source]
    ok = f"bool_or({status} in ({', '.join(repr(d) for d in done)}))"
    failed = f"bool_or({status} = 'lookup_failed')"
    text = f"nullif(trim({warning}), '')"
    return (f"case when {ok} then 'lookup_completed' when {failed} then 'lookup_failed' else 'not_requested' end", ok,
            f"case when {ok} then '' when {failed} then coalesce(string_agg(distinct {text}, '; ' order by {text}), '') else '' end")


def status_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence_rows(spark, sf).withColumn(
        "job_id", F.concat(F.lit("run"), (F.col("rank_position") % 4).cast("string")))
    rows = rows.withColumns({
        "chembl_warning": F.concat(F.lit("late "), (F.col("rank_position") % 3).cast("string")),
        "patent_warning": F.concat(F.lit(" none "), (F.col("rank_position") % 2).cast("string"))})
    return rows.withColumns({
        c: F.when((F.col("job_id") == "run3") & (F.col(c) != "not_requested"), "lookup_failed").otherwise(F.col(c))
        for c, _, _ in S.SOURCES.values()})


@query("source_status", STATUS_JOBS + " union all ".join(
    f" select job_id, '{s}' as source, {status_sql(s)[0]} as status, {status_sql(s)[1]} as has_success, {status_sql(s)[2]} as error_message from j group by job_id"
    for s in S.SOURCES))
def source_status(spark, sf):
    """All three sources over all rows."""
    out = S.source_statuses(status_jobs(spark, sf), ["job_id"])
    return out.withColumn("has_success", F.col("last_successful_lookup") != "").drop("last_successful_lookup")


@query("run_rollup", EVID + """ select 'run' || (k % 4) as job_id, case when bool_or(bbb_model_status = 'model_available') then 'model_available' else 'model_unavailable' end as actual_bbb_model_status,
  string_agg(distinct bbb_model_status, '; ' order by bbb_model_status) as bbb_model_status_values,
  bool_or(bbb_model_status <> 'model_available') as fallback_placeholder_used,
  bool_or(pubchem_lookup_status <> 'not_requested' or chembl_lookup_status <> 'not_requested' or patent_lookup_status <> 'not_requested') as public_lookup_requested,
  string_agg(distinct pubchem_lookup_status, '; ' order by pubchem_lookup_status) as pubchem_lookup_status_values,
  string_agg(distinct chembl_lookup_status, '; ' order by chembl_lookup_status) as chembl_lookup_status_values,
  string_agg(distinct patent_lookup_status, '; ' order by patent_lookup_status) as patent_lookup_status_values, count(*) as row_count from ev group by k % 4""")
def run_rollup(spark, sf):
    rows = evidence_rows(spark, sf).withColumn(
        "job_id", F.concat(F.lit("run"), (F.col("rank_position") % 4).cast("string")))
    return S.run_rollup(rows)


@query("distinct_warnings", EVID + " select distinct bbb_warning from ev where bbb_model_status = 'model_unavailable' and trim(bbb_warning) <> ''")
def distinct_warnings(spark, sf):
    return S.distinct_warnings(evidence_rows(spark, sf))

