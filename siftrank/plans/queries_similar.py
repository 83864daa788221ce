"""Queries of similarity, clustering, projection and diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.numbers import round_dp
from siftrank.functions.sets import pack_words, tanimoto, word_tanimoto
from siftrank.functions.keys import feature_set
from siftrank.operators.clustering import butina_cluster, cluster_columns
from siftrank.operators.diversity import analysable, diversity_analysis
from siftrank.operators.identity import closest_join, keyed_reference
from siftrank.operators.joins import rank_positions
from siftrank.operators.projection import project_2d
from siftrank.operators.similarity import (
    DistinctSets, approximate_pairs, closest_reference, collapse_sets, nearest_neighbour, similar_pairs,
)
from siftrank.plans import bindings as B
from siftrank.plans.queries_lookup import SHINGLES
from siftrank.plans.registry import query
from siftrank.session import durable

VEC = """with on_ as (select vec_id, label, unnest(range(0, len(embedding))) as i, unnest(embedding) as x from embeddings),
bits as (select vec_id as id, label, i from on_ where x > 0),
n_ as (select id, label, count(*) as n from bits group by 1, 2)"""
SETS = B.with_sql("docs") + SHINGLES + """,
sig as (select ord, md5(string_agg(s, '|' order by s)) as g, count(*) as n from sh group by ord),
sets as (select g, min(ord) as set_id, count(*) as members, min(n) as n from sig group by g),
shs as (select set_id, s, n from sets join sh on sh.ord = set_id)"""


# Fixed-width features: on-bits of shingles, and the distinct sets of them.
BIT_SETS = B.with_sql("docs") + SHINGLES + """,
bit as (select distinct ord, ('0x' || substr(md5(s), 1, 8))::bigint % 2048 as s from sh),
bsig as (select ord, md5(string_agg(s::varchar, '|' order by s)) as g, count(*) as n from bit group by ord),
bsets as (select g, min(ord) as set_id, count(*) as members, min(n) as n from bsig group by g),
bits_ as (select set_id, s, n from bsets join bit on bit.ord = set_id)"""


def bit_sets(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as ranked rows with fixed-width features."""
    rows = B.validated(B.document_rows(spark, sf)).where("valid_molecule")
    return rows.select("ord", "molecule_id", "priority_score", feature_set("canonical_smiles").alias("features"))


def document_sets(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as ranked rows with shingle features."""
    rows = B.validated(B.document_rows(spark, sf))
    return B.with_features(rows.where("valid_molecule")).select("ord", "molecule_id", "priority_score", "features")


def ranked_sets(rows: DataFrame) -> DistinctSets:
    """Distinct sets of rows, whose members are ranked: features are stored once and do not travel for the ranks."""
    distinct = collapse_sets(rows, "ord", "features")
    return DistinctSets(distinct.sets, durable(rank_positions(distinct.members)))


@query("tanimoto_pairs", VEC + f""", next as (select a.id, a.i, b.id as other from bits a join (select distinct id from bits) b on b.id = a.id + 1),
shared as (select n.id, count(b.id) as shared from next n left join bits b on b.id = n.other and b.i = n.i group by 1)
select s.id as ord, {B.dp("s.shared::double / (x.n + y.n - s.shared)", 6)} as similarity, {B.dp("s.shared::double / (x.n + y.n - s.shared)", 6)} as packed
from shared s join n_ x on x.id = s.id join n_ y on y.id = s.id + 1""")
def tanimoto_pairs(spark, sf):
    """Similarity of every vector to its successor, on positions and on packed words."""
    v = B.vectors(spark, sf).where(F.size("features") > 0).select(
        "ord", "features", pack_words("features", 64).alias("words"))
    nxt = v.select((F.col("ord") - 1).alias("ord"), F.col("features").alias("f2"), F.col("words").alias("w2"))
    return v.join(nxt, "ord").select(
        "ord", round_dp(tanimoto("features", "f2"), 6).alias("similarity"),
        round_dp(word_tanimoto("words", "w2"), 6).alias("packed"))


@query("similar_pairs", SETS + f""", cand as (select x.set_id as a, y.set_id as b, count(*) as shared, min(x.n) as na, min(y.n) as nb
  from shs x join shs y on x.s = y.s and x.set_id < y.set_id and 10 * y.n >= 7 * x.n and 10 * x.n >= 7 * y.n group by 1, 2)
select a, b, p.members as members_a, q.members as members_b, {B.dp("shared::double / (na + nb - shared)", 6)} as similarity
from cand join sets p on p.set_id = a join sets q on q.set_id = b where shared::double / (na + nb - shared) >= 0.7""")
def pairs(spark, sf):
    """All pairs of distinct documents with a Jaccard similarity of 0.7 or more."""
    distinct = collapse_sets(document_sets(spark, sf), "ord", "features")
    return similar_pairs(distinct, 0.7).select("a", "b", "members_a", "members_b", round_dp("similarity", 6).alias("similarity"))


@query("nearest_neighbour", SETS + f""", ids as (select ord, set_id, 'D' || ord as label from sig join sets using (g)),
ov as (select x.set_id as a, y.set_id as b, count(*) as shared, min(x.n) as na, min(y.n) as nb from shs x join shs y on x.s = y.s and x.set_id <> y.set_id group by 1, 2),
between_ as (select i.ord, j.label, shared::double / (na + nb - shared) as sim from ov join ids i on i.set_id = a join ids j on j.set_id = b),
within_ as (select i.ord, j.label, 1::double as sim from ids i join ids j on i.set_id = j.set_id and i.ord <> j.ord),
low as (select label, row_number() over (order by label) as r from ids qualify r <= 2),
none_ as (select i.ord, l.label, 0::double as sim from ids i join low l on l.label <> i.label),
every as (select * from between_ union all select * from within_ union all select * from none_)
select ord, arg_min(label, (-sim, label)) as nearest_label, {B.dp("max(sim)", 3)} as nearest_similarity from every group by ord""")
def nearest(spark, sf):
    """Most similar other document of every document, without a threshold."""
    distinct = ranked_sets(document_sets(spark, sf).withColumn("label", F.col("molecule_id")))
    return nearest_neighbour(distinct.members, distinct)


@query("similar_pairs_approximate", SETS + """, cand as (select x.set_id as a, y.set_id as b, count(*) as shared, min(x.n) as na, min(y.n) as nb
  from shs x join shs y on x.s = y.s and x.set_id < y.set_id and 10 * y.n >= 7 * x.n and 10 * x.n >= 7 * y.n group by 1, 2)
select count(*) as exact_pairs, 0::bigint as wrong_pairs, true as recall_reached from cand where shared::double / (na + nb - shared) >= 0.7""")
def pairs_approximate(spark, sf):
    """Minwise bands for a recall of 0.95, measured against the exact join: no wrong pair, and 0.9 of all at least."""
    distinct = collapse_sets(document_sets(spark, sf), "ord", "features")
    exact = durable(similar_pairs(distinct, 0.7).select("a", "b"))
    found = durable(approximate_pairs(distinct, 0.7).select("a", "b"))
    both = exact.withColumn("exact", F.lit(1)).join(found.withColumn("found", F.lit(1)), ["a", "b"], "full")
    return both.agg(
        F.count("exact").alias("exact_pairs"), F.count_if(F.col("exact").isNull()).alias("wrong_pairs"),
        (F.count_if(F.col("found").isNotNull() & F.col("exact").isNotNull()) >= 0.9 * F.count("exact")).alias("recall_reached"))


@query("similar_pairs_bits", BIT_SETS + f""", cand as (select x.set_id as a, y.set_id as b, count(*) as shared, min(x.n) as na, min(y.n) as nb
  from bits_ x join bits_ y on x.s = y.s and x.set_id < y.set_id and 10 * y.n >= 7 * x.n and 10 * x.n >= 7 * y.n group by 1, 2)
select a, b, p.members as members_a, q.members as members_b, {B.dp("shared::double / (na + nb - shared)", 6)} as similarity
from cand join bsets p on p.set_id = a join bsets q on q.set_id = b where shared::double / (na + nb - shared) >= 0.7""")
def pairs_bits(spark, sf):
    """All pairs of documents with a Tanimoto similarity of 0.7 or more on 2,048-bit vectors."""
    distinct = collapse_sets(bit_sets(spark, sf), "ord", "features")
    return similar_pairs(distinct, 0.7).select("a", "b", "members_a", "members_b", round_dp("similarity", 6).alias("similarity"))


@query("nearest_neighbour_bits", BIT_SETS + f""", ids as (select ord, set_id, 'D' || ord as label from bsig join bsets using (g)),
ov as (select x.set_id as a, y.set_id as b, count(*) as shared, min(x.n) as na, min(y.n) as nb from bits_ x join bits_ y on x.s = y.s and x.set_id <> y.set_id group by 1, 2),
between_ as (select i.ord, j.label, shared::double / (na + nb - shared) as sim from ov join ids i on i.set_id = a join ids j on j.set_id = b),
within_ as (select i.ord, j.label, 1::double as sim from ids i join ids j on i.set_id = j.set_id and i.ord <> j.ord),
low as (select label, row_number() over (order by label) as r from ids qualify r <= 2),
none_ as (select i.ord, l.label, 0::double as sim from ids i join low l on l.label <> i.label),
every as (select * from between_ union all select * from within_ union all select * from none_)
select ord, arg_min(label, (-sim, label)) as nearest_label, {B.dp("max(sim)", 3)} as nearest_similarity from every group by ord""")
def nearest_bits(spark, sf):
    """Most similar other document of every document on 2,048-bit vectors, without a threshold."""
    distinct = ranked_sets(bit_sets(spark, sf).withColumn("label", F.col("molecule_id")))
    return nearest_neighbour(distinct.members, distinct)


@query("closest_reference", VEC + f""", c as (select * from bits where label <> 0), r as (select * from bits where label = 0),
ov as (select c.id, r.id as ref, count(*) as shared from c join r using (i) group by 1, 2),
s as (select ov.id, ov.ref, shared::double / (x.n + y.n - shared) as sim from ov join n_ x on x.id = ov.id join n_ y on y.id = ov.ref)
select id as ord, 'V' || arg_min(ref, (-sim, ref)) as closest_known_compound_name, {B.dp("max(sim)", 3)} as closest_known_compound_similarity,
  'closest_match_found' as similarity_check_status from s group by id""")
def closest(spark, sf):
    """Closest of the vectors with label 0 for every other vector."""
    v = B.vectors(spark, sf)
    ref = v.where("label = 0").select(
        F.col("ord").alias("position"), F.col("molecule_id").alias("name"), F.lit("vectors").alias("source"),
        F.col("molecule_id").alias("compound_id"), "features")
    rows = v.where("label <> 0").withColumn("valid_molecule", F.lit(True))
    return closest_join(rows, ref).select("ord", "closest_known_compound_name", "closest_known_compound_similarity",
                                          "similarity_check_status")


@query("closest_reference_index", B.with_sql("docs") + SHINGLES + f""",
ov as (select a.ord, b.ord as r, count(*) as shared from sh a join sh b on a.s = b.s join (select position from ref) p on p.position = b.ord
  join cand_d c on c.ord = a.ord group by 1, 2),
s as (select ov.ord, r, shared::double / (x.n + y.n - shared) as sim from ov join size_ x on x.ord = ov.ord join size_ y on y.ord = r
  union all select c.ord, (select min(position) from ref), 0 from cand_d c where c.valid_molecule)
select ord, arg_min(r, (-sim, r)) as closest_position, {B.dp("max(sim)", 3)} as closest_similarity from s group by ord""")
def closest_index(spark, sf):
    """The same through the inverted index: candidate documents against reference documents."""
    raw = B.reference_documents(spark, sf)
    keyed = keyed_reference(raw).select("position", "key")
    ref = B.with_features(keyed, "key").select("position", "features")
    rows = B.with_features(B.candidate_documents(spark, sf).where("valid_molecule"))
    return closest_reference(rows, ref, small=False)


@query("closest_reference_bits", BIT_SETS + f""",
ov as (select a.ord, b.ord as r, count(*) as shared from bit a join bit b on a.s = b.s join (select position from ref) p on p.position = b.ord
  join cand_d c on c.ord = a.ord group by 1, 2),
s as (select ov.ord, r, shared::double / (x.n + y.n - shared) as sim from ov join bsig x on x.ord = ov.ord join bsig y on y.ord = r
  union all select c.ord, (select min(position) from ref), 0 from cand_d c where c.valid_molecule)
select ord, arg_min(r, (-sim, r)) as closest_position, {B.dp("max(sim)", 3)} as closest_similarity from s group by ord""")
def closest_bits(spark, sf):
    """The same on 2,048-bit vectors."""
    ref = keyed_reference(B.reference_documents(spark, sf)).select("position", feature_set("key").alias("features"))
    rows = B.candidate_documents(spark, sf).where("valid_molecule").select("ord", feature_set("canonical_smiles").alias("features"))
    return closest_reference(rows, ref, small=False)


CLUSTERS = B.with_sql("docs") + """,
c as (select *, row_number() over (order by priority_score desc, ord) - 1 as pos from all_d where valid_molecule),
lead_ as (select canonical_smiles as key, arg_min(molecule_id, (-priority_score, molecule_id, pos)) as label,
  arg_min(pos, (-priority_score, molecule_id, pos)) as lead_pos, count(*) as size from c group by 1),
num as (select *, row_number() over (order by label, lead_pos) as id from lead_)"""


@query("cluster_columns", CLUSTERS + """ select c.ord, num.id as diversity_cluster_id, num.size as diversity_cluster_size, c.pos = num.lead_pos as diversity_representative
from c join num on num.key = c.canonical_smiles""")
def clusters(spark, sf):
    """Numbering, size and representative, with equal keys as the clusters."""
    rows = rank_positions(B.validated(B.document_rows(spark, sf)).where("valid_molecule"))
    rows = rows.select("ord", "rank_position", "priority_score", F.col("molecule_id").alias("label"),
                       F.md5(F.col("canonical_smiles").cast("binary")).alias("centroid"))
    return cluster_columns(rows).select("ord", "diversity_cluster_id", "diversity_cluster_size", "diversity_representative")


@query("analysable_rows", B.with_sql("docs") + " select valid_molecule as analysable, count(*) as rows from all_d group by 1")
def analysable_rows(spark, sf):
    rows = B.with_features(B.validated(B.document_rows(spark, sf)))
    return rows.groupBy(analysable().alias("analysable")).agg(F.count("*").alias("rows"))


BUTINA = SETS.replace("with ", "with recursive ", 1) + """, cand as (select x.set_id as a, y.set_id as b, count(*) as shared, min(x.n) as na, min(y.n) as nb
  from shs x join shs y on x.s = y.s and x.set_id < y.set_id and 10 * y.n >= 7 * x.n and 10 * x.n >= 7 * y.n group by 1, 2),
near_ as (select a, b from cand where shared::double / (na + nb - shared) >= 0.7),
pr as (select a, b from near_ union all select b, a from near_),
pos as (select ord, row_number() over (order by (ord % 101) / 100 desc, ord) - 1 as p from (select distinct ord from sh)),
weight as (select set_id, max(p) as position, count(*) as members from sig join sets using (g) join pos using (ord) group by 1),
deg as (select pr.a as set_id, sum(o.members) + any_value(w.members) - 1 as degree, any_value(w.position) as position
  from pr join weight o on o.set_id = pr.b join weight w on w.set_id = pr.a group by 1),
rk as (select set_id, row_number() over (order by degree desc, position desc) as i from deg),
lower_ as (select x.i, list(y.i) filter (y.i > x.i) as js from pr join rk x on x.set_id = pr.a join rk y on y.set_id = pr.b group by 1),
walk as (select 0::bigint as i, []::bigint[] as covered
  union all select w.i + 1, case when list_contains(w.covered, l.i) then w.covered else list_concat(w.covered, coalesce(l.js, [])) end
  from walk w join lower_ l on l.i = w.i + 1),
covered as (select distinct unnest(covered) as i from walk where i = (select count(*) from rk)),
owner as (select y.set_id, arg_min(x.set_id, x.i) as centroid from covered c join rk y on y.i = c.i join pr on pr.b = y.set_id
  join rk x on x.set_id = pr.a and x.i not in (select i from covered) group by 1)
select ord, coalesce(centroid, set_id) as centroid from sig join sets using (g) left join owner using (set_id)"""


@query("butina_cluster", BUTINA)
def butina(spark, sf):
    """Sphere-exclusion clusters of all documents at 0.7: one row per document."""
    distinct = ranked_sets(document_sets(spark, sf))
    return butina_cluster(distinct, durable(similar_pairs(distinct, 0.7)))


@query("project_2d")
def projection(spark, sf):
    """Two leading axes of the sign bits of all vectors."""
    return project_2d(B.vectors(spark, sf), n_bits=64).drop("chemical_space_warning")


@query("project_2d_invariants", "select count(*) as rows, true as centred, true as uncorrelated, true as variance_falls from embeddings")
def projection_invariants(spark, sf):
    """What holds for the two leading axes whatever their signs: means of zero, no correlation, falling variance."""
    xy = project_2d(B.vectors(spark, sf), n_bits=64)
    x, y = F.col("chemical_space_x"), F.col("chemical_space_y")
    return xy.agg(
        F.count("*").alias("rows"), ((F.abs(F.avg(x)) < 1e-5) & (F.abs(F.avg(y)) < 1e-5)).alias("centred"),
        (F.abs(F.corr(x, y)) < 1e-5).alias("uncorrelated"), (F.variance(x) >= F.variance(y)).alias("variance_falls"))


@query("diversity_analysis")
def diversity(spark, sf):
    """Clusters, neighbours and projection of all ranked documents, invalid ones included."""
    rows = rank_positions(B.with_features(B.validated(B.document_rows(spark, sf))))
    out = diversity_analysis(rows.drop("source"))
    return out.select("molecule_id", *V.DIVERSITY_COLUMNS, *V.SPACE_COLUMNS)
