"""Lookup joins against snapshot tables, with a result cache and a similarity waterfall."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftrank import vocab as V
from siftrank.functions.numbers import round_dp
from siftrank.functions.payloads import document_url, preferred_name
from siftrank.functions.text import filled, first_filled, strip
from siftrank.operators.joins import attach_counted, attach_per_key
from siftrank.operators.similarity import collapse_sets, similar_between
from siftrank.options import RunOptions
from siftrank.schemas import LOOKUP_RESULTS, column_type
from siftrank.session import durable

#: Hashes of keys that several rows have, which are broadcast.
MOST_COPIED = 1 << 20

CACHE_STATUS = {
    "identity": "pubchem_cache_status",
    "bioactivity": "chembl_cache_status",
    "document": "patent_cache_status",
}
LOOKUP_STATUS = {
    "identity": "pubchem_lookup_status",
    "bioactivity": "chembl_lookup_status",
    "document": "patent_lookup_status",
}
# Fixed values of a lookup that did not run: (source of the default, column, value).
NOT_REQUESTED = {
    "identity": {
        "pubchem_exact_match": False, "pubchem_lookup_status": "not_requested",
        "pubchem_cache_status": "not_used", "pubchem_warning": "Public lookup was not requested.",
    },
    "bioactivity": {
        "chembl_exact_match": False, "chembl_lookup_status": "not_requested",
        "chembl_cache_status": "not_used", "chembl_warning": "ChEMBL lookup was not requested.",
        "chembl_similarity_match": False, "chembl_similarity_status": "not_requested",
    },
    "document": {
        "patent_lookup_status": "not_requested", "patent_cache_status": "not_used",
        "patent_public_evidence_match": False,
        "patent_warning": "Patent-context lookup was not requested.",
    },
}
INVALID_ROW = {
    "identity": {
        **NOT_REQUESTED["identity"], "pubchem_lookup_status": "not_run_invalid_molecule",
        "pubchem_warning": "Public lookup skipped for invalid molecule.",
    },
    "bioactivity": {
        **NOT_REQUESTED["bioactivity"], "chembl_lookup_status": "not_run_invalid_molecule",
        "chembl_warning": "ChEMBL lookup skipped for invalid molecule.",
        "chembl_similarity_status": "not_run_invalid_molecule",
    },
    "document": {
        **NOT_REQUESTED["document"], "patent_lookup_status": "not_run_invalid_molecule",
        "patent_source": V.DOCUMENT_SOURCE,
        "patent_warning": "Patent-context lookup skipped for invalid molecule.",
    },
}


def fixed_result(source: str, values: dict[str, object]) -> Column:
    """Result struct of one source from constants; everything not named is NULL."""
    return F.struct(*[
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in LOOKUP_RESULTS[source].fields
    ])


def not_requested(df: DataFrame, source: str) -> DataFrame:
    """Literal columns of a lookup that is switched off."""
    return df.withColumns({
        f.name: F.lit(NOT_REQUESTED[source].get(f.name)).cast(f.dataType)
        for f in LOOKUP_RESULTS[source].fields
    })


def _shaped(df: DataFrame, source: str, values: dict[str, object]) -> DataFrame:
    """``(identity_key, result)`` from columns or constants."""
    fields = []
    for f in LOOKUP_RESULTS[source].fields:
        value = values.get(f.name)
        column = value if isinstance(value, Column) else F.lit(value)
        fields.append(column.cast(f.dataType).alias(f.name))
    return df.select("identity_key", F.struct(*fields).alias("result"))


@dataclass(frozen=True)
class LookupTables:
    """Snapshot tables and caches of the lookups; only those switched on are needed."""

    compounds: DataFrame | None = None
    molecules: DataFrame | None = None
    activities: DataFrame | None = None
    chemicals: DataFrame | None = None
    documents: DataFrame | None = None
    identity_cache: DataFrame | None = None
    bioactivity_cache: DataFrame | None = None
    document_cache: DataFrame | None = None


# ---- one fetch per source ---------------------------------------------------


def lookup_identity(keys: DataFrame, compounds: DataFrame) -> DataFrame:
    """Fresh identity results of distinct keys.

    ``compounds(identity_key, ord, cid, title, systematic)``; the first compound
    of a key by ``ord`` counts.
    """
    first = compounds.groupBy("identity_key").agg(
        F.min_by(F.struct("cid", preferred_name("title", "systematic").alias("name")), "ord").alias("c")
    )
    joined = keys.select("identity_key").join(first, "identity_key", "left")
    hit = F.col("c").isNotNull()
    return _shaped(joined, "identity", {
        "pubchem_exact_match": hit,
        "pubchem_cid": F.col("c.cid"),
        "pubchem_preferred_name": F.col("c.name"),
        "pubchem_lookup_status": F.when(hit, "exact_match").otherwise("no_exact_match"),
        "pubchem_cache_status": "fresh_lookup",
        "pubchem_warning": "",
    })


def activity_summary(activities: DataFrame, molecule: str = "molecule_id", target: str = "target_name") -> DataFrame:
    """``(molecule_id, activity_count, target_count, target_summary)``.

    Records are counted per (molecule, target) first, so a molecule with very
    many records is small before it is gathered; only its first five target
    names are ever collected.
    """
    per_target = (
        activities.withColumn("_target", filled(strip(target)))
        .groupBy(molecule, "_target").agg(F.count("*").alias("_n"))
    )
    totals = per_target.groupBy(molecule).agg(
        F.sum("_n").alias("activity_count"), F.count("_target").alias("target_count")
    )
    by_name = Window.partitionBy(molecule).orderBy("_target")
    shown = (
        per_target.where(F.col("_target").isNotNull())
        .withColumn("_rank", F.row_number().over(by_name)).where(F.col("_rank") <= V.TARGETS_SHOWN)
        .groupBy(molecule)
        .agg(F.array_join(F.sort_array(F.collect_list("_target")), "; ").alias("target_summary"))
    )
    return totals.join(shown, molecule, "left").select(
        F.col(molecule).alias("molecule_id"), "activity_count", "target_count", "target_summary"
    )


def lookup_bioactivity(
    keys: DataFrame, molecules: DataFrame, activities: DataFrame, threshold: float = V.LOOKUP_SIMILARITY,
) -> DataFrame:
    """Fresh bioactivity results: exact match, else most similar molecule, else none.

    ``keys(identity_key, ord, features)``, ``molecules(identity_key, ord,
    molecule_id, pref_name, features)``, ``activities(molecule_id,
    target_name)``.  Only keys without an exact match enter the similarity
    join; equal similarity goes to the first molecule by ``ord``.
    """
    first = molecules.groupBy("identity_key").agg(
        F.min_by(F.struct("molecule_id", "pref_name"), "ord").alias("m")
    )
    summary = durable(activity_summary(activities))
    exact = keys.select("identity_key").join(first, "identity_key").select(
        "identity_key", "m.molecule_id", "m.pref_name", F.lit(None).cast("double").alias("similarity")
    )
    missed = keys.join(first, "identity_key", "left_anti")
    similar = durable(_most_similar(missed, molecules, threshold))
    unmatched = missed.join(similar, "identity_key", "left_anti")

    def found(df: DataFrame, is_exact: bool) -> DataFrame:
        rows = df.join(summary, "molecule_id", "left")
        prefix = "" if is_exact else "similarity_"
        return _shaped(rows, "bioactivity", {
            "chembl_exact_match": is_exact,
            f"chembl_{prefix}molecule_id": F.col("molecule_id"),
            f"chembl_{prefix}pref_name": F.col("pref_name"),
            "chembl_lookup_status": "exact_match" if is_exact else "similarity_match",
            "chembl_cache_status": "fresh_lookup",
            "chembl_warning": "",
            "chembl_activity_count": F.coalesce("activity_count", F.lit(0)),
            "chembl_target_count": F.coalesce("target_count", F.lit(0)),
            "chembl_target_summary": F.col("target_summary"),
            "chembl_similarity_match": not is_exact,
            "chembl_similarity_score": round_dp("similarity", 3),
            "chembl_similarity_status": "not_run_exact_match_found" if is_exact else "similarity_match",
        })

    none = _shaped(unmatched, "bioactivity", {
        "chembl_exact_match": False, "chembl_lookup_status": "no_match",
        "chembl_cache_status": "fresh_lookup", "chembl_warning": "", "chembl_activity_count": 0,
        "chembl_target_count": 0, "chembl_similarity_match": False, "chembl_similarity_status": "no_match",
    })
    return found(exact, True).unionByName(found(similar, False)).unionByName(none)


def _most_similar(keys: DataFrame, molecules: DataFrame, threshold: float) -> DataFrame:
    left = collapse_sets(keys.select("identity_key", "ord", "features"), "ord", "features")
    right = collapse_sets(
        molecules.where(F.col("identity_key").isNotNull()).select("ord", "molecule_id", "pref_name", "features"),
        "ord", "features",
    )
    same = left.sets.select("set_id", "n", "features")
    pairs = similar_between(same, right.sets, threshold)
    best = pairs.groupBy("a").agg(
        F.max("similarity").alias("similarity"),
        F.min_by("b", F.struct((-F.col("similarity")).alias("s"), "b")).alias("b"),
    )
    # The id of a set is its first row by ord, which is also the row that wins ties.
    named = right.members.where(F.col("ord") == F.col("set_id")).select(
        F.col("set_id").alias("b"), "molecule_id", "pref_name"
    )
    sizes = left.sets.select(F.col("set_id"), "members")
    picked = attach_counted(best, named, ["b"], "inner").select(F.col("a").alias("set_id"), "molecule_id", "pref_name", "similarity")
    per_set = sizes.join(picked, "set_id")
    return attach_per_key(left.members, per_set, ["set_id"], "members", how="inner").select(
        "identity_key", "molecule_id", "pref_name", "similarity"
    )


def lookup_documents(
    keys: DataFrame, chemicals: DataFrame, documents: DataFrame, base_url: str = V.DOCUMENT_BASE_URL,
) -> DataFrame:
    """Fresh document results over two hops: key → chemical → documents.

    ``keys(identity_key, cid, molecule_id)``, ``chemicals(identity_key, ord,
    chemical_id)``, ``documents(chemical_id, pos, doc_id, title)``.  Documents
    are reduced to one row per chemical before the join.
    """
    first = chemicals.groupBy("identity_key").agg(
        F.min_by(F.struct(F.trim(F.coalesce("chemical_id", F.lit(""))).alias("id")), "ord").alias("c")
    )
    per_chemical = documents.groupBy("chemical_id").agg(
        F.count("*").alias("hits"), F.min_by(F.struct("doc_id", "title"), "pos").alias("top")
    )
    # Keys without a chemical, the common case, get many different join keys.
    nowhere = F.concat(F.lit("\u0000"), F.pmod(F.hash("identity_key"), F.lit(997)).cast("string"))
    joined = (
        keys.join(first, "identity_key", "left")
        .withColumn("chemical_id", filled("c.id"))
        .withColumn("_chemical", F.coalesce("chemical_id", nowhere))
        .join(per_chemical.withColumnRenamed("chemical_id", "_chemical"), "_chemical", "left")
    )
    has_id = F.col("chemical_id").isNotNull()
    hits = F.coalesce("hits", F.lit(0))
    composite = F.concat(
        F.lit("surechembl_chemical_id:"), F.col("chemical_id"), F.lit("|smiles:"), F.col("identity_key"),
        F.lit("|pubchem_cid:"), F.coalesce("cid", F.lit("")),
        F.lit("|chembl_id:"), F.coalesce("molecule_id", F.lit("")),
    )
    return _shaped(joined, "document", {
        "patent_lookup_status": F.when(hits > 0, "match_found").otherwise("no_match"),
        "patent_cache_status": "fresh_lookup",
        "patent_public_evidence_match": hits > 0,
        "patent_source": V.DOCUMENT_SOURCE,
        "patent_record_count": hits,
        "patent_top_record_id": F.col("top.doc_id"),
        "patent_top_record_title": F.col("top.title"),
        "patent_top_record_url": document_url(F.col("top.doc_id"), base_url),
        "patent_query_identifier": F.when(has_id, composite).otherwise(F.col("identity_key")),
        "patent_warning": F.when(F.col("c").isNotNull() & ~has_id, V.CHEMICAL_WITHOUT_ID).otherwise(""),
    })


# ---- cache and row join -----------------------------------------------------


def cache_split(
    keys: DataFrame, cache: DataFrame, source: str, retry_failed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(hits(identity_key, result), misses)`` for distinct keys.

    ``cache(identity_key, cached_at, result)``: the latest entry of a key
    counts.  Failures stay cached unless ``retry_failed``.
    """
    latest = cache.groupBy("identity_key").agg(F.max_by("result", "cached_at").alias("result"))
    if retry_failed:
        latest = latest.where(F.col("result")[LOOKUP_STATUS[source]] != "lookup_failed")
    hits = latest.join(keys.select("identity_key"), "identity_key", "left_semi").withColumn(
        "result", F.col("result").withField(CACHE_STATUS[source], F.lit("cache_hit"))
    )
    return hits, keys.join(latest, "identity_key", "left_anti")


def distinct_keys(rows: DataFrame, extra: list[str] | None = None, ordinal: str = "ord") -> DataFrame:
    """One row per usable key, with the columns of its first row."""
    usable = rows.where(F.coalesce("valid_molecule", F.lit(False)) & filled("canonical_smiles").isNotNull())
    keyed = usable.withColumn("identity_key", F.col("canonical_smiles"))
    names = list(dict.fromkeys([ordinal, *(extra or [])]))

    def grouped(part: DataFrame) -> DataFrame:
        return part.groupBy("identity_key").agg(
            F.min_by(F.struct(*names), ordinal).alias("_row"), F.count("*").alias("uses")
        ).select("identity_key", "_row.*", "uses")

    if "features" not in names:
        return grouped(keyed)
    # Features are shuffled only for keys that several rows may have (equal hashes); the other rows are keys themselves.
    hashed = F.xxhash64("identity_key")
    copied = durable(keyed.groupBy(hashed.alias("_hash")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_hash"))
    if copied.count() > MOST_COPIED:
        return grouped(keyed)
    copied, same = F.broadcast(copied), hashed == F.col("_hash")
    own = [F.when(F.col(ordinal).isNotNull(), F.col(c)).alias(c) for c in names]  # as min_by has it
    single = keyed.join(copied, same, "left_anti").select("identity_key", *own, F.lit(1).cast("bigint").alias("uses"))
    return grouped(keyed.join(copied, same, "left_semi")).unionByName(single)


def attach_results(rows: DataFrame, per_key: DataFrame, sources: list[str]) -> DataFrame:
    """Add the columns of the looked-up sources to every row in one join.

    ``per_key(identity_key, uses, <source>…)`` holds one result struct per
    source; ``uses`` tells how many rows share the key, so a key of very many
    rows is broadcast instead of shuffled.  Invalid rows get the fixed values
    and are spread over partitions.
    """
    usable = F.coalesce("valid_molecule", F.lit(False)) & filled("canonical_smiles").isNotNull()
    nowhere = F.concat(F.lit("\u0000"), F.pmod(F.hash("ord"), F.lit(997)).cast("string"))
    keyed = rows.withColumn("identity_key", F.when(usable, F.col("canonical_smiles")).otherwise(nowhere))
    joined = attach_per_key(keyed, per_key.select("identity_key", "uses", *sources), ["identity_key"], "uses")
    results = [F.coalesce(s, fixed_result(s, INVALID_ROW[s])).alias(s) for s in sources]
    return joined.select(*rows.columns, *results).select(*rows.columns, *[f"{s}.*" for s in sources])


def identity_results(keys: DataFrame, compounds: DataFrame, cache: DataFrame | None = None,
                     retry_failed: bool = False) -> DataFrame:
    """``(identity_key, result)`` of distinct keys: cached ones first, then fresh ones."""
    hits, misses = _split(keys, cache, "identity", retry_failed)
    return _union(hits, lookup_identity(misses, compounds))


def bioactivity_results(keys: DataFrame, molecules: DataFrame, activities: DataFrame,
                        cache: DataFrame | None = None, threshold: float = V.LOOKUP_SIMILARITY,
                        retry_failed: bool = False) -> DataFrame:
    """The same for the bioactivity waterfall; ``keys`` carry ``features``."""
    hits, misses = _split(keys, cache, "bioactivity", retry_failed)
    return _union(hits, lookup_bioactivity(misses, molecules, activities, threshold))


def document_results(keys: DataFrame, chemicals: DataFrame, documents: DataFrame,
                     cache: DataFrame | None = None, base_url: str = V.DOCUMENT_BASE_URL,
                     retry_failed: bool = False) -> DataFrame:
    """The same for documents; ``keys`` carry the ids found by the earlier lookups."""
    hits, misses = _split(keys, cache, "document", retry_failed)
    return _union(hits, lookup_documents(misses, chemicals, documents, base_url))


def _with(rows: DataFrame, keys: DataFrame, results: DataFrame, source: str) -> DataFrame:
    per_key = keys.select("identity_key", "uses").join(
        results.withColumnRenamed("result", source), "identity_key"
    )
    return attach_results(rows, per_key, [source])


def with_identity(rows: DataFrame, compounds: DataFrame, cache: DataFrame | None = None,
                  retry_failed: bool = False) -> DataFrame:
    """Identity lookup of all rows."""
    keys = durable(distinct_keys(rows))
    return _with(rows, keys, identity_results(keys, compounds, cache, retry_failed), "identity")


def with_bioactivity(rows: DataFrame, molecules: DataFrame, activities: DataFrame,
                     cache: DataFrame | None = None, threshold: float = V.LOOKUP_SIMILARITY,
                     retry_failed: bool = False) -> DataFrame:
    """Bioactivity lookup of all rows; ``rows`` carry ``features``."""
    keys = durable(distinct_keys(rows, ["features"]))  # read by every branch of the waterfall
    found = bioactivity_results(keys, molecules, activities, cache, threshold, retry_failed)
    return _with(rows, keys, found, "bioactivity")


def with_documents(rows: DataFrame, chemicals: DataFrame, documents: DataFrame,
                   cache: DataFrame | None = None, base_url: str = V.DOCUMENT_BASE_URL,
                   retry_failed: bool = False) -> DataFrame:
    """Document lookup of all rows; takes the ids found by the earlier lookups along."""
    ids = rows.withColumns({
        "cid": F.col("pubchem_cid"),
        "molecule_id": first_filled("chembl_molecule_id", "chembl_similarity_molecule_id"),
    })
    keys = durable(distinct_keys(ids, ["cid", "molecule_id"]))
    return _with(rows, keys, document_results(keys, chemicals, documents, cache, base_url, retry_failed), "document")


def with_lookups(
    rows: DataFrame, tables: LookupTables, options: RunOptions, keyed: DataFrame | None = None
) -> DataFrame:
    """All requested lookups of a run.

    ``keyed`` is a stored table with the key columns (and ``features``) of the
    same rows, so that finding the distinct keys does not recompute ``rows``.

    Each source works on the distinct keys only and hands its ids to the next;
    the rows themselves are joined once, to all results together.  A source
    that is off adds constants and no join.
    """
    wanted = {
        "identity": options.wants_identity, "bioactivity": options.bioactivity_lookup,
        "document": options.document_lookup,
    }
    on = [s for s, requested in wanted.items() if requested]
    retry = options.retry_failed
    if on:
        source = rows if keyed is None else keyed
        keys = durable(distinct_keys(source, ["features"] if "features" in source.columns else None))
        narrow = keys.select("identity_key", "uses")
        cid = molecule = F.lit(None).cast("string")
        if "identity" in on:
            found = durable(identity_results(keys, tables.compounds, tables.identity_cache, retry))
            narrow = narrow.join(found.withColumnRenamed("result", "identity"), "identity_key")
            cid = F.col("identity.pubchem_cid")
        if "bioactivity" in on:
            found = durable(bioactivity_results(keys, tables.molecules, tables.activities, tables.bioactivity_cache,
                                                options.lookup_similarity, retry))
            narrow = narrow.join(found.withColumnRenamed("result", "bioactivity"), "identity_key")
            molecule = first_filled("bioactivity.chembl_molecule_id", "bioactivity.chembl_similarity_molecule_id")
        if "document" in on:
            ids = durable(narrow.select("identity_key", cid.alias("cid"), molecule.alias("molecule_id")))
            found = document_results(ids, tables.chemicals, tables.documents, tables.document_cache, retry_failed=retry)
            narrow = narrow.join(found.withColumnRenamed("result", "document"), "identity_key")
        rows = attach_results(rows, narrow, on)
    for source in wanted:
        if source not in on:
            rows = not_requested(rows, source)
    return rows


def _split(keys, cache, source, retry_failed):
    """Hits and misses of no cache, a table of entries, or a stored cache that reads only what it needs."""
    if cache is None:
        return None, keys
    if isinstance(cache, DataFrame):
        return cache_split(keys, cache, source, retry_failed)
    return cache.split(keys, source, retry_failed)


def _union(hits: DataFrame | None, fresh: DataFrame) -> DataFrame:
    return fresh if hits is None else hits.unionByName(fresh)


def failed_result(source: str, message: Column | str) -> Column:
    """Result struct of a lookup that raised: data, not an exception."""
    text = F.lit(message) if isinstance(message, str) else message
    values = {
        **INVALID_ROW[source], LOOKUP_STATUS[source]: "lookup_failed", CACHE_STATUS[source]: "cache_miss",
    }
    if source == "bioactivity":
        values["chembl_similarity_status"] = "lookup_failed"
    warning = {"identity": "pubchem", "bioactivity": "chembl", "document": "patent"}[source] + "_warning"
    return fixed_result(source, values).withField(warning, text.cast(column_type(warning)))
