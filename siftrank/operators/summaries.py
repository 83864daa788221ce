"""Summaries of a result table: one aggregation pass each, no row leaves the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.numbers import iso_text, is_true, round_dp, to_number, utc_seconds
from siftrank.functions.text import filled, strip, title_label
from siftrank.operators.review import review_text



def value_counts(df: DataFrame, column: str, position: str = "rank_position") -> DataFrame:
    """``(value, rows, first_seen)`` per non-blank value."""
    return (
        df.where(filled(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("rows"), F.min(position).alias("first_seen"))
    )


def counts_text(df: DataFrame, column: str, empty: str, position: str = "rank_position",
                name: str = "summary") -> DataFrame:
    """One row: ``value: n`` per value, in order of first appearance."""
    counts = value_counts(df, column, position)
    entries = F.sort_array(F.collect_list(F.struct("first_seen", "value", "rows")))
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e["value"], F.lit(": "), e["rows"].cast("string"))), ", "
    )
    return counts.agg(F.coalesce(filled(text), F.lit(empty)).alias(name))


def mode_label(df: DataFrame, column: str, position: str = "rank_position", name: str = "mode") -> DataFrame:
    """Most frequent non-blank value; ties go to the value seen first."""
    counts = value_counts(df, column, position)
    return counts.agg(
        F.max_by("value", F.struct("rows", (-F.col("first_seen")).alias("back"))).alias(name)
    )


def _single(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(b), parts)


def _matches() -> list[Column]:
    similarity = to_number("closest_known_compound_similarity")
    analog = is_true("chembl_exact_match") | is_true("chembl_similarity_match")
    return [
        F.count_if(is_true("known_compound_match")).alias("exact_matches"),
        F.count_if(is_true("pubchem_exact_match")).alias("identity_matches"),
        F.count_if(analog).alias("bioactivity_matches"),
        F.count_if(is_true("patent_public_evidence_match")).alias("document_signals"),
        F.count_if(similarity >= V.HIGH_SIMILARITY).alias("high_similarity"),
        *_clusters(),
    ]


def _clusters() -> list[Column]:
    return [
        F.count_distinct("diversity_cluster_id").alias("cluster_count"),
        F.coalesce(F.max("diversity_cluster_size"), F.lit(0)).alias("largest_cluster"),
    ]


def _details(df: DataFrame, position: str) -> list[DataFrame]:
    top = mode_label(df, "evidence_summary_category", position).select(
        title_label("mode").alias("top_category")
    )
    return [
        counts_text(df, "pubchem_lookup_status", "Public lookup not run", position, "identity_detail"),
        counts_text(df, "chembl_lookup_status", "ChEMBL lookup not run", position, "bioactivity_detail"),
        counts_text(df, "patent_lookup_status", "Patent-context lookup not run", position, "document_detail"),
        counts_text(df, "evidence_summary_category", "No evidence synthesis available", position,
                    "category_detail"),
        top,
        review_text(df),
    ]


def context_summary(df: DataFrame, position: str = "rank_position") -> DataFrame:
    """Match counts, lookup breakdowns, reviews, similarity and cluster figures; one row."""
    similarity = to_number("closest_known_compound_similarity")
    mean = F.avg(similarity.cast("decimal(28,9)"))
    figures = df.agg(
        *_matches(),
        F.count_if(~is_true("known_compound_match")).alias("no_exact_matches"),
        F.count(similarity).alias("similarity_count"),
        F.coalesce(F.format_string("%.3f", F.round(mean, 3).cast("double")), F.lit(V.NOT_AVAILABLE))
        .alias("_mean"),
    ).withColumn(
        "average_similarity",
        F.when(F.col("similarity_count") > 0, F.col("_mean")).otherwise(V.NOT_AVAILABLE),
    ).drop("_mean")
    return _single([figures, *_details(df, position)])


def report_summary(df: DataFrame, position: str = "rank_position", job_id: str | None = None) -> DataFrame:
    """Job, totals, valid and high-priority rows, matches, signals, reviews and clusters; one row."""
    figures = df.agg(
        F.lit(job_id or V.NOT_AVAILABLE).alias("job_id"),
        F.count("*").alias("total_rows"),
        F.count_if(is_true("valid_molecule")).alias("valid_rows"),
        F.count_if(F.coalesce("priority_score", F.lit(0.0)) >= V.HIGH_PRIORITY).alias("high_priority"),
        *_matches(),
    )
    return _single([figures, *_details(df, position)])


def run_summary(df: DataFrame, position: str = "rank_position", completed_at: str | None = None) -> DataFrame:
    """Totals, completion time, model, docking and complexity summary of a run; no row for an empty run."""
    rows = F.count("*")
    available = F.count_if(F.col("bbb_model_status") == "model_available")
    provided = F.count_if(F.col("docking_status") == "provided")
    invalid = F.count_if(F.col("docking_status") == "invalid_docking_score")
    figures = df.agg(
        rows.alias("total_rows"),
        F.lit(completed_at or "").alias("completed_at"),
        F.count_if(is_true("valid_molecule")).alias("valid_rows"),
        F.count_if(F.coalesce("priority_score", F.lit(0.0)) >= V.HIGH_PRIORITY).alias("high_priority"),
        F.when(available > 0, "Available").otherwise("Unavailable").alias("model_summary"),
        F.format_string("%d available, %d unavailable", available, rows - available).alias("model_detail"),
        F.format_string("%d provided", provided).alias("docking_summary"),
        F.format_string("%d not provided, %d invalid", rows - provided - invalid, invalid).alias("docking_detail"),
    )
    rated = df.where(F.col("synthetic_feasibility_category") != "not_available")
    parts = counts_text(rated, "synthetic_feasibility_category", V.NOT_AVAILABLE, position, "complexity_summary")
    none = F.when(F.col("complexity_summary") == V.NOT_AVAILABLE, V.NO_COMPLEXITY).otherwise("")
    return _single([figures, parts]).where(F.col("total_rows") > 0).withColumn("complexity_detail", none)


def cluster_summary(df: DataFrame) -> DataFrame:
    """Clusters, largest size and representatives, with the display text; one row."""
    figures = df.agg(
        F.count("*").alias("_rows"), *_clusters(),
        F.count_if(is_true("diversity_representative")).alias("representatives"),
    )
    text = (
        F.when(F.col("_rows") == 0, V.NOT_AVAILABLE)
        .when(F.col("cluster_count") == 0, "No diversity clusters available")
        .otherwise(F.format_string("%d clusters, largest cluster %d, %d representatives",
                                   "cluster_count", "largest_cluster", "representatives"))
    )
    return figures.withColumn("diversity_summary", text).drop("_rows")


def space_summary(df: DataFrame) -> DataFrame:
    """Plotted and skipped rows, clusters and reviewed rows among the plotted; one row."""
    plotted = to_number("chemical_space_x").isNotNull() & to_number("chemical_space_y").isNotNull()
    kept = F.col("review_status").isin("selected", "watchlist")
    return df.agg(
        F.count_if(plotted).alias("plotted"),
        F.count_if(F.col("chemical_space_status") == "not_run_invalid_molecule").alias("skipped"),
        F.count_distinct(F.when(plotted, F.col("diversity_cluster_id"))).alias("plotted_clusters"),
        F.count_if(plotted & kept).alias("plotted_selected"),
    )


def status_values(df: DataFrame, column: str, name: str = "status_values") -> DataFrame:
    """Sorted distinct non-blank statuses of a table, joined by ``"; "``; one row."""
    return df.agg(_status_list(column, "; ").alias(name))


def _status_list(column: str, separator: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(filled(strip(column)))), separator)


SOURCES = {
    "identity": ("pubchem_lookup_status", "pubchem_warning", V.IDENTITY_DONE),
    "bioactivity": ("chembl_lookup_status", "chembl_warning", V.BIOACTIVITY_DONE),
    "document": ("patent_lookup_status", "patent_warning", V.DOCUMENT_DONE),
}


def source_status(df: DataFrame, source: str, by: list[str] | None = None) -> DataFrame:
    """Status of one lookup over a run: completed, failed (with all warnings) or not requested."""
    status, warning, done = SOURCES[source]
    text = strip(status)
    ok, failed = _any(text.isin(*done)), _any(text == "lookup_failed")
    reduced = df.groupBy(*(by or [])).agg(
        ok.alias("_ok"), failed.alias("_failed"), _status_list(warning, "; ").alias("_warnings")
    )
    lost = ~F.col("_ok") & F.col("_failed")
    return reduced.select(
        *(by or []),
        F.lit(source).alias("source"),
        F.when(F.col("_ok"), "lookup_completed").when(lost, "lookup_failed")
        .otherwise("not_requested").alias("status"),
        F.when(F.col("_ok"), iso_text(utc_seconds())).otherwise("").alias("last_successful_lookup"),
        F.when(lost, F.col("_warnings")).otherwise("").alias("error_message"),
    )


def source_statuses(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """:func:`source_status` of all three lookups, one row each (for each ``by``)."""
    return reduce(DataFrame.unionByName, [source_status(df, source, by) for source in SOURCES])


def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def run_rollup(df: DataFrame, job_id: str = "job_id") -> DataFrame:
    """Per run: statuses per source and whether lookups, the model and placeholders were used."""
    lookups = [status for status, _, _ in SOURCES.values()]
    requested = reduce(
        lambda a, b: a | b,
        [_any(filled(strip(c)).isNotNull() & (strip(c) != "not_requested")) for c in lookups],
    )
    model = filled(strip("bbb_model_status"))
    available = _any(model == "model_available")
    return df.groupBy(job_id).agg(
        F.when(available, "model_available").otherwise("model_unavailable").alias("actual_bbb_model_status"),
        _status_list("bbb_model_status", "; ").alias("bbb_model_status_values"),
        (_any(model != "model_available") | ~available).alias("fallback_placeholder_used"),
        requested.alias("public_lookup_requested"),
        *[_status_list(c, "; ").alias(f"{c}_values") for c in lookups],
        F.count("*").alias("row_count"),
    )


def distinct_warnings(df: DataFrame) -> DataFrame:
    """Sorted distinct warnings of rows whose model was unavailable."""
    return (
        df.where((F.col("bbb_model_status") == "model_unavailable") & filled(strip("bbb_warning")).isNotNull())
        .select("bbb_warning").distinct().orderBy("bbb_warning")
    )


def padded_range(df: DataFrame, column: str) -> DataFrame:
    """``(low, high)`` of a column widened by 8 %; ±1 around a single value; [-1, 1] if empty."""
    x = to_number(column)
    span = df.agg(F.min(x).alias("_min"), F.max(x).alias("_max"))
    pad = F.when(F.col("_min") == F.col("_max"), 1.0).otherwise((F.col("_max") - F.col("_min")) * 0.08)
    return span.select(
        F.coalesce(F.col("_min") - pad, F.lit(-1.0)).alias("low"),
        F.coalesce(F.col("_max") + pad, F.lit(1.0)).alias("high"),
    )


def scale_linear(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Linear rescale; the middle of the target on an empty source range."""
    share = (value - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(to_low + share * (to_high - to_low), F.lit((to_low + to_high) / 2.0))


def plot_points(df: DataFrame, width: float = 100.0) -> DataFrame:
    """Plottable rows with both coordinates scaled to ``[0, width]``."""
    names = ("chemical_space_x", "chemical_space_y")
    for name in names:
        span = padded_range(df, name).toDF(f"_{name}_low", f"_{name}_high")
        df = df.crossJoin(F.broadcast(span))
    scaled = {
        f"plot_{name[-1]}": round_dp(
            scale_linear(F.col(name), F.col(f"_{name}_low"), F.col(f"_{name}_high"), 0.0, width), 3)
        for name in names
    }
    spans = [f"_{name}_{end}" for name in names for end in ("low", "high")]
    return df.withColumns(scaled).drop(*spans)
