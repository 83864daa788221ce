"""Text clean-up and report formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank import vocab as V
from siftrank.functions.numbers import col, number_text


def strip(value: Column | str) -> Column:
    return F.regexp_replace(col(value).cast("string"), r"^\s+|\s+$", "")


def filled(value: Column | str) -> Column:
    """The text itself, or NULL when it is NULL or empty."""
    return F.nullif(col(value).cast("string"), F.lit(""))


def first_filled(*values: Column | str) -> Column:
    return F.coalesce(*[filled(v) for v in values])


def title_label(value: Column | str) -> Column:
    """``some_status_text`` → ``Some Status Text``; inner capitals stay as they are."""
    words = F.filter(F.split(col(value).cast("string"), "_"), lambda w: w != "")
    cased = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return F.coalesce(
        F.when(filled(value).isNotNull(), F.array_join(cased, " ")), F.lit(V.NOT_AVAILABLE)
    )


def safe_filename(value: Column | str) -> Column:
    """A name usable as a file name: at most 80 of ``A-Za-z0-9._-``."""
    text = F.regexp_replace(strip(value), "[^A-Za-z0-9._-]+", "-")
    text = F.regexp_replace(text, "^-+|-+$", "")
    return F.coalesce(filled(F.substring(text, 1, V.FILENAME_LIMIT)), F.lit("compound"))


def plain_text(value: Column | str, data_type: T.DataType | None = None) -> Column:
    """Text of a value as results are printed: True/False, plain decimals."""
    c = col(value)
    if isinstance(data_type, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return number_text(c)
    return c.cast("string")


def detail_text(value: Column | str, data_type: T.DataType | None = None) -> Column:
    """Printed value, or the placeholder when NULL or blank."""
    return F.coalesce(filled(plain_text(value, data_type)), F.lit(V.NOT_AVAILABLE))


def md_value(value: Column | str, data_type: T.DataType | None = None) -> Column:
    return F.replace(detail_text(value, data_type), F.lit("\n"), F.lit(" "))


def md_line(label: str, value: Column | str, data_type: T.DataType | None = None) -> Column:
    """One bullet line of a report."""
    return F.concat(F.lit(f"- **{label}:** "), md_value(value, data_type))


def csv_cell(value: Column | str, data_type: T.DataType | None = None) -> Column:
    """Quoted CSV cell: quotes doubled, line breaks become spaces, NULL is empty."""
    text = F.coalesce(plain_text(value, data_type), F.lit(""))
    text = F.replace(F.replace(text, F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), text, F.lit('"'))


def clean_annotation(status: Column | str, note: Column | str) -> Column:
    """Struct ``(review_status, review_note)``: known status, note of at most 500 characters."""
    state = F.lower(strip(status))
    return F.struct(
        F.when(state.isin(*V.REVIEW_STATUSES), state).otherwise("unreviewed").alias("review_status"),
        F.substring(F.coalesce(strip(note), F.lit("")), 1, V.NOTE_LIMIT).alias("review_note"),
    )


def review_label(status: Column | str) -> Column:
    pairs = [F.lit(x) for kv in V.REVIEW_LABELS.items() for x in kv]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), col(status)), F.lit(V.REVIEW_LABELS["unreviewed"])
    )


def values_differ(a: Column | str, b: Column | str) -> Column:
    """Trimmed texts differ; NULL equals the empty text."""
    return F.coalesce(strip(a), F.lit("")) != F.coalesce(strip(b), F.lit(""))
