"""Keys, validity and content features of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.numbers import col
from siftrank.functions.text import filled, first_filled, strip


def identity_key(text: Column | str) -> Column:
    """Normal form of a text: equal content gives an equal key, NULL if nothing is left."""
    return filled(F.regexp_replace(F.lower(strip(text)), r"\s+", " "))


def validity(raw: Column | str, key: Column | None = None) -> Column:
    """Struct ``(input_smiles, canonical_smiles, valid_molecule, error)``; errors are data.

    ``key`` is the normal form of ``raw`` (default: :func:`identity_key`); a
    non-blank row whose key is NULL is invalid but stays in the data.
    """
    text = F.coalesce(col(raw).cast("string"), F.lit(""))
    blank = strip(text) == ""
    usable = F.when(~blank, identity_key(text) if key is None else filled(key))
    error = F.when(blank, V.ERROR_EMPTY).when(usable.isNull(), V.ERROR_UNUSABLE)
    return F.struct(
        text.alias("input_smiles"),
        usable.alias("canonical_smiles"),
        usable.isNotNull().alias("valid_molecule"),
        error.cast("string").alias("error"),
    )


def lookup_key(key: Column | str) -> Column:
    """SHA-256 hex of the key's UTF-8 bytes."""
    return F.sha2(col(key).cast("binary"), 256)


def candidate_id(given: Column | str, ordinal: Column | str) -> Column:
    return F.coalesce(filled(given), F.concat(F.lit("mol_"), col(ordinal).cast("string")))


def row_label(molecule_id: Column | str, canonical: Column | str, raw: Column | str) -> Column:
    return F.coalesce(first_filled(molecule_id, canonical, raw), F.lit(""))


def annotation_key(molecule_id: Column | str, index: Column | str) -> Column:
    """Trimmed id, or ``row_{index}`` (0-based position) for rows without one."""
    return F.coalesce(
        filled(strip(molecule_id)), F.concat(F.lit("row_"), col(index).cast("string"))
    )


def comparison_key(
    molecule_id: Column | str, canonical: Column | str, raw: Column | str, index: Column | str
) -> Column:
    """First usable of id, canonical text, input text and position, with its kind as prefix."""
    kinds = {"molecule:": strip(molecule_id), "canonical:": strip(canonical), "input:": strip(raw)}
    named = [F.concat(F.lit(kind), filled(value)) for kind, value in kinds.items()]
    return F.coalesce(*named, F.concat(F.lit("row:"), col(index).cast("string")))


def word_shingles(key: Column | str, width: int = 3) -> Column:
    """Distinct runs of ``width`` words of a normalised text (the whole text if shorter).

    The word array is zipped with its own shifted copies, so that no lambda
    refers to the text and the work stays linear in its length.
    """
    words = F.split(col(key), " ")
    runs = F.size(words) - (width - 1)
    count = F.greatest(runs, F.lit(0))
    joined = F.slice(words, 1, count)
    for shift in range(1, width):
        joined = F.zip_with(
            joined, F.slice(words, shift + 1, count), lambda a, b: F.concat(a, F.lit(" "), b)
        )
    return F.when(runs > 0, F.array_distinct(joined)).when(runs.isNotNull(), F.array(col(key)))


def hashed_features(shingles: Column | str) -> Column:
    """Distinct 64-bit feature numbers of an array of texts."""
    return F.array_distinct(F.transform(col(shingles), lambda s: F.xxhash64(s)))


def feature_set(key: Column | str, n_bits: int = V.FEATURE_BITS, width: int = 3) -> Column:
    """Sorted on-bit positions of a fixed-width feature vector, from word shingles."""
    bits = F.transform(
        word_shingles(key, width),
        lambda s: (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % n_bits).cast("int"),
    )
    return F.sort_array(F.array_distinct(bits))


def safe_job_id(job_id: Column | str) -> Column:
    """Non-empty and without path parts."""
    c = col(job_id)
    return F.coalesce(c.rlike(r"^[^/\\]+$") & ~c.isin(".", ".."), F.lit(False))
