"""Exact copies of records' notes, found by two passes over a Bloom filter of text hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.session import columnar

BLANKS = r"[\x20\x09-\x0D]+"
#: Bits of the filter for each row, and the bounds of its size: it is broadcast, with 128 MB at the most.
BITS_PER_ROW = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Bits of one bitmap, the width that ``bitmap_construct_agg`` has.
BITMAP = 15
#: Texts held by more rows than this, and by over 1 / MOST_HEAVY of all rows, are joined by broadcast.
HEAVY_ROWS = 100_000
MOST_HEAVY = 10_000


def normal_text(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def filter_bits(rows: int) -> int:
    """Size of the filter for a number of rows: a power of two within its bounds."""
    return min(max(LEAST_BITS, 1 << max(rows * BITS_PER_ROW - 1, 1).bit_length()), MOST_BITS)


def _slots(digest: Column, bits: int) -> list[Column]:
    """The two bits of a digest, one in each half of the filter."""
    h, half = F.xxhash64(digest), bits // 2
    return [h.bitwiseAND(F.lit(half - 1)), F.shiftrightunsigned(h, 33).bitwiseAND(F.lit(half - 1)) + half]


def repeated_slots(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """First pass: (bitmap, bits) of the slots that more than one row falls on.

    What is shuffled are slot numbers with their counts, summed inside each task first; the result
    has at most ``bits`` bits, whatever the data.
    """
    slots = digests.select(F.explode(F.array(*_slots(F.col(digest), bits))).alias("slot"))
    crowded = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return crowded.groupBy(F.shiftright("slot", BITMAP).alias("bitmap")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << BITMAP) - 1))).alias("bits"))


def with_maybe_repeated(rows: DataFrame, digest: str, filter_: DataFrame, bits: int, flag: str) -> DataFrame:
    """Second pass: add whether both slots of a row's digest are set in the filter; rows do not move."""
    hit, kept = F.lit(True), rows.columns
    for i, slot in enumerate(_slots(F.col(digest), bits)):
        names = [fresh_name(rows, f"_bitmap{i}"), fresh_name(rows, f"_bits{i}")]
        rows = rows.join(F.broadcast(filter_.toDF(*names)), F.shiftright(slot, BITMAP) == F.col(names[0]), "left")
        place = slot.bitwiseAND(F.lit((1 << BITMAP) - 1)).cast("int")
        byte = F.conv(F.hex(F.col(names[1]).substr((F.shiftright(place, 3) + 1), F.lit(1))), 16, 10).cast("long")
        hit = hit & F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.select(*kept, hit.alias(flag))


def mark_exact_copies(records: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes") -> DataFrame:
    """For every record, which record with the same evidence notes stays.

    Notes are equal when they are identical after each run of ASCII white space is replaced by one
    space (leading and trailing runs too); of equal ones the record with the smallest id stays.
    Returns one row for each record: ``id_col``, ``keep_id`` (id of the record that stays),
    ``group_size``, ``kept`` and ``text_sha256`` (hexadecimal digest of the normal text), which is
    what texts are compared by.

    Null notes count as empty, so they equal empty ones; a record without an id stays only where no
    equal one has an id (``keep_id`` is null then). Ids need not be unique: of equal notes with the
    same smallest id one row stays. Other columns are ignored, whatever their names; an empty table
    gives an empty result.

    How it scales: the digests are stored once; a first pass sets a bit of a filter of bounded size
    (8 bits a row, 128 MB at most) where two rows meet, a second pass looks every row up. Rows that
    miss pass straight through; only the others are shuffled, and those of the few texts that hold
    over a ten-thousandth of all rows meet their group by broadcast instead. Above 134 million rows
    the filter no longer grows: more rows are shuffled then, with the same result.
    """
    digests = columnar(records.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(normal_text(F.col(text_col)), 256)).alias("digest"),
    ).withColumn("row", F.monotonically_increasing_id()), "digests")
    total = digests.count()
    bits = filter_bits(total)
    flagged = with_maybe_repeated(digests, "digest", repeated_slots(digests, "digest", bits), bits, "maybe")
    order = F.struct(F.col("id").isNull().alias("without"), "id", "row")
    flagged = columnar(flagged, "flagged-digests")
    maybe = flagged.where("maybe")
    groups = columnar(maybe.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("size")), "copy-groups")
    limit = max(HEAVY_ROWS, total // MOST_HEAVY)
    heavy, light = groups.where(F.col("size") > limit), groups.where(F.col("size") <= limit)
    heavy = F.broadcast(heavy.select(F.col("digest").alias("heavy"), "first", "size"))
    grouped = (
        maybe.join(heavy, F.col("digest") == F.col("heavy")).select("id", "row", "digest", "first", "size")
        .unionByName(maybe.join(heavy, F.col("digest") == F.col("heavy"), "left_anti").join(light, "digest")
                     .select("id", "row", "digest", "first", "size"))
    )
    alone = flagged.where(~F.col("maybe")).select("id", "row", "digest", order.alias("first"), F.lit(1).cast("long").alias("size"))
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(records: DataFrame, id_col: str = "molecule_id", text_col: str = "evidence_summary_notes") -> DataFrame:
    """The records, all columns unchanged, without exact copies of their evidence notes.

    The same rule as in :func:`mark_exact_copies`. Records whose notes surely stand alone are passed on
    where they are; of the others, one row for each digest comes out of a sum that starts inside each task.
    Where several records with equal notes share the smallest id, any one of them stays.
    """
    digest, flag = fresh_name(records, "_digest"), fresh_name(records, "_maybe")
    rows = records.withColumn(digest, F.unhex(F.sha2(normal_text(F.col(text_col)), 256)))
    bits = filter_bits(records.count())
    filter_ = columnar(repeated_slots(rows.select(digest), digest, bits), "repeated-slots")
    flagged = with_maybe_repeated(rows, digest, filter_, bits, flag)
    whole = F.struct(*[F.col(c) for c in records.columns])
    first = F.min_by(whole, F.struct(F.col(id_col).isNull(), F.col(id_col))).alias("kept")
    chosen = flagged.where(F.col(flag)).groupBy(digest).agg(first).select("kept.*")
    return flagged.where(~F.col(flag)).select(*records.columns).unionAll(chosen)
