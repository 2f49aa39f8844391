"""Records that differ only in how they are written, collapsed with their copy counts.

Method: dictionary encoding. Each distinct field value is canonicalised once, each
canonical value gets an integer, a record becomes the sorted tuple of its fields'
integers, and the compact tuples are grouped.

Defined cases: a field that is null or holds no letter or digit makes its record no
candidate; in a group named in ``one_is_enough`` it counts as the empty value while the
other field has one. Fields may be of any length; they are compared whole. Ids have to be
unique and non-negative; a repeated row with the same values is a copy of the same id
and is counted once. Empty tables give empty results. Only the named columns are read,
so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import skew_join
from ..session import cut


def canonical_letters(c: Column) -> Column:
    """Letters and digits only, lower case: what formatting differences leave alone.

    White space, punctuation, symbols and invisible characters (format characters,
    variation selectors, the grapheme joiner) go; letters, their marks and digits stay.
    """
    letters = F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+|[\uFE00-\uFE0F\u034F]+", "")
    return F.translate(F.lower(letters), "\u03c2", "\u03c3")


def encode(
    records: DataFrame, group: str, record_id: str, left: str, right: str, one_is_enough: tuple[str, ...] = ()
) -> DataFrame:
    """(group, id, lo, hi): each record as the sorted pair of its values' integers.

    The integer of a canonical value is the least code ``2*id + field`` (by group) of
    a record that has it: unique, repeatable when a task is run again, and found by the
    same aggregation that builds the dictionary, so no numbering pass is needed.
    """
    recs = records.select(
        F.col(group).alias("g"), F.col(record_id).alias("id"), F.col(left).alias("a"), F.col(right).alias("b")
    ).where(F.col("id").isNotNull())
    # Raw values to canonical ones: counted first, so each distinct value is canonicalised once.
    raw = (
        recs.select("g", F.explode(F.array(F.struct(F.col("a").alias("raw"), (F.col("id") * 2).alias("code")),
                                           F.struct(F.col("b").alias("raw"), (F.col("id") * 2 + 1).alias("code")))).alias("f"))
        .select("g", F.coalesce("f.raw", F.lit("")).alias("raw"), "f.code")
        .groupBy("g", "raw").agg(F.min("code").alias("code"), F.count("*").alias("n"))
        .withColumn("canon", canonical_letters(F.col("raw")))
    )
    # Stored: the dictionary is read for both fields, and each time for its hot values too.
    # 0 marks a value without letter or digit (they need no common integer, so they do not
    # meet in one group); the codes are moved up by one.
    raw = raw.select("g", "raw", "code", "n", F.when(F.col("canon") != "", F.xxhash64("canon")).alias("h"), F.when(F.col("canon") != "", F.col("canon")).alias("canon"))
    ids = raw.where("canon IS NOT NULL").groupBy("g", "h", "canon").agg(F.min("code").alias("value_id"))
    dictionary = cut(raw.join(ids, ["g", "h", "canon"], "left").select("g", "raw", "n", F.coalesce(F.col("value_id") + 1, F.lit(0)).cast("bigint").alias("v")))
    a = skew_join(
        recs.select("g", "id", F.coalesce("a", F.lit("")).alias("raw"), F.coalesce("b", F.lit("")).alias("raw_b")),
        dictionary, ["g", "raw"], "n", F.col("id"),
    ).select("g", "id", F.col("v").alias("va"), F.col("raw_b").alias("raw"))
    both = skew_join(a, dictionary, ["g", "raw"], "n", F.col("id"))
    lenient: Column = F.col("g").isin(*one_is_enough) if one_is_enough else F.lit(False)
    ok = F.when(lenient, F.greatest("va", "v") > 0).otherwise(F.least("va", "v") > 0)
    return both.where(ok).select(
        "g", "id", F.least("va", "v").alias("lo"), F.greatest("va", "v").alias("hi")
    )


def collapse(encoded: DataFrame) -> DataFrame:
    """(g, lo, hi, first_id, copies): one row per distinct record."""
    return encoded.groupBy("g", "lo", "hi").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies")
    )


def copies(encoded: DataFrame) -> DataFrame:
    """(g, first_id, copy_id): every record that repeats an earlier one, with the first."""
    encoded = cut(encoded)  # three integers a record, read twice below
    groups = collapse(encoded).where(F.col("copies") > 1)
    return (
        skew_join(encoded, groups, ["g", "lo", "hi"], "copies", F.col("id"))
        .where(F.col("id") != F.col("first_id"))
        .select("g", "first_id", F.col("id").alias("copy_id"))
        .distinct()
    )
