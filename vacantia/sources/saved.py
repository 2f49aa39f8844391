"""Saved adverts: text files with a header, labelled by hand, and the detector's audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import slug


def saved_name() -> Column:
    """Column: file name of a saved vacancy, company--title--fingerprint start."""
    return F.concat_ws("--", slug(F.col("company"), 24), slug(F.col("title"), 40), F.substring("fingerprint", 1, 8))


def read_saved(spark: SparkSession, folder: str) -> DataFrame:
    """(path, expected, meta map, text, valid) of 'key: value' headers, '---' and a body.

    Lines beginning with '#' in the header are remarks. A file without the separator has
    ``valid`` false and no text.
    """
    raw = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    head = F.regexp_extract("v", r"(?s)^(.*?)(?:^|\n)---[ \t]*\r?\n", 1)
    valid = F.col("v").rlike(r"(?s)(?:^|\n)---[ \t]*(?:\r?\n|$)")
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: ~F.startswith(F.trim(x), F.lit("#")) & F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    meta = F.map_from_entries(F.array_distinct(pairs))
    return raw.select(
        "path", F.lower(F.coalesce(F.try_element_at(meta, F.lit("expected")), F.lit("?"))).alias("expected"), meta.alias("meta"),
        F.when(valid, F.regexp_replace("v", r"(?s)^.*?(?:^|\n)---[ \t]*(?:\r?\n|$)", "")).otherwise("").alias("text"), valid.alias("valid"),
    )


def to_save(vacancies: DataFrame, existing: DataFrame) -> DataFrame:
    """The vacancies whose file is not there yet: nothing is ever overwritten.

    existing: name. vacancies: company, title, fingerprint and what is to be written.
    """
    return vacancies.withColumn("name", saved_name()).join(existing.select("name").distinct(), "name", "left_anti")


def content(day: str) -> Column:
    """Column: the file of a saved vacancy: company, title, url, sources, text, verdict and has_body are read."""
    v = F.col("verdict")
    head = F.concat_ws(
        "\n", F.lit("# set 'expected' to blocked, likely, plus, ok or unknown"), F.lit("expected: ?"),
        F.concat(F.lit("detected: "), v["level"], F.lit(" ("), v["label"], F.lit(": "), v["reason"], F.lit(")")), F.concat(F.lit("company: "), F.col("company")),
        F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("url: "), F.col("url")), F.concat(F.lit("sources: "), F.array_join("sources", ", ")), F.lit(f"captured: {day}"),
        F.when(~F.col("has_body"), F.lit("note: the feed carried no ad text, only the title")), F.lit("---"), F.col("text"), F.lit(""),
    )
    return head


def write_saved(vacancies: DataFrame, existing: DataFrame, folder: str, day: str) -> DataFrame:
    """Writes one file a vacancy into ``folder/name=<name>`` and gives the names written; those that exist are left as they are."""
    new = to_save(vacancies, existing).dropDuplicates(["name"]).select("name", content(day).alias("value"))
    new.write.mode("append").partitionBy("name").text(folder)
    return new.select("name")


def audit(ads: DataFrame) -> DataFrame:
    """(ads, labelled, agreeing): saved adverts with a level found (``level``) and one expected."""
    known = F.col("expected").isin("blocked", "likely", "plus", "ok", "unknown")
    return ads.agg(F.count("*").alias("ads"), F.count(F.when(known, 1)).alias("labelled"), F.count(F.when(known & (F.col("expected") == F.col("level")), 1)).alias("agreeing"))


def disagreements(ads: DataFrame) -> DataFrame:
    """(path, line): 'you said x, detector said y (reason)' for each labelled advert that differs."""
    known = F.col("expected").isin("blocked", "likely", "plus", "ok", "unknown")
    return ads.where(known & (F.col("expected") != F.col("level"))).select(
        "path", F.concat(F.lit("you said "), F.col("expected"), F.lit(", detector said "), F.col("level"), F.lit(" ("), F.col("reason"), F.lit(")")).alias("line")
    )
