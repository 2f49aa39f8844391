"""Dates and places as boards write them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import normalise_text


def parse_date(c: Column) -> Column:
    """Date of an ISO text or an epoch in seconds or milliseconds; null for anything else.

    The date is the one written, not the one in UTC. Above 10^10 a number is milliseconds.
    """
    t = F.trim(c)
    n = F.when(t.rlike(r"^\d{1,18}$"), t.try_cast("bigint"))
    seconds = F.when(n > 10_000_000_000, F.floor(n / 1000)).otherwise(n)
    epoch = F.when(seconds < 253_402_300_800, F.date_from_unix_date(F.floor(seconds / 86400).cast("int")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.when(n.isNotNull(), epoch).otherwise(iso)


def epoch_millis_date(c: Column) -> Column:
    n = F.trim(c.cast("string")).try_cast("bigint")
    return F.date_from_unix_date(F.floor(n / 86_400_000).cast("int"))


def feed_date(c: Column) -> Column:
    """RFC-822 (weekday ignored) or ISO date of a feed entry, in UTC."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},?\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+(GMT|UTC|Z)$", " +0000"), r"\s+", " ")
    rfc = F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), text))
    return F.coalesce(F.to_date(rfc), F.to_date(iso), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


# What stands for a remote place anywhere.
ANYWHERE = ("anywhere", "worldwide", "remote", "anywhere in the world")
REGIONISH = r"(?i)anywhere|remote|±|\butc|\bgmt|\b[a-z]?[ecmp][sd]?t\b|europe|america|latam|asia|pacific|emea"
# End of fixed values.


def remote_location(c: Column) -> Column:
    """Location of a remote board's restriction: 'Remote', 'Remote (Worldwide)' or 'Remote (x)'."""
    t = normalise_text(c)
    return (
        F.when(t == "", F.lit("Remote"))
        .when(F.lower(t).isin(*ANYWHERE), F.lit("Remote (Worldwide)"))
        .otherwise(F.concat(F.lit("Remote ("), t, F.lit(")")))
    )


def place_or_remote(c: Column) -> Column:
    """A place as it is; a time zone or region as 'Remote (x)'."""
    t = normalise_text(c)
    return (
        F.when(F.lower(t) == "anywhere", F.lit("Remote (Worldwide)"))
        .when(t.rlike(REGIONISH), F.concat(F.lit("Remote ("), t, F.lit(")")))
        .otherwise(t)
    )


def split_title_company(c: Column, longest: int = 60) -> Column:
    """struct(title, company) of 'title, company', cut at the last comma; company '' if there is none."""
    t = normalise_text(c)
    head = F.trim(F.regexp_extract(t, r"^(.*),([^,]*)$", 1))
    tail = F.trim(F.regexp_extract(t, r"^(.*),([^,]*)$", 2))
    ok = (head != "") & (tail != "") & (F.length(tail) <= longest)
    return F.struct(F.when(ok, head).otherwise(t).alias("title"), F.when(ok, tail).otherwise("").alias("company"))


def bracket_tags(c: Column) -> Column:
    """[a, b] of a text that ends in 'Tags: [a] [b]'."""
    tail = F.regexp_extract(F.coalesce(c, F.lit("")), r"Tags:\s*((?:\[[^\]]+\]\s*)+)\s*$", 1)
    return F.filter(F.transform(F.regexp_extract_all(tail, F.lit(r"\[([^\]]*)\]"), F.lit(1)), F.trim), lambda t: t != "")


def location_hint(text: Column, hints: list[str]) -> Column:
    """The first hint of the list that the text contains (any case), else ''."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("")
    for h in reversed(hints):
        out = F.when(F.contains(low, F.lit(h.lower())), F.lit(h)).otherwise(out)
    return out
