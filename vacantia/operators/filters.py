"""Listing filters: keywords, exclusions, employers, places, and per-source overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text


def normalise_listings(raw: DataFrame) -> DataFrame:
    """Listings with every field normalised; rows left without title or company are dropped.

    Columns beside those of a listing are kept as they are.
    """
    fields = {
        "title": text.normalise_title(F.col("title")),
        "company": text.normalise_text(F.col("company")),
        "location": text.normalise_text(F.col("location")),
        "url": text.canonical_url(F.col("url")),
        "source": F.lower(text.normalise_text(F.col("source"))),
    }
    if "tags" in raw.columns:
        fields["tags"] = text.normalise_tags(F.col("tags"))
    if "description" in raw.columns:
        fields["description"] = text.normalise_description(F.col("description"))
    return raw.withColumns(fields).where((F.col("title") != "") & (F.col("company") != ""))


def with_identity(listings: DataFrame) -> DataFrame:
    """Adds fingerprint, company_key, title_key and vacancy_key."""
    return listings.withColumns({
        "fingerprint": text.fingerprint(F.col("company"), F.col("title"), F.col("url")),
        "company_key": text.company_key(F.col("company")),
        "title_key": text.title_key(F.col("title")),
    }).withColumn("vacancy_key", F.concat_ws("|", "company_key", "title_key"))


def _haystack(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def contains_any(hay: Column, words: list[str]) -> Column:
    """Substring test against any word that is not blank; false without one."""
    out = F.lit(False)
    for w in words:
        if w.strip():
            out = out | F.contains(hay, F.lit(w.strip().lower()))
    return out


def matches(words: list[str], include_company: bool = False) -> Column:
    parts = [F.col("title"), F.concat_ws(" ", "tags")] + ([F.col("company")] if include_company else [])
    return contains_any(_haystack(*parts), words)


def filter_listings(
    listings: DataFrame, keywords: list[str] = (), locations: list[str] = (), exclude_keywords: list[str] = (), exclude_companies: list[str] = ()
) -> DataFrame:
    """The conjunction of all filters; an empty list keeps everything, a list of blanks nothing.

    The place filter only judges listings that state a place.
    """
    keep = ~contains_any(F.lower("company"), list(exclude_companies)) & ~matches(list(exclude_keywords), include_company=True)
    if keywords:
        keep = keep & matches(list(keywords))
    if locations:
        where = contains_any(_haystack(F.col("location"), F.concat_ws(" ", "tags")), list(locations))
        keep = keep & ((F.col("location") == "") | where)
    return listings.where(keep)


def filter_with_overrides(listings: DataFrame, overrides: DataFrame, keywords: list[str], locations: list[str]) -> DataFrame:
    """Like ``filter_listings``, with the lists a source sets for itself.

    overrides: source, keywords, locations (arrays; null means the general list, an
    empty array keeps everything). A source has at most one row.
    """
    o = overrides.select("source", F.col("keywords").alias("__k"), F.col("locations").alias("__l"))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    hay = _haystack(F.col("title"), F.concat_ws(" ", "tags"))
    place = _haystack(F.col("location"), F.concat_ws(" ", "tags"))
    hit = lambda words, h: F.exists(words, lambda w: (F.trim(w) != "") & F.contains(h, F.lower(F.trim(w))))
    joined = listings.join(o, "source", "left").withColumn("__k", F.coalesce("__k", arr(keywords))).withColumn("__l", F.coalesce("__l", arr(locations)))
    return joined.where(
        ((F.size("__k") == 0) | hit(F.col("__k"), hay))
        & ((F.size("__l") == 0) | (F.col("location") == "") | hit(F.col("__l"), place))
    ).drop("__k", "__l")
