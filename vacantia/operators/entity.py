"""Vacancies from listings, and near-duplicate vacancies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that make two alike titles two jobs.
SENIORITY = (
    "junior", "jr", "senior", "sr", "lead", "principal", "staff", "head", "intern", "internship", "student", "trainee", "graduate",
    "i", "ii", "iii", "iv", "1", "2", "3", "manager", "director", "chief", "praktikant", "studentermedhjaelper", "elev",
)
SIMILARITY = 0.6
# End of fixed values.


def first_per_fingerprint(listings: DataFrame, order: str) -> DataFrame:
    """One row per fingerprint, the first by ``order`` (an aggregate, so no group is sorted)."""
    rest = [c for c in listings.columns if c != "fingerprint"]
    return listings.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), F.struct(order)).alias("r")).select("fingerprint", "r.*")


def primary_order() -> Column:
    """Most informative listing first, then its own data: the order of a vacancy's listings."""
    return F.struct(
        (F.col("location") == "").alias("a"), (F.col("description") == "").alias("b"), F.col("posted").isNull().alias("c"),
        F.col("source").alias("d"), F.col("url").alias("e"), F.col("fingerprint").alias("f"),
    )


def vacancies(listings: DataFrame) -> DataFrame:
    """(vacancy_key, listings, title, company, url, source, location, posted, sources, and tags if there are any).

    The primary listing and the first stated place come from struct minima and the
    sources from a set, so a vacancy of any number of listings combines before the
    shuffle. listings must be distinct by fingerprint.
    """
    o = primary_order()
    primary = F.min_by(F.struct("title", "company", "url", "source"), o).alias("p")
    place = F.min_by(F.col("location"), F.when(F.col("location") != "", o))
    tags = [F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags")] if "tags" in listings.columns else []
    return (
        listings.groupBy("vacancy_key").agg(
            F.count("*").alias("listings"), primary, F.coalesce(place, F.lit("")).alias("location"),
            F.min("posted").alias("posted"), F.array_sort(F.collect_set("source")).alias("sources"), *tags,
        ).select("vacancy_key", "listings", "p.title", "p.company", "p.url", "p.source", "location", "posted", "sources", *(["tags"] if tags else []))
    )


def vacancy_text(listings: DataFrame) -> DataFrame:
    """(vacancy_key, text): primary title and the distinct descriptions in primary order.

    A description counts once however many listings carry it. The text of a vacancy is one
    value, so its distinct descriptions (of 20,000 characters each at most) have to fit
    into one row.
    """
    o = primary_order()
    head = listings.groupBy("vacancy_key").agg(F.min_by("title", o).alias("title"))
    once = listings.where("description <> ''").groupBy("vacancy_key", "description").agg(F.min(o).alias("o"))
    body = once.groupBy("vacancy_key").agg(F.array_sort(F.collect_list(F.struct("o", "description"))).alias("d"))
    joined = head.join(body, "vacancy_key", "left")
    return joined.select(
        "vacancy_key",
        F.array_join(F.concat(F.array("title"), F.coalesce(F.transform("d", lambda x: x["description"]), F.array().cast("array<string>"))), "\n").alias("text"),
    )


def same_employer(a: Column, b: Column) -> Column:
    """Equal keys, or one a whole-word prefix of the other; empty keys never match."""
    space = F.lit(" ")
    return (a != "") & (b != "") & ((a == b) | F.startswith(b, F.concat(a, space)) | F.startswith(a, F.concat(b, space)))


def similar_titles(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    """Equal, equal without spaces, or at least 0.6 of the words shared; seniority never differs.

    sa, sb: the distinct words of a and b.
    """
    shared, union = F.size(F.array_intersect(sa, sb)), F.size(F.array_union(sa, sb))
    apart = F.array_union(F.array_except(sa, sb), F.array_except(sb, sa))
    levels = F.array(*[F.lit(w) for w in SENIORITY])
    close = ~F.arrays_overlap(apart, levels) & (shared / union >= SIMILARITY) & (a != "") & (b != "")
    return (a == b) | (F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit(""))) | close


def _signatures(vacs: DataFrame) -> DataFrame:
    """vacancy rows with (block, sig): equal signatures are necessary for similar titles.

    Prefix filter: with words in one global order, two sets with Jaccard 0.6 or more share
    a word among the first n - ceil(0.6 n) + 1 of each. Rare words come first, so common
    ones seldom get into a prefix. Titles that agree without spaces meet on that form.
    """
    base = vacs.select(
        "vacancy_key", "company_key", "title_key", F.split_part("company_key", F.lit(" "), F.lit(1)).alias("block"),
        F.filter(F.array_distinct(F.split("title_key", " ")), lambda w: w != "").alias("words"),
    ).where("company_key <> ''")
    words = base.select("vacancy_key", F.explode("words").alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    ranked = words.join(df, "w").groupBy("vacancy_key").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    n = F.size("o")
    keep = n - F.ceil(n * SIMILARITY).cast("int") + 1
    sig = F.concat(
        F.transform(F.slice("o", 1, F.greatest(keep, F.lit(1))), lambda x: x["w"]),
        F.array(F.concat(F.lit("="), F.replace("title_key", F.lit(" "), F.lit("")))),
    )
    with_words = base.join(ranked, "vacancy_key", "left").withColumn("o", F.coalesce("o", F.array().cast("array<struct<df:bigint,w:string>>")))
    return with_words.select("vacancy_key", "company_key", "title_key", "block", "words", F.explode(F.array_distinct(sig)).alias("sig"))


def similar_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b): vacancy keys of possible duplicates, each pair once (or left to right).

    left, right: vacancy_key, company_key, title_key, distinct. Employers meet on the
    first word of their key, which a whole-word prefix always shares.
    """
    if right is None:
        s = _signatures(left)
        l, r, order = s.alias("l"), s.alias("r"), F.col("l.vacancy_key") < F.col("r.vacancy_key")
    else:
        both = _signatures(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).drop("side").distinct())
        l = both.join(left.select("vacancy_key"), "vacancy_key", "left_semi").alias("l")
        r = both.join(right.select("vacancy_key"), "vacancy_key", "left_semi").alias("r")
        order = F.col("l.vacancy_key") != F.col("r.vacancy_key")
    return (
        l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.sig") == F.col("r.sig")) & order)
        .where(
            same_employer(F.col("l.company_key"), F.col("r.company_key"))
            & similar_titles(F.col("l.title_key"), F.col("r.title_key"), F.col("l.words"), F.col("r.words"))
        )
        .select(F.col("l.vacancy_key").alias("a"), F.col("r.vacancy_key").alias("b")).distinct()
    )


def possible_duplicates(vacs: DataFrame) -> DataFrame:
    """(vacancy_key, links): vacancies with near-duplicates and how many they have."""
    pairs = similar_pairs(vacs)
    return (
        pairs.select(F.explode(F.array("a", "b")).alias("vacancy_key"))
        .groupBy("vacancy_key").agg(F.count("*").alias("links"))
    )
