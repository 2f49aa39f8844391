"""Queries of the training-data problems: pN_name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..plans import sql as d
from ..session import cut, scratch, spread, table
from . import bpe, doclang, format_duplicates, gazetteer, history, leak, names, residue, truth


def _p1_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listings = table(spark, sf_dir, "listings").select(
        F.lit("listings").alias("g"), F.col("listing_id").alias("id"), F.col("title").alias("a"), F.col("company").alias("b")
    )
    seen = table(spark, sf_dir, "seen_jobs").where(F.col("vacancy_key") != "").select(
        F.lit("seen_jobs").alias("g"),
        F.col("record_id").alias("id"),
        F.split_part("vacancy_key", F.lit("|"), F.lit(1)).alias("a"),
        F.regexp_replace("vacancy_key", r"^[^|]*\|?", "").alias("b"),
    )
    return listings, seen


def _p1_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings, seen = _p1_records(spark, sf_dir)
    return format_duplicates.encode(listings.unionByName(seen), "g", "id", "a", "b", one_is_enough=("seen_jobs",))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = format_duplicates.copies(_p1_encoded(spark, sf_dir))
    return found.select(F.col("g").alias("table_name"), "first_id", "copy_id")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    groups = format_duplicates.collapse(_p1_encoded(spark, sf_dir))
    return groups.select(F.col("g").alias("table_name"), "first_id", "copies")


# ---- p2: languages ----------------------------------------------------------------


def _p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = spread(table(spark, sf_dir, "listings").select("listing_id", "description", "url"))
    labels = table(spark, sf_dir, "language_evidence").select("listing_id", "ad_language")
    return doclang.segments(listings, labels, "listing_id", "description", "url", "ad_language")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.col("mixed") | F.col("declared").isNull() | (F.col("declared") != F.col("lang"))
    return _p2_segments(spark, sf_dir).where(wrong).select("listing_id", "line_no", "lang")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every advert with its confidence."""
    return _p2_segments(spark, sf_dir).select("listing_id", "line_no", "lang", "confidence")


# ---- p3: places -------------------------------------------------------------------


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = spread(table(spark, sf_dir, "listings").select("listing_id", "location"))
    mapped = gazetteer.map_values(listings, table(spark, sf_dir, "places"), "listing_id", "location")
    return mapped.select("listing_id", "place_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that mean no entry of the list, with their number of listings."""
    listings = spread(table(spark, sf_dir, "listings").select("listing_id", "location"))
    none = gazetteer.map_values(listings, table(spark, sf_dir, "places"), "listing_id", "location").where("place_id = 0")
    value = F.lower(text.normalise_text(F.col("location")))
    return none.join(listings, "listing_id").groupBy(value.alias("value")).agg(F.count("*").alias("listings"))


# ---- p4: new batches against history ----------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch against the history and what came before it. The history comes first, whatever its ids are."""
    columns = ("title", "company", "location")
    seen = table(spark, sf_dir, "seen_jobs").select(F.col("record_id").cast("bigint").alias("id"), F.lit(0).alias("batch"), *columns)
    new = table(spark, sf_dir, "arrivals")
    last = seen.agg(F.max("id")).first()[0]
    first, number = new.agg(F.min("record_id"), F.min("batch_no")).first()
    ahead = 0 if last is None or first is None else max(0, last - first + 1)
    batch = (F.coalesce(F.col("batch_no"), F.lit(number)) - F.lit(number) + 1) if number is not None else F.lit(1)
    new = new.select((F.col("record_id").cast("bigint") + F.lit(ahead)).alias("id"), batch.cast("int").alias("batch"), *columns)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := scratch(spark, name))
        return spark.read.schema(df.schema).parquet(path)

    # Titles are read once, names once for each way they are typed.
    parsed = kept(history.read_titles(seen.unionByName(new), history.reader_of(table(spark, sf_dir, "places"))), "titles")
    known = cut(history.companies(parsed))
    found = history.repeats(kept(history.with_employers(parsed, known, cut(names.link(known, "name"))), "postings"))
    accepted = F.when(F.col("accepted") > F.lit(last), F.col("accepted") - F.lit(ahead)).otherwise(F.col("accepted")) if ahead else F.col("accepted")
    return found.select(accepted.alias("accepted_id"), (F.col("id") - F.lit(ahead)).alias("record_id"))


# ---- p5: employer spellings -------------------------------------------------------


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs_of(names.link(table(spark, sf_dir, "seen_jobs"), "company_key"))


def p5_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling of an employer in the listings, with the employer's least spelling."""
    listings = table(spark, sf_dir, "listings").select(text.company_key(F.col("company")).alias("company_key"))
    return names.link(listings, "company_key").select(F.col("name").alias("company_key"), F.col("entity").alias("employer"))


# ---- p6: best representative ------------------------------------------------------

# What stands for a missing location (compared in lower case, trimmed).
NO_LOCATION = (
    "", "-", "--", "---", "?", "??", ".", "n/a", "na", "n.a.", "null", "none", "nan", "unknown", "not specified",
    "unspecified", "tbd", "tba", "see ad", "see advert", "k.a.", "k. a.", "ukendt", "okänd", "unbekannt", "inconnu",
    "non précisé", "sconosciuto", "desconocido", "desconhecido", "onbekend", "not stated", "not given", "undefined",
    "various", "blank", "missing", "s.d.", "n.n.",
)
# End of fixed values.


def _p6_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "boards").select(
        F.lower(F.trim("source")).alias("source"), F.col("trust_rank").cast("int").alias("rank")
    ).groupBy("source").agg(F.min("rank").alias("rank"))
    listings = table(spark, sf_dir, "listings").select(
        "listing_id", "title", "company", "location", "posted", "fetched_at",
        F.lower(text.normalise_text(F.col("source"))).alias("source"),
    ).where((text.normalise_title(F.col("title")) != "") & (text.normalise_text(F.col("company")) != ""))
    place = F.lower(text.normalise_text(F.col("location")))
    keyed = listings.select(
        text.vacancy_key(F.col("company"), F.col("title")).alias("grp"), F.col("listing_id").alias("id"), F.col("fetched_at").alias("at"), "source",
        F.when(~place.isin(*NO_LOCATION), place).alias("location"),
        F.when(F.col("posted") <= F.to_date("fetched_at"), F.col("posted").cast("string")).alias("posted"),
    )
    return keyed.join(boards, "source", "left")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = truth.gather(_p6_claims(spark, sf_dir), ["location", "posted"]).where("first_id < last_id")
    truths, _ = truth.discover(groups, ["location", "posted"])
    return truths.where(F.col("location_id").isNotNull() & F.col("posted_id").isNotNull()).select(
        F.col("first_id").alias("group_id"), "location_id", "posted_id"
    )


def p6_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each board, estimated without the declared ranks."""
    claims = _p6_claims(spark, sf_dir).withColumn("rank", F.lit(None).cast("int"))
    _, sources = truth.discover(truth.gather(claims, ["location", "posted"]), ["location", "posted"])
    return sources


# ---- p7: token ids ----------------------------------------------------------------


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


# ---- p8: leaked passages ----------------------------------------------------------


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leak.leaks(docs, table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


# ---- p9: residue ------------------------------------------------------------------


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return residue.residue(docs).select(F.col("doc").alias("doc_id")).distinct()


def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue messages by kind with their documents' count and spread over sources."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    found = residue.message_table(residue.messages(docs))
    return found.where(F.col("kind").isNotNull()).select("message", "kind", F.col("shape_uses").alias("uses"), "sources")


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_employers": p5_employers,
    "p6_found": p6_found,
    "p6_reliability": p6_reliability,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_messages": p9_messages,
}

_P1_SQL = r"""
WITH r AS (
  SELECT 'listings' AS t, listing_id AS id, title AS a, company AS b FROM listings
  UNION ALL
  SELECT 'seen_jobs', record_id, split_part(vacancy_key, '|', 1), regexp_replace(vacancy_key, '^[^|]*\|?', '')
  FROM seen_jobs WHERE vacancy_key <> ''
), k AS (
  SELECT t, id, regexp_replace(lower(coalesce(a, '')), '[^\p{L}\p{M}\p{N}]', '', 'g') AS a,
         regexp_replace(lower(coalesce(b, '')), '[^\p{L}\p{M}\p{N}]', '', 'g') AS b FROM r
), g AS (
  SELECT t, id, least(a, b) AS lo, greatest(a, b) AS hi FROM k
  WHERE (a <> '' AND b <> '') OR (t = 'seen_jobs' AND (a <> '' OR b <> ''))
), m AS (SELECT t, id, min(id) OVER (PARTITION BY t, lo, hi) AS first_id, count(*) OVER (PARTITION BY t, lo, hi) AS copies FROM g)
"""

_P6_SQL = f"""
WITH b AS (SELECT lower(trim(source)) AS source, min(trust_rank) AS trust FROM boards GROUP BY 1),
k AS (SELECT listing_id, {d.company_key("company")} || '|' || {d.title_key("title")} AS grp, lower({d.norm("source")}) AS source,
  lower({d.norm("location")}) AS place, posted, fetched_at FROM listings WHERE {d.norm_title("title")} <> '' AND {d.norm("company")} <> ''),
g AS (SELECT *, min(listing_id) OVER (PARTITION BY grp) AS group_id, count(*) OVER (PARTITION BY grp) AS n FROM k),
j AS (SELECT g.*, coalesce(trust, 2147483647) AS trust FROM g LEFT JOIN b USING (source) WHERE n > 1),
x AS (SELECT group_id, first(listing_id ORDER BY trust, fetched_at DESC, listing_id) FILTER (WHERE place NOT IN ({", ".join(d.q(v) for v in NO_LOCATION)})) AS location_id,
  first(listing_id ORDER BY trust, fetched_at DESC, listing_id) FILTER (WHERE posted <= cast(fetched_at AS DATE)) AS posted_id FROM j GROUP BY group_id)
SELECT group_id, location_id, posted_id FROM x WHERE location_id IS NOT NULL AND posted_id IS NOT NULL
"""

ORACLE: dict[str, str] = {
    "p6_found": _P6_SQL,
    "p1_found": _P1_SQL + "SELECT t AS table_name, first_id, id AS copy_id FROM m WHERE id <> first_id",
    "p1_counts": _P1_SQL + "SELECT DISTINCT t AS table_name, first_id, copies FROM m",
}
