"""Registry of the engine's named queries and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates, text
from ..operators import entity, evidence, filters, lang, rank, report, store, verdict
from ..session import cut, ensure_checkpoint_dir, spread, table
from ..sources import parse
from ..streaming import seen as seen_stream
from . import sql as d

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised listings with their identities."""
    raw = table(spark, sf_dir, "listings").select("listing_id", "ord", "title", "company", "url", "source", "location", "posted", "tags", "description")
    return filters.with_identity(filters.normalise_listings(spread(raw)))


def unique_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.first_per_fingerprint(listings(spark, sf_dir).withColumn("o", F.struct("ord", "listing_id")), "o").drop("o")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seen_jobs")


# ---- projections ------------------------------------------------------------------

_L = "FROM listings"


@query(f"SELECT listing_id, {d.norm('title')} AS title, {d.norm('location')} AS location {_L}")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", text.normalise_text(F.col("title")).alias("title"), text.normalise_text(F.col("location")).alias("location"))


@query(f"SELECT listing_id, {d.norm_title('title')} AS title {_L}")
def normalise_title(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", text.normalise_title(F.col("title")).alias("title"))


@query(f"SELECT listing_id, {d.url('url')} AS url {_L}")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", text.canonical_url(F.col("url")).alias("url"))


@query(f"SELECT listing_id, {d.description('description')} AS description {_L}")
def html_to_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "listings").select("listing_id", "description")).select("listing_id", text.normalise_description(F.col("description")).alias("description"))


@query(f"SELECT listing_id, {d.fold('company')} AS company, {d.fold('location')} AS location {_L}")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", text.fold(F.col("company")).alias("company"), text.fold(F.col("location")).alias("location"))


@query(f"SELECT listing_id, {d.company_key('company')} AS company_key, {d.title_key('title')} AS title_key, {d.company_key('company')} || '|' || {d.title_key('title')} AS vacancy_key {_L}")
def identity_keys(spark, sf_dir):
    c, t = F.col("company"), F.col("title")
    return table(spark, sf_dir, "listings").select(
        "listing_id", text.company_key(c).alias("company_key"), text.title_key(t).alias("title_key"), text.vacancy_key(c, t).alias("vacancy_key")
    )


@query(f"SELECT listing_id, {d.fingerprint('company', 'title', 'url')} AS fingerprint {_L}")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", text.fingerprint(F.col("company"), F.col("title"), F.col("url")).alias("fingerprint"))


@query("""
SELECT listing_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL AND t <> ''),
       lambda t: lower(%s)))), ',') AS tags FROM listings""" % d.norm("t"))
def normalise_tags(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", F.array_join(text.normalise_tags(F.col("tags")), ",").alias("tags"))


@query(r"""
WITH x AS (SELECT listing_id, trim(regexp_replace(coalesce(title, ''), '%s', ' ', 'g')) AS t FROM listings),
y AS (SELECT *, trim(regexp_extract(t, '^(.*),([^,]*)$', 1)) AS a, trim(regexp_extract(t, '^(.*),([^,]*)$', 2)) AS b FROM x)
SELECT listing_id, CASE WHEN a <> '' AND b <> '' AND length(b) <= 60 THEN a ELSE t END AS head,
       CASE WHEN a <> '' AND b <> '' AND length(b) <= 60 THEN b ELSE '' END AS tail FROM y""" % d.WS)
def split_title_company(spark, sf_dir):
    s = table(spark, sf_dir, "listings").select("listing_id", dates.split_title_company(F.col("title")).alias("s"))
    return s.select("listing_id", F.col("s.title").alias("head"), F.col("s.company").alias("tail"))


@query(r"""
WITH x AS (SELECT listing_id, %s AS t FROM listings)
SELECT listing_id, CASE WHEN t = '' THEN 'Remote' WHEN lower(t) IN ('anywhere', 'worldwide', 'remote', 'anywhere in the world') THEN 'Remote (Worldwide)'
       ELSE 'Remote (' || t || ')' END AS remote,
       CASE WHEN lower(t) = 'anywhere' THEN 'Remote (Worldwide)' WHEN regexp_matches(t, '(?i)anywhere|remote|±|\butc|\bgmt|\b[a-z]?[ecmp][sd]?t\b|europe|america|latam|asia|pacific|emea')
       THEN 'Remote (' || t || ')' ELSE t END AS place FROM x""" % d.norm("location"))
def remote_places(spark, sf_dir):
    c = F.col("location")
    return table(spark, sf_dir, "listings").select("listing_id", dates.remote_location(c).alias("remote"), dates.place_or_remote(c).alias("place"))


@query("""
WITH x AS (SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN strftime(fetched_at, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 1 THEN cast(epoch_ms(fetched_at) AS VARCHAR)
  WHEN 2 THEN cast(epoch_ms(fetched_at) // 1000 AS VARCHAR) ELSE 'soon' END AS v, fetched_at FROM listings)
SELECT listing_id, CASE WHEN v = 'soon' THEN NULL ELSE cast(cast(fetched_at AS DATE) AS VARCHAR) END AS day FROM x""")
def parse_date_multi(spark, sf_dir):
    ts = F.col("fetched_at").cast("timestamp")
    k = F.col("listing_id") % 4
    written = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k == 1, F.unix_millis(ts).cast("string"))
        .when(k == 2, F.unix_seconds(ts).cast("string")).otherwise(F.lit("soon"))
    )
    return table(spark, sf_dir, "listings").select("listing_id", dates.parse_date(written).cast("string").alias("day"))


_HINTS = ["remote", "hybrid", "denmark", "danmark", "sweden", "germany", "italy"]


@query("SELECT listing_id, CASE " + " ".join(f"WHEN contains(lower(coalesce(location, '')), '{h}') THEN '{h}'" for h in _HINTS) + f" ELSE '' END AS hint {_L}")
def location_hint(spark, sf_dir):
    return table(spark, sf_dir, "listings").select("listing_id", dates.location_hint(F.col("location"), _HINTS).alias("hint"))


# ---- filters ----------------------------------------------------------------------

_KEYS = ["test", "qa ", "quality"]
_HAY = "lower(title || ' ' || array_to_string(ntags, ' '))"
_TAGS = "list_sort(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL AND t <> ''), lambda t: lower(%s)))) AS ntags" % d.norm("t")


def _any(hay: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({hay}, {d.q(w.strip().lower())})" for w in words) + ")"


@query(f"WITH {d.LISTINGS}, f AS (SELECT *, {_TAGS} FROM l) SELECT listing_id FROM f WHERE {_any(_HAY, _KEYS)}")
def keyword_filter(spark, sf_dir):
    return filters.filter_listings(listings(spark, sf_dir), keywords=_KEYS).select("listing_id")


@query(f"WITH {d.LISTINGS}, f AS (SELECT *, {_TAGS} FROM l) SELECT listing_id FROM f WHERE NOT {_any('lower(company)', ['gmbh', 'ltd'])} AND NOT {_any(_HAY + " || ' ' || lower(company)", ['senior', 'payments'])}")
def exclusion_filter(spark, sf_dir):
    return filters.filter_listings(listings(spark, sf_dir), exclude_keywords=["senior", "payments"], exclude_companies=["GmbH", "Ltd"]).select("listing_id")


@query(f"WITH {d.LISTINGS}, f AS (SELECT *, {_TAGS} FROM l) SELECT listing_id FROM f WHERE location = '' OR {_any("lower(location || ' ' || array_to_string(ntags, ' '))", ['remote', 'denmark', 'dk'])}")
def location_filter(spark, sf_dir):
    return filters.filter_listings(listings(spark, sf_dir), locations=["Remote", "Denmark", "DK"]).select("listing_id")


@query(f"""
WITH {d.LISTINGS}, f AS (SELECT *, {_TAGS} FROM l),
o AS (SELECT source, CASE WHEN kind = 'ats' THEN []::VARCHAR[] WHEN kind = 'rss' THEN ['developer'] END AS k FROM boards)
SELECT listing_id FROM f LEFT JOIN o USING (source)
WHERE len(coalesce(k, ['tester'])) = 0 OR len(list_filter(coalesce(k, ['tester']), lambda w: contains({_HAY}, w))) > 0""")
def source_override_filter(spark, sf_dir):
    o = table(spark, sf_dir, "boards").select(
        "source", F.when(F.col("kind") == "ats", F.array().cast("array<string>")).when(F.col("kind") == "rss", F.array(F.lit("developer"))).alias("keywords"),
        F.lit(None).cast("array<string>").alias("locations"),
    )
    return filters.filter_with_overrides(listings(spark, sf_dir), o, ["tester"], []).select("listing_id")


# ---- identity, grouping, near-duplicates ------------------------------------------


@query("""
WITH a AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY record_id) = 1)
SELECT record_id, fingerprint FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM seen_jobs WHERE fingerprint IS NOT NULL)""")
def new_listings(spark, sf_dir):
    arrivals = table(spark, sf_dir, "arrivals").select("record_id", "fingerprint", "title", "company")
    return store.new_listings(arrivals, seen(spark, sf_dir), "record_id").select("record_id", "fingerprint")


@query("""
WITH a AS (SELECT record_id, batch_no, fingerprint, vacancy_key FROM arrivals QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY record_id) = 1),
s AS (SELECT vacancy_key, status, status_at, note FROM seen_jobs WHERE vacancy_key <> '' AND status <> 'new'
  QUALIFY row_number() OVER (PARTITION BY vacancy_key ORDER BY coalesce(status_at, DATE '0001-01-01') DESC, first_seen DESC, fingerprint DESC, record_id DESC) = 1)
SELECT record_id, batch_no, '2025-07-01 08:00:00' AS first_seen, coalesce(status, 'new') AS status, status_at::VARCHAR AS status_at, coalesce(note, '') AS note
FROM a LEFT JOIN s USING (vacancy_key) WHERE fingerprint NOT IN (SELECT fingerprint FROM seen_jobs WHERE fingerprint IS NOT NULL)""")
def mark_seen(spark, sf_dir):
    arrivals = table(spark, sf_dir, "arrivals").select("record_id", "fingerprint", "batch_no", "vacancy_key")
    rows = store.mark_seen(arrivals, seen(spark, sf_dir), "2025-07-01 08:00:00", "record_id")
    return rows.select("record_id", "batch_no", F.col("first_seen").cast("string").alias("first_seen"), "status", F.col("status_at").cast("string").alias("status_at"), "note")


_ORDER = "location = '', description = '', posted IS NULL, source, url, fingerprint"


@query(f"""
WITH {d.LISTINGS}
SELECT vacancy_key, count(*) AS listings, first(title ORDER BY {_ORDER}) AS title, first(url ORDER BY {_ORDER}) AS url,
       coalesce(first(location ORDER BY {_ORDER}) FILTER (WHERE location <> ''), '') AS location, min(posted)::VARCHAR AS posted,
       array_to_string(list_sort(list_distinct(list(source))), ',') AS sources
FROM u GROUP BY vacancy_key""")
def group_listings(spark, sf_dir):
    v = entity.vacancies(unique_listings(spark, sf_dir))
    return v.select("vacancy_key", "listings", "title", "url", "location", F.col("posted").cast("string").alias("posted"), F.array_join("sources", ",").alias("sources"))


@query(f"""
WITH {d.LISTINGS},
b AS (SELECT vacancy_key, description, min(row(location = '', description = '', posted IS NULL, source, url, fingerprint)) AS o FROM u WHERE description <> '' GROUP BY 1, 2)
SELECT h.vacancy_key, md5(h.title || coalesce(chr(10) || t.body, '')) AS digest
FROM (SELECT vacancy_key, first(title ORDER BY {_ORDER}) AS title FROM u GROUP BY 1) h
LEFT JOIN (SELECT vacancy_key, string_agg(description, chr(10) ORDER BY o, description) AS body FROM b GROUP BY 1) t USING (vacancy_key)""")
def vacancy_text(spark, sf_dir):
    return entity.vacancy_text(unique_listings(spark, sf_dir)).select("vacancy_key", F.md5("text").alias("digest"))


@query(f"""
WITH {d.LISTINGS},
v AS (SELECT DISTINCT vacancy_key, company_key, title_key, {d.words('title_key')} AS words, split_part(company_key, ' ', 1) AS block FROM l WHERE company_key <> ''),
p AS (SELECT a.vacancy_key AS a, b.vacancy_key AS b FROM v a JOIN v b ON a.block = b.block AND a.vacancy_key < b.vacancy_key WHERE {d.similar('a', 'b')})
SELECT k AS vacancy_key, count(*) AS links FROM (SELECT a AS k FROM p UNION ALL SELECT b FROM p) GROUP BY k""")
def possible_duplicates(spark, sf_dir):
    return entity.possible_duplicates(listings(spark, sf_dir).select("vacancy_key", "company_key", "title_key").distinct())


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("company"), F.col("title")
    return seen(spark, sf_dir).select(
        "record_id", "status", "status_at", "first_seen", "fingerprint", "title", text.company_key(c).alias("company_key"), text.title_key(t).alias("title_key"), text.vacancy_key(c, t).alias("vacancy_key")
    )


@query(f"""
WITH n AS (SELECT DISTINCT {d.company_key('company')} AS company_key, {d.title_key('title')} AS title_key FROM arrivals WHERE title IS NOT NULL AND company IS NOT NULL),
a AS (SELECT *, company_key || '|' || title_key AS vacancy_key, {d.words('title_key')} AS words, split_part(company_key, ' ', 1) AS block FROM n WHERE company_key <> ''),
h0 AS (SELECT record_id, status, coalesce(status_at, cast(first_seen AS DATE)) AS w, {d.company_key('company')} AS company_key, {d.title_key('title')} AS title_key FROM seen_jobs),
h AS (SELECT *, company_key || '|' || title_key AS vacancy_key, {d.words('title_key')} AS words, split_part(company_key, ' ', 1) AS block FROM h0),
c AS (SELECT a.vacancy_key, h.record_id, h.status, h.w, a.vacancy_key = h.vacancy_key AS exact FROM a JOIN h ON a.block = h.block
      WHERE a.vacancy_key = h.vacancy_key OR ({d.similar('a', 'h')}))
SELECT vacancy_key, record_id AS prior_id, exact, status FROM c
QUALIFY row_number() OVER (PARTITION BY vacancy_key ORDER BY exact DESC, status <> 'new' DESC, w DESC, record_id) = 1""")
def priors(spark, sf_dir):
    c, t = F.col("company"), F.col("title")
    vacs = table(spark, sf_dir, "arrivals").where(t.isNotNull() & c.isNotNull()).select(
        text.vacancy_key(c, t).alias("vacancy_key"), text.company_key(c).alias("company_key"), text.title_key(t).alias("title_key")
    ).where("company_key <> ''").distinct()
    return store.priors(vacs, _history(spark, sf_dir)).select("vacancy_key", "prior_id", "exact", "status")


# ---- the seen-set -----------------------------------------------------------------


@query("SELECT count(*) AS listings, count(DISTINCT vacancy_key) AS vacancies FROM seen_jobs WHERE vacancy_key <> ''")
def seen_counts(spark, sf_dir):
    return seen(spark, sf_dir).where("vacancy_key <> ''").agg(F.count("*").alias("listings"), F.count_distinct("vacancy_key").alias("vacancies"))


_STATUS_VALUES = "(VALUES " + ", ".join(f"('{s}')" for s in store.STATUSES) + ") s(status)"


def _status_sql(cond: str) -> str:
    return f"""SELECT s.status, coalesce(n, 0) AS vacancies FROM {_STATUS_VALUES} LEFT JOIN
    (SELECT status, count(DISTINCT vacancy_key) AS n FROM seen_jobs WHERE vacancy_key <> '' {cond} GROUP BY 1) c ON s.status = c.status"""


@query(_status_sql(""))
def status_counts(spark, sf_dir):
    return store.status_counts(seen(spark, sf_dir))


@query(_status_sql("AND (status = 'new' OR status_at >= DATE '2025-01-01')"))
def status_counts_since(spark, sf_dir):
    return store.status_counts(seen(spark, sf_dir), "2025-01-01")


@query(f"""WITH c AS ({_status_sql('')}), s AS (SELECT
  coalesce(sum(vacancies) FILTER (WHERE status IN ('applied','rejected','interview','offer')), 0)::BIGINT AS applied,
  coalesce(sum(vacancies) FILTER (WHERE status IN ('rejected','interview','offer')), 0)::BIGINT AS answered FROM c)
SELECT applied, answered, round(CASE WHEN applied = 0 THEN 0.0 ELSE answered / applied END, 6) AS rate FROM s""")
def response_rate(spark, sf_dir):
    return store.response_rate(store.status_counts(seen(spark, sf_dir)))


@query("""
WITH k AS (SELECT DISTINCT vacancy_key FROM seen_jobs WHERE vacancy_key <> ''),
a AS (SELECT vacancy_key, status, status_at FROM seen_jobs WHERE vacancy_key <> '' AND status <> 'new'
  QUALIFY row_number() OVER (PARTITION BY vacancy_key ORDER BY coalesce(status_at, DATE '0001-01-01') DESC, first_seen DESC, fingerprint DESC, record_id DESC) = 1)
SELECT vacancy_key, coalesce(status, 'new') AS status, status_at::VARCHAR AS status_at FROM k LEFT JOIN a USING (vacancy_key)""")
def status_current(spark, sf_dir):
    return store.current_status(seen(spark, sf_dir)).withColumn("status_at", F.col("status_at").cast("string"))


@query("""
SELECT vacancy_key, record_id, title, company, first_seen::VARCHAR AS first_seen, n AS listings FROM (
  SELECT *, count(*) OVER (PARTITION BY vacancy_key) AS n, row_number() OVER (PARTITION BY vacancy_key ORDER BY first_seen DESC, record_id DESC) AS r
  FROM seen_jobs WHERE status = 'new' AND vacancy_key <> '') WHERE r = 1""")
def worklist_by_status(spark, sf_dir):
    return store.by_status(seen(spark, sf_dir), "new").withColumn("first_seen", F.col("first_seen").cast("string"))


@query("""
SELECT vacancy_key, record_id, title, first_seen::VARCHAR AS first_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY vacancy_key ORDER BY first_seen DESC, record_id DESC) AS r FROM seen_jobs WHERE status = 'new' AND vacancy_key <> '')
WHERE r = 1 ORDER BY 4 DESC, record_id LIMIT 20""")
def worklist_top20(spark, sf_dir):
    w = store.by_status(seen(spark, sf_dir), "new").orderBy(F.desc("first_seen"), "record_id").limit(20)
    return w.select("vacancy_key", "record_id", "title", F.col("first_seen").cast("string").alias("first_seen"))


_FOUND = " OR ".join(f"coalesce({c}, '') ILIKE '%%{{}}%%'" for c in ("fingerprint", "company", "title", "url")).replace("%%", "%")


@query("SELECT record_id, title, company, row_number() OVER (ORDER BY first_seen DESC, record_id) AS place FROM seen_jobs WHERE " + _FOUND.replace("{}", "game%d_v"))
def find_listings(spark, sf_dir):
    """Wildcards stand for themselves; the order is part of the result (a report of one needle's rows)."""
    found = store.find(seen(spark, sf_dir), "GAME%d_v").select("record_id", "title", "company", "first_seen")
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("first_seen"), "record_id"))).drop("first_seen")


@query("SELECT record_id, title, company FROM seen_jobs WHERE " + _FOUND.replace("{}", "game"))
def find_plain(spark, sf_dir):
    return store.find(seen(spark, sf_dir), "GAME").select("record_id", "title", "company")


@query("SELECT record_id, fingerprint, first_seen::VARCHAR AS first_seen FROM seen_jobs ORDER BY first_seen DESC, record_id LIMIT 100")
def newest_listings(spark, sf_dir):
    return store.newest_first(seen(spark, sf_dir)).limit(100).select("record_id", "fingerprint", F.col("first_seen").cast("string").alias("first_seen"))


@query("SELECT record_id FROM seen_jobs WHERE NOT (status = 'new' AND first_seen < TIMESTAMP '2024-12-01')")
def prune(spark, sf_dir):
    return store.prune(seen(spark, sf_dir), "2024-12-01").select("record_id")


@query("SELECT vacancy_key, count(DISTINCT status) AS statuses FROM seen_jobs WHERE vacancy_key <> '' GROUP BY 1 HAVING count(DISTINCT status) > 1")
def disagreeing_statuses(spark, sf_dir):
    return store.disagreeing(seen(spark, sf_dir))


@query("""
WITH a AS (SELECT vacancy_key, status FROM seen_jobs WHERE vacancy_key <> '' AND status <> 'new'
  QUALIFY row_number() OVER (PARTITION BY vacancy_key ORDER BY coalesce(status_at, DATE '0001-01-01') DESC, first_seen DESC, fingerprint DESC, record_id DESC) = 1)
SELECT record_id, coalesce(status, 'new') AS status FROM arrivals LEFT JOIN a USING (vacancy_key)""")
def inherit_status(spark, sf_dir):
    return store.inherit_status(table(spark, sf_dir, "arrivals").select("record_id", "vacancy_key"), seen(spark, sf_dir)).select("record_id", "status")


@query(f"""
WITH k AS (SELECT *, {d.company_key('company')} || '|' || {d.title_key('title')} AS vk, {d.company_key('company')} AS ck FROM seen_jobs),
n AS (SELECT vk FROM k GROUP BY vk HAVING count(DISTINCT status) > 1),
a AS (SELECT vk, status, status_at, note FROM k JOIN n USING (vk) WHERE status <> 'new'
  QUALIFY row_number() OVER (PARTITION BY vk ORDER BY coalesce(status_at, DATE '0001-01-01') DESC, first_seen DESC, fingerprint DESC, record_id DESC) = 1)
SELECT record_id, vk AS vacancy_key, ck AS company_key, CASE WHEN a.vk IS NULL THEN k.status ELSE a.status END AS status,
  (CASE WHEN a.vk IS NULL THEN k.status_at ELSE a.status_at END)::VARCHAR AS status_at, CASE WHEN a.vk IS NULL THEN k.note ELSE a.note END AS note FROM k LEFT JOIN a USING (vk)""")
def reconcile_status(spark, sf_dir):
    """Keys computed anew, and vacancies whose listings disagree settled."""
    c, t = F.col("company"), F.col("title")
    return store.rekey(seen(spark, sf_dir), text.vacancy_key(c, t), text.company_key(c)).select(
        "record_id", "vacancy_key", "company_key", "status", F.col("status_at").cast("string").alias("status_at"), "note"
    )


_STATUS_AS = _status_sql("AND (status = 'new' OR status_at >= DATE '2025-01-01')")


@query(f"""WITH c AS ({_STATUS_AS}), s AS (SELECT sum(vacancies) FILTER (WHERE status IN ('applied','rejected','interview','offer')) AS a,
  sum(vacancies) FILTER (WHERE status IN ('rejected','interview','offer')) AS b FROM c)
SELECT 'listings' AS measure, count(*)::DOUBLE AS value FROM seen_jobs UNION ALL SELECT 'vacancies', count(DISTINCT vacancy_key)::DOUBLE FROM seen_jobs
UNION ALL SELECT status, vacancies::DOUBLE FROM c UNION ALL SELECT 'applications', a::DOUBLE FROM s UNION ALL SELECT 'answers', b::DOUBLE FROM s
UNION ALL SELECT 'response rate', round(CASE WHEN a = 0 THEN 0.0 ELSE b / a END, 6) FROM s""")
def tracker_stats(spark, sf_dir):
    return store.stats(seen(spark, sf_dir), "2025-01-01")


def _first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seen listing with the smallest id that has a vacancy key: what the write queries act on."""
    return seen(spark, sf_dir).where("vacancy_key <> ''").orderBy("record_id").limit(1)


@query("""
WITH x AS (SELECT vacancy_key, fingerprint FROM seen_jobs WHERE vacancy_key <> '' ORDER BY record_id LIMIT 1)
SELECT record_id, CASE WHEN hit THEN 'offer' ELSE status END AS status, (CASE WHEN hit THEN DATE '2025-05-05' ELSE status_at END)::VARCHAR AS status_at,
  CASE WHEN hit THEN 'by hand' ELSE note END AS note, (CASE WHEN s.fingerprint = (SELECT fingerprint FROM x) THEN least(first_seen, TIMESTAMP '2025-05-05') ELSE first_seen END)::VARCHAR AS first_seen
FROM (SELECT *, vacancy_key = (SELECT vacancy_key FROM x) OR fingerprint = (SELECT fingerprint FROM x) AS hit FROM seen_jobs) s""")
def add_listing(spark, sf_dir):
    """A listing entered by hand that is there already: its vacancy takes the status, no row is added."""
    own = _first_row(spark, sf_dir).select("fingerprint", "vacancy_key", F.lit(0).alias("ord"))
    _, after, _ = store.add(own, seen(spark, sf_dir), "2025-07-01 08:00:00", "offer", "2025-05-05", "by hand")
    return after.select("record_id", "status", F.col("status_at").cast("string").alias("status_at"), "note", F.col("first_seen").cast("string").alias("first_seen"))


@query("""WITH x AS (SELECT vacancy_key, fingerprint FROM seen_jobs WHERE vacancy_key <> '' ORDER BY record_id LIMIT 1)
SELECT source, count(*) AS listings FROM seen_jobs WHERE vacancy_key = (SELECT vacancy_key FROM x) AND fingerprint <> (SELECT fingerprint FROM x) GROUP BY source""")
def same_vacancy_elsewhere(spark, sf_dir):
    own = _first_row(spark, sf_dir).select("fingerprint", "vacancy_key")
    return store.same_vacancy_elsewhere(own, seen(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("listings"))


@query("""WITH x AS (SELECT vacancy_key FROM seen_jobs WHERE vacancy_key <> '' ORDER BY record_id LIMIT 1)
SELECT vacancy_key, 'applied' AS status, '2025-05-05' AS status_at, 'note' AS note, 1::BIGINT AS seq FROM x""")
def set_status(spark, sf_dir):
    """The event of a status set on the vacancy a fingerprint names."""
    key = _first_row(spark, sf_dir).first()
    events = spark.createDataFrame([], "vacancy_key string, status string, status_at date, note string, seq bigint")
    return store.set_status(events, seen(spark, sf_dir), key["vacancy_key"], "applied", "2025-05-05", "note").withColumn("status_at", F.col("status_at").cast("string"))


# ---- languages --------------------------------------------------------------------

_TOKS, _HITS = d.detect("text")
_LANG = f"""t AS (SELECT doc_id, lang, {_TOKS} AS toks FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, lang, len(toks) AS n, {_HITS} AS h FROM t),
x AS (SELECT doc_id, lang, CASE WHEN h[1].n = 0 THEN NULL WHEN n < {lang.SHORT_TEXT} THEN CASE WHEN h[2].n = 0 THEN h[1].lang END
  WHEN h[1].n >= {lang.MIN_HITS} AND h[1].n >= {lang.MIN_LEAD} * h[2].n AND h[1].n / n >= {lang.MIN_SHARE} THEN h[1].lang END AS language FROM h)"""


@query(f"WITH {_LANG} SELECT doc_id, language FROM x")
def ad_language(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    return lang.detect(docs, "text").select("doc_id", "language")


@query(f"WITH {_LANG} SELECT lang AS label, count(*) AS texts, count(*) FILTER (WHERE language = lang) AS agreeing FROM x WHERE lang IS NOT NULL GROUP BY 1")
def language_audit(spark, sf_dir):
    return lang.audit(spread(table(spark, sf_dir, "documents").select("text", "lang")), "text", "lang")


@query("SELECT word, language FROM (SELECT unnest(string_split(ws, ' ')) AS word, language FROM (VALUES "
       + ", ".join(f"({d.q(' '.join(sorted(set(ws.split()))))}, '{k}')" for k, ws in lang.WORDS.items())
       + ") v(ws, language)) QUALIFY count(*) OVER (PARTITION BY word) = 1")
def distinctive_words(spark, sf_dir):
    every = spark.createDataFrame(list(lang.WORDS.items()), "language string, ws string")
    words = every.select("language", F.explode(F.array_distinct(F.split("ws", " +"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min("language").alias("language")).where("n = 1").select("word", "language")


@query(f"SELECT doc_id, regexp_matches(lower(text), {d.q(lang.ENGLISH_WORKPLACE)}) AS english_workplace FROM documents WHERE text IS NOT NULL")
def english_workplace(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", lang.english_workplace(F.col("text")).alias("english_workplace"))


_AD = f"ads AS (SELECT listing_id, {d.description('description')} AS t FROM listings), {d.evidence('ads', 'listing_id', 't')}"


@query(f"""WITH {_AD} SELECT k AS listing_id, ad_language, array_to_string(required, ',') AS required, array_to_string(preferred, ',') AS preferred,
  array_to_string(waived, ',') AS waived, english_workplace FROM ev""")
def language_evidence(spark, sf_dir):
    """Languages each advert states as required, preferred or waived, by the nearest cue."""
    out = evidence.read_evidence(_ads(spark, sf_dir), "listing_id", "t")
    return out.select("listing_id", "ad_language", *[F.array_join(c, ",").alias(c) for c in ("required", "preferred", "waived")], "english_workplace")


def _ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ads = spread(table(spark, sf_dir, "listings").select("listing_id", "description"))
    return ads.select("listing_id", text.normalise_description(F.col("description")).alias("t"))


@query(f"WITH {_AD}, {d.verdict(verdict.Profile())} SELECT k AS listing_id, level, label, reason, stated FROM vd")
def language_verdict(spark, sf_dir):
    """Whether the default reader's languages suffice for each advert."""
    v = evidence.read_evidence(_ads(spark, sf_dir), "listing_id", "t").select("listing_id", verdict.verdict(verdict.Profile()).alias("v"))
    return v.select("listing_id", "v.level", "v.label", "v.reason", "v.stated")


@query(f"""WITH ads AS (SELECT doc_id, text FROM documents WHERE lang IS NOT NULL), {d.evidence('ads', 'doc_id', 'text')}, {d.verdict(verdict.Profile())}
SELECT k AS doc_id, level, label FROM vd WHERE level IN ('blocked', 'likely')""")
def audit_disagreements(spark, sf_dir):
    """The labelled texts a reader would not be told to be fine, with what the detector says."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).where("lang IS NOT NULL")
    v = evidence.read_evidence(docs, "doc_id", "text").select("doc_id", verdict.verdict(verdict.Profile()).alias("v"))
    return v.select("doc_id", "v.level", "v.label").where("level IN ('blocked', 'likely')")


# ---- ranking and report -----------------------------------------------------------

_SETTINGS = rank.Settings(keywords=("tester", "qa"), avoid={"sap": 10})
_TODAY = "2025-06-30"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings to scored vacancies, with language verdict and history."""
    u = cut(unique_listings(spark, sf_dir))  # read four times
    texts = cut(entity.vacancy_text(u))  # read for the words and for the evidence
    priors_ = store.priors(u.select("vacancy_key", "company_key", "title_key").distinct(), _history(spark, sf_dir), u)
    prior = priors_.select("vacancy_key", F.struct("status", "title", "when", "first_seen", "exact").alias("prior"))
    full = (
        entity.vacancies(u).join(texts, "vacancy_key").join(evidence.read_evidence(texts, "vacancy_key", "text"), "vacancy_key").join(prior, "vacancy_key", "left")
    )
    return rank.score(full, _SETTINGS, F.lit(_TODAY).cast("date"))


def _hit(text_: str, word: str) -> str:
    return f"regexp_matches({text_}, '(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])')"


def _weights(text_: str, ws: dict[str, int], cap: int) -> str:
    return f"least({' + '.join(f'CASE WHEN {_hit(text_, w)} THEN {p} ELSE 0 END' for w, p in sorted(ws.items()))}, {cap})"


_N_KEYS = " + ".join(f"CASE WHEN contains(lower(title), '{k}') THEN 1 ELSE 0 END" for k in _SETTINGS.keywords)
_RANK_SQL = f"""
WITH {d.LISTINGS}, f AS (SELECT *, {_TAGS} FROM u),
g AS (SELECT vacancy_key, count(*) AS listings, first(title ORDER BY {_ORDER}) AS title, first(company ORDER BY {_ORDER}) AS company, first(url ORDER BY {_ORDER}) AS url,
  coalesce(first(location ORDER BY {_ORDER}) FILTER (WHERE location <> ''), '') AS location, min(posted) AS posted,
  list_sort(list_distinct(flatten(list(ntags)))) AS tags, string_agg(DISTINCT description, chr(10)) AS body FROM f GROUP BY 1),
s AS (SELECT *, lower(title || chr(10) || coalesce(body, '')) AS low, {_N_KEYS} AS nk, array_to_string(tags, ' ') AS tagtext,
  regexp_extract(lower(location), '^remote \\((.*)\\)$', 1) AS lim FROM g), tx AS (SELECT vacancy_key, title || chr(10) || coalesce(body, '') AS t FROM g),
{d.evidence('tx', 'vacancy_key', 't')}, {d.verdict(_SETTINGS.profile)},
vk AS (SELECT DISTINCT vacancy_key, company_key, title_key, {d.words('title_key')} AS words, split_part(company_key, ' ', 1) AS block FROM u),
h0 AS (SELECT record_id, status, fingerprint, title, cast(first_seen AS DATE) AS fs, coalesce(status_at, cast(first_seen AS DATE)) AS w, {d.company_key('company')} AS company_key,
  {d.title_key('title')} AS title_key FROM seen_jobs),
h AS (SELECT *, company_key || '|' || title_key AS vacancy_key, {d.words('title_key')} AS words, split_part(company_key, ' ', 1) AS block FROM h0),
pc AS (SELECT a.vacancy_key, h.record_id, h.status, h.title, h.w, h.fs, h.fingerprint, a.vacancy_key = h.vacancy_key AS exact FROM vk a JOIN h ON a.block = h.block
  WHERE a.vacancy_key = h.vacancy_key OR ({d.similar('a', 'h')})),
pr AS (SELECT pc.* FROM pc LEFT JOIN (SELECT DISTINCT vacancy_key, fingerprint FROM u) o ON o.vacancy_key = pc.vacancy_key AND o.fingerprint = pc.fingerprint
  WHERE NOT (pc.status = 'new' AND o.fingerprint IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY pc.vacancy_key ORDER BY exact DESC, status <> 'new' DESC, w DESC, record_id) = 1),
lp AS (SELECT s.*, vd.level, vd.stated, vd.soft, vd.label, vd.reason, pr.status AS pstatus, CASE level WHEN 'blocked' THEN -60 WHEN 'likely' THEN -35
  WHEN 'plus' THEN CASE WHEN len(list_filter(soft, lambda x: x <> 'da')) > 0 THEN -10 ELSE -5 END WHEN 'ok' THEN CASE WHEN stated THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN pr.status IN ('applied', 'rejected', 'interview', 'offer') THEN -50 WHEN pr.status = 'skipped' THEN -30 ELSE 0 END AS extra
  FROM s JOIN vd ON vd.k = s.vacancy_key LEFT JOIN pr ON pr.vacancy_key = s.vacancy_key),
p AS (SELECT *, CASE WHEN nk > 0 THEN least(15 + 5 * (nk - 1), 25) WHEN {' OR '.join(f"contains(tagtext, '{k}')" for k in _SETTINGS.keywords)} THEN -10 ELSE 0 END
  + {_weights('low', _SETTINGS.boost, 20)} - {_weights('lower(title)', _SETTINGS.penalise, 40)} - {_weights('low', _SETTINGS.avoid, 40)}
  - CASE WHEN regexp_matches(lower(location), '^remote \\(.*\\)$') AND NOT ({' OR '.join(_hit('lim', r) for r in _SETTINGS.remote_regions)}) THEN 25 ELSE 0 END
  - CASE WHEN date_diff('day', posted, DATE '{_TODAY}') > 45 THEN 10 ELSE 0 END + extra AS points FROM lp),
r AS (SELECT vacancy_key, company, title, url, location, listings, level, label, pstatus, greatest(0, least(100, 50 + points))::INT AS score FROM p),
ranked AS (SELECT *, CASE WHEN level = 'blocked' OR pstatus IN ('applied', 'rejected', 'interview', 'offer') THEN 'unviable' WHEN score >= 55 AND level <> 'likely' THEN 'viable'
  WHEN score >= 30 THEN 'long shot' ELSE 'unviable' END AS tier FROM r)
"""


@query(_RANK_SQL + "SELECT vacancy_key, company, title, score, tier, level, label, pstatus AS prior FROM ranked")
def ranked(spark, sf_dir):
    return _ranked(spark, sf_dir).select("vacancy_key", "company", "title", "score", "tier", "verdict.level", "verdict.label", F.col("prior.status").alias("prior"))


@query(_RANK_SQL + "SELECT vacancy_key, tier, score FROM ranked WHERE tier <> 'unviable'")
def viable_only(spark, sf_dir):
    """The list with the vacancies hidden that are not viable."""
    return _ranked(spark, sf_dir).where(F.col("tier") != rank.TIERS[2]).select("vacancy_key", "tier", "score")


@query(_RANK_SQL + "SELECT vacancy_key, company, score FROM ranked ORDER BY lower(company), vacancy_key LIMIT 50")
def sorted_by_company(spark, sf_dir):
    """A list sorted by another column: text without regard to case, then the key."""
    return _ranked(spark, sf_dir).orderBy(F.lower("company"), "vacancy_key").limit(50).select("vacancy_key", "company", "score")


@query(_RANK_SQL + "SELECT tier, count(*) AS vacancies, sum(listings)::BIGINT AS listings FROM ranked GROUP BY 1")
def tier_summary(spark, sf_dir):
    return report.tier_summary(_ranked(spark, sf_dir))


@query(_RANK_SQL + """SELECT '  ' || lpad(score::VARCHAR, 3, ' ') || '  ' || company || ': ' || title || CASE WHEN location <> '' THEN '  [' || location || ']' ELSE '' END AS line FROM ranked
ORDER BY CASE tier WHEN 'viable' THEN 0 WHEN 'long shot' THEN 1 ELSE 2 END, score DESC, lower(company), lower(title), url LIMIT 20""")
def report_lines(spark, sf_dir):
    return _ranked(spark, sf_dir).orderBy(*rank.order_columns()).limit(20).select(report.line().alias("line"))


@query(_RANK_SQL + """SELECT vacancy_key, tier, row_number() OVER (PARTITION BY tier ORDER BY score DESC, lower(company), lower(title), url, vacancy_key) AS place FROM ranked
QUALIFY place <= 10""")
def tier_top10(spark, sf_dir):
    w = W.partitionBy("tier").orderBy(F.desc("score"), F.lower("company"), F.lower("title"), "url", "vacancy_key")
    return _ranked(spark, sf_dir).select("vacancy_key", "tier", F.row_number().over(w).alias("place")).where("place <= 10")


# ---- sources ----------------------------------------------------------------------


def _board_payloads(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Payloads of 500 listings each, as a board of that kind would send them."""
    rows = table(spark, sf_dir, "listings").select(
        F.floor(F.col("listing_id") / 500).alias("page"), F.col("listing_id").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company", F.lit("")).alias("company"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("location", F.lit("")).alias("location"),
        F.col("posted").cast("string").alias("posted"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("description", F.lit("")).alias("description"),
    )
    item = {
        "remotive": F.struct("title", F.col("company").alias("company_name"), "url", F.col("location").alias("candidate_required_location"), F.col("posted").alias("publication_date"), "tags", "description"),
        "greenhouse": F.struct("title", F.col("url").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"), F.col("posted").alias("updated_at"), F.col("description").alias("content")),
    }[kind]
    payload = F.to_json(F.struct(F.collect_list(item).alias("jobs")))
    return rows.groupBy("page").agg(payload.alias("payload")).select(F.lit(kind).alias("source"), F.lit(kind).alias("kind"), F.lit("Some Employer").alias("company"), "payload")


@query(f"""SELECT {d.norm_title('title')} AS title, {d.norm('company')} AS company, {d.url('url')} AS url, count(*) AS n FROM listings
WHERE {d.norm_title('title')} <> '' AND {d.norm('company')} <> '' GROUP BY ALL""")
def json_board(spark, sf_dir):
    out = filters.normalise_listings(parse.parse(_board_payloads(spark, sf_dir, "remotive")))
    return out.groupBy("title", "company", "url").agg(F.count("*").alias("n"))


@query(f"""SELECT {d.norm_title('title')} AS title, {d.url('url')} AS url, posted::VARCHAR AS posted, count(*) AS n FROM listings WHERE {d.norm_title('title')} <> '' GROUP BY ALL""")
def ats_board(spark, sf_dir):
    out = filters.normalise_listings(parse.parse(_board_payloads(spark, sf_dir, "greenhouse")))
    return out.groupBy("title", "url", F.col("posted").cast("string").alias("posted")).agg(F.count("*").alias("n"))


def _c(old: str, new: str):
    return F.col(old).alias(new)


#: Of each kind of board: list of its items ('' for a bare array), item, whether it names the company, how it writes a place.
_BOARDS = {
    "lever": ("", lambda: F.struct(_c("title", "text"), _c("url", "hostedUrl"), F.struct("location").alias("categories"), F.unix_millis(F.to_timestamp("posted")).alias("createdAt")), False, "plain"),
    "ashby": ("jobs", lambda: F.struct("title", _c("url", "jobUrl"), "location", _c("even", "isRemote"), _c("posted", "publishedAt")), False, "flag"),
    "workable": ("jobs", lambda: F.struct("title", "url", _c("location", "city"), _c("even", "telecommuting"), _c("posted", "published_on")), False, "flag"),
    "smartrecruiters": ("content", lambda: F.struct("id", _c("title", "name"), F.struct(_c("location", "city"), _c("even", "remote")).alias("location"), _c("posted", "releasedDate")), False, "flag"),
    "breezy": ("", lambda: F.struct(_c("title", "name"), "url", F.struct(_c("location", "name"), _c("even", "is_remote")).alias("location"), _c("posted", "published_date")), False, "flag"),
    "recruitee": ("offers", lambda: F.struct("title", _c("url", "careers_url"), "location", _c("even", "remote"), _c("posted", "published_at")), False, "flag"),
    "remoteok": ("", lambda: F.struct(_c("title", "position"), "company", "url", "location", _c("posted", "date")), True, "remote"),
    "jobicy": ("jobs", lambda: F.struct(_c("title", "jobTitle"), _c("company", "companyName"), "url", _c("location", "jobGeo"), _c("posted", "pubDate")), True, "remote"),
    "himalayas": ("jobs", lambda: F.struct("title", _c("company", "companyName"), _c("url", "applicationLink"), F.array("location").alias("locationRestrictions"), _c("posted", "pubDate")), True, "remote"),
    "arbeitnow": ("data", lambda: F.struct("title", _c("company", "company_name"), "url", "location", _c("even", "remote"), _c("posted", "created_at")), True, "flag"),
    "jobtech": ("hits", lambda: F.struct(_c("title", "headline"), F.struct(_c("company", "name")).alias("employer"), _c("url", "webpage_url"), F.struct(_c("location", "municipality")).alias("workplace_address"),
                                         _c("posted", "publication_date")), True, "plain"),
}
_PLACES = {
    "plain": d.norm("location"),
    "flag": d.norm("CASE WHEN listing_id % 2 = 0 THEN CASE WHEN coalesce(location, '') <> '' AND lower(location) <> 'remote' THEN 'Remote (' || location || ')' ELSE 'Remote' END ELSE coalesce(location, '') END"),
    "remote": f"CASE WHEN {d.norm('location')} = '' THEN 'Remote' WHEN lower({d.norm('location')}) IN ('anywhere', 'worldwide', 'remote', 'anywhere in the world') THEN 'Remote (Worldwide)' ELSE 'Remote (' || {d.norm('location')} || ')' END",
}


def _board_query(kind: str) -> None:
    items, item, names_company, place = _BOARDS[kind]
    company = d.norm("company") if names_company else "'Some Employer'"
    url = "'https://jobs.smartrecruiters.com/acme/' || listing_id" if kind == "smartrecruiters" else d.url("url")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "listings").select(
            F.floor(F.col("listing_id") / 500).alias("page"), F.col("listing_id").cast("string").alias("id"), (F.col("listing_id") % 2 == 0).alias("even"),
            *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "company", "url", "location")], F.col("posted").cast("string").alias("posted"),
        )
        listed = F.collect_list(item())
        payload = F.to_json(F.struct(listed.alias(items)) if items else listed)
        made = rows.groupBy("page").agg(payload.alias("payload")).select(F.lit(kind).alias("source"), F.lit(kind).alias("kind"), F.lit("Some Employer").alias("company"), F.lit("acme").alias("slug"), "payload")
        out = filters.normalise_listings(parse.parse(made))
        return out.groupBy("title", "company", "url", "location", F.col("posted").cast("string").alias("posted")).agg(F.count("*").alias("n"))

    run.__name__ = f"board_{kind}"
    query(f"""SELECT {d.norm_title('title')} AS title, {company} AS company, {url} AS url, {_PLACES[place]} AS location, posted::VARCHAR AS posted, count(*) AS n
FROM listings WHERE {d.norm_title('title')} <> '' AND {company} <> '' GROUP BY ALL""")(run)


for _kind in _BOARDS:
    _board_query(_kind)


@query(f"""SELECT {d.norm_title('title')} AS title, {d.norm('company')} AS company, {d.url('url')} AS url, {d.norm('location')} AS location, count(*) AS n
FROM listings WHERE {d.norm_title('title')} <> '' AND {d.norm('company')} <> '' GROUP BY ALL""")
def page_cards(spark, sf_dir):
    """Dumps of page cards, 500 a page."""
    rows = table(spark, sf_dir, "listings").select(F.floor(F.col("listing_id") / 500).alias("page"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "company", "url", "location")])
    dumps = rows.groupBy("page").agg(F.to_json(F.collect_list(F.struct("title", "company", "url", "location"))).alias("payload")).select(F.lit("cards").alias("source"), "payload")
    return filters.normalise_listings(parse.parse_cards(dumps)).groupBy("title", "company", "url", "location").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT listing_id AS ord, unnest(tags) AS c, coalesce(title, '') AS text FROM listings), f AS (SELECT *, 'div.' || c AS selector FROM e
  WHERE length(text) >= 8 AND regexp_full_match(c, '[A-Za-z_][0-9A-Za-z_-]*')
  AND NOT regexp_matches(lower(c), '^(icon|btn|button|col|row|container|wrapper|flex|grid|hidden|sr-only|active|nav|menu|footer|header|logo|social)')),
g AS (SELECT selector, count(*) AS cards, min(ord) AS first FROM f GROUP BY 1 HAVING count(*) >= 3)
SELECT selector, cards, cards * CASE WHEN regexp_matches(lower(selector), 'job|card|vacanc|posting|listing|result|item') THEN 2 ELSE 1 END AS score FROM g
ORDER BY score DESC, cards DESC, first LIMIT 10""")
def card_candidates(spark, sf_dir):
    """The tags of listings taken for the classes of a page's elements."""
    els = table(spark, sf_dir, "listings").where("tags IS NOT NULL").select(F.lit("div").alias("tag"), F.col("tags").alias("classes"), F.lit(True).alias("has_link"), F.coalesce("title", F.lit("")).alias("text"), F.col("listing_id").alias("ord"))
    return parse.card_candidates(els).select("selector", "cards", "score")


@query("SELECT source, count(*) AS listings, count(*) FILTER (WHERE location IS NULL OR trim(location) = '') AS without_place FROM (SELECT lower(%s) AS source, location FROM listings) GROUP BY 1" % d.norm("source"))
def source_summary(spark, sf_dir):
    s = table(spark, sf_dir, "listings").select(F.lower(text.normalise_text(F.col("source"))).alias("source"), "location")
    return s.groupBy("source").agg(F.count("*").alias("listings"), F.count(F.when(F.col("location").isNull() | (F.trim("location") == ""), 1)).alias("without_place"))


@query(f"WITH {d.LISTINGS} SELECT fingerprint, title, company FROM u")
def stream_new_listings(spark, sf_dir):
    """The incremental mode over the listing files, into an empty seen-set."""
    raw = table(spark, sf_dir, "listings")
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    at = f"{base}/stream-{uuid.uuid4().hex}"
    seen_stream.run_available(spark, f"{sf_dir}/listings.parquet", raw.schema, f"{at}/seen", f"{at}/progress")
    return spark.read.parquet(f"{at}/seen").select("fingerprint", "title", "company")
