"""Payloads of boards to raw listings, in one pass and without Python workers.

A payload row has source, kind, payload and, where an employer's own board leaves it out,
company (further settings come from ``slug``, null when absent). Each kind is a spec: where its
items are and what each listing field is made of. Malformed payloads have no items and a
malformed item costs that item only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates, text


def item() -> Column:
    return F.col("item")


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item(), f"$.{path}", kind)


def first_of(*paths: str) -> Column:
    """The first field that is neither missing nor empty, '' without one."""
    return F.coalesce(*[F.nullif(get(p), F.lit("")) for p in paths], F.lit(""))


def many(*paths: str) -> Column:
    """Fields that hold a string or a list of strings, as one array."""
    parts = []
    for p in paths:
        one = F.nullif(get(p), F.lit(""))
        parts.append(F.coalesce(get(p, "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")))
    return F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != ""))


def joined(sep: str, *cols: Column) -> Column:
    return F.array_join(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")), sep)


def is_true(path: str) -> Column:
    return F.coalesce(F.lower(get(path)) == "true", F.lit(False))


def remote(flag: Column, place: Column) -> Column:
    named = (place != "") & (F.lower(place) != "remote")
    return F.when(flag, F.when(named, F.concat(F.lit("Remote ("), place, F.lit(")"))).otherwise(F.lit("Remote"))).otherwise(place)


def board_date(*paths: str) -> Column:
    return dates.parse_date(first_of(*paths))


def nothing() -> Column:
    return F.array().cast("array<string>")


def empty() -> Column:
    return F.lit("")


def own() -> Column:
    return F.col("company")


def slug() -> Column:
    return F.coalesce(F.col("slug"), F.lit(""))


@dataclass(frozen=True)
class Spec:
    items: str  # path of the list, '' for a bare array
    title: Column
    company: Column
    url: Column
    location: Column = field(default_factory=empty)
    posted: Column = field(default_factory=lambda: F.lit(None).cast("date"))
    tags: Column = field(default_factory=nothing)
    description: Column = field(default_factory=empty)
    keep: Column | None = None


def _specs(remote_only: bool = False) -> dict[str, Callable[[], Spec]]:
    place = lambda a, b: joined(", ", get(a), get(b))
    lists = F.transform(
        F.coalesce(get("lists", "array<variant>"), F.array().cast("array<variant>")),
        lambda b: joined("\n", F.try_variant_get(b, "$.text", "string"), F.try_variant_get(b, "$.content", "string")),
    )
    restrictions = F.coalesce(
        F.array_join(F.transform(get("locationRestrictions", "array<variant>"), lambda r: F.coalesce(F.try_variant_get(r, "$.name", "string"), F.try_variant_get(r, "$", "string"))), ", "),
        first_of("locationRestrictions"),
    )
    return {
        "greenhouse": lambda: Spec("jobs", get("title"), own(), get("absolute_url"), first_of("location.name"), board_date("updated_at", "first_published"), description=first_of("content")),
        "lever": lambda: Spec(
            "", get("text"), own(), first_of("hostedUrl", "applyUrl"), first_of("categories.location"), dates.epoch_millis_date(get("createdAt")), many("categories.team"),
            F.array_join(F.filter(F.concat(F.array(first_of("descriptionPlain", "description")), lists, F.array(first_of("additionalPlain", "additional"))), lambda x: x != ""), "\n"),
        ),
        "ashby": lambda: Spec(
            "jobs", get("title"), own(), first_of("jobUrl", "applyUrl"), remote(is_true("isRemote"), first_of("location")), board_date("publishedAt"),
            many("department", "team"), first_of("descriptionPlain", "descriptionHtml"), keep=F.coalesce(F.lower(get("isListed")) != "false", F.lit(True)),
        ),
        "workable": lambda: Spec(
            "jobs", get("title"), F.coalesce(F.nullif(own(), empty()), F.nullif(F.try_variant_get("v", "$.name", "string"), empty()), slug()), first_of("url", "shortlink"),
            remote(is_true("telecommuting"), place("city", "country")), board_date("published_on", "created_at"), many("department"), first_of("description"),
        ),
        "smartrecruiters": lambda: Spec(
            "content", get("name"), F.coalesce(F.nullif(own(), empty()), F.nullif(get("company.name"), empty()), slug()),
            F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug(), F.lit("/"), F.coalesce(get("id"), empty())),
            remote(is_true("location.remote"), place("location.city", "location.country")), board_date("releasedDate"),
        ),
        "breezy": lambda: Spec(
            "", get("name"), F.coalesce(F.nullif(get("company.name"), empty()), own()),
            F.coalesce(F.nullif(get("url"), empty()), F.concat(F.lit("https://"), slug(), F.lit(".breezy.hr/p/"), F.coalesce(get("friendly_id"), empty()))),
            remote(is_true("location.is_remote"), F.coalesce(F.nullif(get("location.name"), empty()), joined(", ", get("location.city"), F.coalesce(get("location.country.name"), get("location.country"))))),
            board_date("published_date"), F.concat(many("department"), F.coalesce(F.array(F.nullif(get("type.name"), empty())), many("type"))),
        ),
        "recruitee": lambda: Spec(
            "offers", get("title"), F.coalesce(F.nullif(own(), empty()), F.nullif(get("company_name"), empty()), slug()),
            F.coalesce(F.nullif(get("careers_url"), empty()), F.concat(F.lit("https://"), slug(), F.lit(".recruitee.com/o/"), F.coalesce(get("slug"), empty()))),
            remote(is_true("remote"), F.coalesce(F.nullif(get("location"), empty()), place("city", "country"))), board_date("published_at", "created_at"), many("department"),
            joined(" ", text.plain(get("description")), text.plain(get("requirements"))),
        ),
        "remotive": lambda: Spec(
            "jobs", get("title"), get("company_name"), get("url"), dates.remote_location(get("candidate_required_location")), board_date("publication_date"),
            many("tags", "category"), first_of("description"),
        ),
        # The first element is a notice; a job has a position field.
        "remoteok": lambda: Spec(
            "", get("position"), get("company"), first_of("url", "apply_url"), dates.remote_location(get("location")), board_date("date", "epoch"), many("tags"),
            first_of("description"), keep=get("position").isNotNull(),
        ),
        "jobicy": lambda: Spec(
            "jobs", get("jobTitle"), get("companyName"), get("url"), dates.remote_location(get("jobGeo")), board_date("pubDate"), many("jobIndustry", "jobLevel"),
            first_of("jobDescription", "jobExcerpt"),
        ),
        "himalayas": lambda: Spec(
            "jobs", get("title"), get("companyName"), first_of("applicationLink", "guid"), dates.remote_location(restrictions), board_date("pubDate"),
            many("categories", "seniority"), first_of("description", "excerpt"),
        ),
        "arbeitnow": lambda: Spec(
            "data", get("title"), get("company_name"), get("url"), remote(is_true("remote"), first_of("location")), board_date("created_at"), many("tags", "job_types"),
            first_of("description"), keep=(is_true("remote") if remote_only else None),
        ),
        "jobtech": lambda: Spec(
            "hits", get("headline"), first_of("employer.name", "employer.workplace"),
            F.coalesce(F.nullif(get("webpage_url"), empty()), F.concat(F.lit("https://arbetsformedlingen.se/platsbanken/annonser/"), F.coalesce(get("id"), empty()))),
            place("workplace_address.municipality", "workplace_address.country"), board_date("publication_date"), description=first_of("description.text", "description"),
        ),
    }


LISTING = ("title", "company", "url", "location", "posted", "tags", "description")


def _field(name: str) -> Callable[[Spec], Column]:
    return lambda spec: getattr(spec, name)


def parse(payloads: DataFrame, remote_only: bool = False) -> DataFrame:
    """(source, title, company, url, location, posted, tags, description) of JSON payloads.

    ``remote_only`` keeps the remote postings of the kind that takes no such parameter.
    """
    cols = [c for c in ("source", "kind", "payload") if c in payloads.columns]
    base = payloads.select(
        *cols, (F.col("company") if "company" in payloads.columns else F.lit(None).cast("string")).alias("company"),
        (F.col("slug") if "slug" in payloads.columns else F.lit(None).cast("string")).alias("slug"), F.try_parse_json("payload").alias("v"),
    )
    specs = {k: make() for k, make in _specs(remote_only).items()}

    def by_kind(value: Callable[[Spec], Column]) -> Column:
        out = None
        for k, s in specs.items():
            cond = F.col("kind") == k
            out = F.when(cond, value(s)) if out is None else out.when(cond, value(s))
        return out

    items = by_kind(lambda s: F.try_variant_get("v", f"$.{s.items}" if s.items else "$", "array<variant>"))
    exploded = base.select("source", "kind", "company", "slug", "v", F.posexplode(items).alias("pos", "item"))
    kept = exploded.where(by_kind(lambda s: s.keep if s.keep is not None else F.lit(True)))
    return kept.select("source", *[by_kind(_field(n)).alias(n) for n in LISTING])


def parse_custom(payloads: DataFrame, items: str, title: str, url_template: str, company: str, page_url: str = "", location: str = "", description: str = "description") -> DataFrame:
    """Any JSON list of openings: dotted path, field names and a link template '{field}'.

    An item that lacks a field of the template is left out.
    """
    rows = payloads.select("source", F.explode(F.try_variant_get(F.try_parse_json("payload"), f"$.{items}" if items else "$", "array<variant>")).alias("item"))
    parts: list[Column] = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", url_template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(get(name))
    link = F.concat(*parts) if parts else F.lit(page_url)
    place = text.plain(get(location)) if location else F.lit("")
    return rows.select(
        "source", text.plain(get(title)).alias("title"), F.lit(company).alias("company"), link.alias("url"), place.alias("location"),
        F.lit(None).cast("date").alias("posted"), nothing().alias("tags"), text.plain(get(description)).alias("description"),
    ).where("url IS NOT NULL")


RSS = (
    "channel struct<item: array<struct<title: string, link: string, author: string, `dc:creator`: string, publisher: string, `dc:publisher`: string, source: struct<_VALUE: string>,"
    " pubDate: string, published: string, updated: string, category: array<string>, description: string, `content:encoded`: string, location: string, where: string, region: string>>>"
)
# Places looked for, in this order, where a feed states none.
LOCATION_HINTS = (
    "Kongens Lyngby", "Copenhagen", "Kobenhavn", "Kobenhavn", "Kobenhavn V", "Frederiksberg", "Frederiksborg", "Hillerod", "Roskilde", "Ballerup", "Glostrup", "Brondby", "Taastrup",
    "Herlev", "Soborg", "Horsholm", "Kolding", "Esbjerg", "Randers", "Horsens", "Silkeborg", "Vejle", "Aalborg", "Alborg", "Aarhus", "Arhus", "Odense", "Viborg", "Lyngby", "Helsingborg",
    "Stockholm", "Gothenburg", "Goteborg", "Lund", "Malmo", "Jylland", "Jutland", "Sjaelland", "Zealand", "Fyn", "Funen", "Denmark", "Danmark", "Sweden", "Sverige", "Remote", "Hybrid",
)
NO_PERMIT = "Work permit: the employer accepts candidates without a Canadian work permit."
PERMIT_NEEDED = "Work permit: the employer accepts only Canadian citizens, permanent residents or holders of a Canadian work permit."
# Country names by the code a career site puts behind the city.
COUNTRIES = {
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "CA": "Canada", "CH": "Switzerland", "CN": "China", "CZ": "Czechia", "DE": "Germany", "DK": "Denmark", "EE": "Estonia", "ES": "Spain",
    "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GR": "Greece", "HR": "Croatia", "HU": "Hungary", "IE": "Ireland", "IN": "India", "IT": "Italy", "LT": "Lithuania",
    "LU": "Luxembourg", "LV": "Latvia", "MT": "Malta", "MX": "Mexico", "NL": "Netherlands", "NO": "Norway", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SE": "Sweden", "SI": "Slovenia",
    "SK": "Slovakia", "US": "United States",
}
# End of fixed values.


def _given(*cols: Column) -> Column:
    """The first that is neither null nor blank, null without one."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def _rss_entries(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    return payloads.select("source", F.explode(F.from_xml("payload", RSS)["channel"]["item"]).alias("e")).select(
        "source", e["title"].alias("title"), F.trim(e["link"]).alias("link"), _given(e["author"], e["dc:creator"]).alias("author"), _given(e["publisher"], e["dc:publisher"]).alias("publisher"),
        _given(e["source"]["_VALUE"]).alias("origin"), F.coalesce(e["pubDate"], e["published"], e["updated"]).alias("day"), F.coalesce(e["category"], nothing()).alias("terms"),
        e["description"].alias("summary"), F.array(e["content:encoded"]).alias("contents"), _given(e["location"], e["where"], e["region"]).alias("place"),
    )


def _element(block: Column, name: str) -> Column:
    """Text of an XML element, without a CDATA wrapping, entities undone; '' without one."""
    raw = F.regexp_extract(block, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.trim(text.unescape(F.regexp_replace(raw, r"<!\[CDATA\[|\]\]>", "")))


def _atom_entries(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    block = payloads.select("source", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("e"))
    links = F.regexp_extract_all(e, F.lit(r"<link\b[^>]*>"), F.lit(0))
    page = F.coalesce(F.try_element_at(F.filter(links, lambda x: ~x.rlike("rel=") | x.rlike("rel=[\"'](?:alternate)[\"']")), F.lit(1)), F.try_element_at(links, F.lit(1)))
    return block.select(
        "source", _element(e, "title").alias("title"), text.unescape(F.regexp_extract(page, r"""href=["']([^"']+)""", 1)).alias("link"),
        _given(_element(F.regexp_extract(e, r"(?s)<author\b.*?</author>", 0), "name")).alias("author"), _given(_element(e, "publisher")).alias("publisher"),
        _given(_element(F.regexp_extract(e, r"(?s)<source\b.*?</source>", 0), "title")).alias("origin"), _given(_element(e, "published"), _element(e, "updated"), _element(e, "created")).alias("day"),
        F.regexp_extract_all(e, F.lit(r"""<category\b[^>]*\bterm=["']([^"']+)"""), F.lit(1)).alias("terms"), F.nullif(_element(e, "summary"), F.lit("")).alias("summary"),
        F.array(_element(e, "content")).alias("contents"), _given(_element(e, "location"), _element(e, "where"), _element(e, "region")).alias("place"),
    )


def _feed_listings(entries: DataFrame, company_in_title: bool, company_before_colon: bool, title_pattern: str, employer: str, default_company: str) -> DataFrame:
    entries = entries.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))
    raw = F.trim("title")
    company, title, location = F.lit(""), raw, F.lit("")
    if company_before_colon:
        cut = F.instr(raw, ": ")
        company = F.when(cut > 0, F.trim(raw.substr(F.lit(1), cut - 1))).otherwise("")
        title = F.when(cut > 0, F.trim(raw.substr(cut + 2, F.length(raw)))).otherwise(raw)
    elif company_in_title:
        s = dates.split_title_company(raw)
        title, company = s["title"], s["company"]
    if title_pattern:
        whole = f"^(?:{title_pattern})$"
        at = {name: i for i, name in enumerate(re.findall(r"\((?:\?<(\w+)>|(?!\?))", title_pattern), 1)}
        hit = raw.rlike(whole)
        pick = lambda name: F.regexp_extract(raw, whole, at[name]) if name in at else F.lit("")
        company, location = F.when(hit, pick("company")).otherwise(company), F.when(hit, dates.place_or_remote(pick("location"))).otherwise(location)
        title = F.when(hit & (pick("title") != ""), pick("title")).otherwise(title)
    byline = F.coalesce("author", "publisher", "origin", F.try_element_at(F.filter("terms", lambda t: t != ""), F.lit(1)), F.lit(default_company) if default_company else F.col("source"))
    company = F.lit(employer) if employer else F.coalesce(F.nullif(company, F.lit("")), byline)
    hints = list(LOCATION_HINTS)
    guessed = F.coalesce(F.nullif(dates.location_hint(F.col("summary"), hints), F.lit("")), dates.location_hint(F.col("title"), hints))
    # The longest of contents and summary; the earlier of equally long ones.
    bodies = F.filter(F.concat("contents", F.array("summary")), lambda x: x.isNotNull() & (x != ""))
    longest = F.aggregate(bodies, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    tags = F.concat(F.filter("terms", lambda t: t != ""), dates.bracket_tags(F.trim(F.coalesce("summary", F.lit("")))))
    return entries.select(
        "source", title.alias("title"), company.alias("company"), F.trim("link").alias("url"), F.coalesce(F.nullif(location, F.lit("")), "place", guessed, F.lit("")).alias("location"),
        dates.feed_date(F.col("day")).alias("posted"), tags.alias("tags"), longest.alias("description"),
    )


def parse_rss(
    payloads: DataFrame, company_in_title: bool = False, company_before_colon: bool = False, title_pattern: str = "", employer: str = "", default_company: str = ""
) -> DataFrame:
    """Listings of RSS feeds. title_pattern has the groups (?<company>), (?<title>), (?<location>)."""
    return _feed_listings(_rss_entries(payloads), company_in_title, company_before_colon, title_pattern, employer, default_company)


def parse_atom(
    payloads: DataFrame, company_in_title: bool = False, company_before_colon: bool = False, title_pattern: str = "", employer: str = "", default_company: str = ""
) -> DataFrame:
    """Listings of Atom feeds, by the same rules as RSS."""
    return _feed_listings(_atom_entries(payloads), company_in_title, company_before_colon, title_pattern, employer, default_company)


def who_can_apply(page: Column) -> Column:
    """The sentence of a posting's page on who may apply (400 characters at most), '' without one."""
    body = text.plain(F.regexp_replace(F.coalesce(page, F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>", " "))
    return F.substring(F.trim(F.regexp_extract(body, r"Who can apply for this job\?(.*?)(?:Show how to apply|Advertised until|$)", 1)), 1, 400)


def permit_line(who: Column) -> Column:
    return F.when(F.coalesce(who, F.lit("")) == "", F.lit("")).when(who.rlike("(?i)without a valid Canadian work permit"), F.lit(NO_PERMIT)).otherwise(F.lit(PERMIT_NEEDED))


def wants_detail(title: Column, words: list[str]) -> Column:
    """Whether a posting's page is worth reading: its title holds one of the words, or there are none."""
    hit = F.lit(not words)
    for w in words:
        hit = hit | F.contains(F.lower(title), F.lit(w.lower()))
    return hit


def parse_job_bank(payloads: DataFrame, default_company: str = "Job Bank employer") -> DataFrame:
    """Listings of Atom search feeds whose summary labels Employer, Location and Salary in bold.

    A payload is the feed, or JSON with ``feed`` and ``who``: what each posting's page says
    on who can apply, by its address.
    """
    doc = payloads.select(
        "source", F.coalesce(F.get_json_object("payload", "$.feed"), F.col("payload")).alias("feed"), F.from_json(F.get_json_object("payload", "$.who"), "map<string,string>").alias("who")
    )
    entry = doc.select("source", "who", F.explode(F.regexp_extract_all("feed", F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("e"))
    read = entry.select("source", "who", _element(F.col("e"), "title").alias("title"), _element(F.col("e"), "summary").alias("s"), _element(F.col("e"), "updated").alias("day"),
                        F.regexp_extract("e", r'<link[^>]*href="([^"]+)"', 1).alias("url"))
    labelled = lambda name: text.plain(F.regexp_extract("s", rf"(?is)<strong>\s*{name}:\s*</strong>(.*?)(?:<br\s*/?>|$)", 1))
    place, salary = labelled("Location"), labelled("Salary")
    return read.select(
        "source", "title", F.coalesce(F.nullif(labelled("Employer"), F.lit("")), F.lit(default_company)).alias("company"), "url",
        F.when(place != "", F.concat(place, F.lit(", Canada"))).otherwise("Canada").alias("location"), dates.parse_date(F.col("day")).alias("posted"), nothing().alias("tags"),
        joined(" ", F.when(salary != "", F.concat(F.lit("Salary: "), salary, F.lit("."))), permit_line(F.try_element_at("who", F.col("url")))).alias("description"),
    )


def watch_page(payloads: DataFrame, company: str, url: str, empty_text: str) -> DataFrame:
    """One listing for a careers page that no longer shows its 'no openings' sentence."""
    sentence = " ".join(empty_text.split()).lower()
    if not sentence:
        raise ValueError("a watched page needs the sentence it shows when nothing is open")
    body = text.plain(F.regexp_replace("payload", r"(?is)<script.*?</script>|<style.*?</style>", " "))
    return payloads.where(~F.contains(F.lower(body), F.lit(sentence))).select(
        "source", F.lit(f"Careers page changed: openings may be posted ({company})").alias("title"), F.lit(company).alias("company"), F.lit(url).alias("url"),
        F.lit("").alias("location"), F.lit(None).cast("date").alias("posted"), nothing().alias("tags"),
        F.lit(f'The sentence "{sentence}" is no longer on the page.').alias("description"),
    )


def sitemap_urls(payloads: DataFrame, words: list[str], limit: int | None = 40) -> DataFrame:
    """(source, url): job pages of a sitemap with a slug word that begins with one of the query words.

    The words are tested before any page is fetched; of each source the first ``limit`` in
    the sitemap's order are to be fetched.
    """
    every = payloads.select("source", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("at", "url"))
    url = every.withColumn("url", text.unescape(F.col("url"))).where(F.col("url").rlike(r"/job/[^/]+/\d+/?$"))
    slug_of = F.regexp_extract("url", r"/job/([^/]+)/\d+/?$", 1)
    tokens = F.split(F.lower(F.coalesce(F.try_url_decode(F.replace(slug_of, F.lit("+"), F.lit("%2B"))), slug_of)), "[^a-z0-9]+")
    hit = F.lit(not words)
    for w in words:
        hit = hit | F.exists(tokens, _starts(w.lower()))
    out = url.where(hit)
    if limit is None:
        return out.select("source", "url")
    ranked = out.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("at")))
    return ranked.where(F.col("n") <= limit).select("source", "url")


def parse_pages(pages: DataFrame, company: str) -> DataFrame:
    """Listings of job pages (source, url, page) with marked-up title and description.

    A country's code behind the city is spelled out, except before the United States:
    there it is a state's.
    """
    page = F.regexp_replace("page", r"(?s)<script.*?</script>", " ")
    title = F.regexp_extract(page, r'(?s)itemprop="title"[^>]*>(.*?)</span>', 1)
    body = F.regexp_extract(page, r'(?s)itemprop="description"[^>]*>(.*?)(?:<div class="joblayouttoken|$)', 1)
    parts = F.split(text.plain(F.regexp_extract(page, r"(?s)Job Location:\s*</span>\s*<span[^>]*>(.*?)</span>", 1)), ", ")
    names = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])

    def spelled(p: Column, i: Column) -> Column:
        behind = F.get(F.col("__parts"), i + 1)
        return F.when((i > 0) & (behind.isNull() | ~behind.isin("US", "United States")), F.coalesce(F.try_element_at(names, p), p)).otherwise(p)

    return pages.where(page.rlike(r'(?s)itemprop="title"[^>]*>.*?</span>')).withColumn("__parts", parts).select(
        "source", text.plain(title).alias("title"), F.lit(company).alias("company"), "url", F.array_join(F.transform("__parts", spelled), ", ").alias("location"),
        F.lit(None).cast("date").alias("posted"), nothing().alias("tags"), text.plain(F.regexp_replace(body, r"(?s)<style.*?</style>", " ")).alias("description"),
    )


def parse_cards(payloads: DataFrame) -> DataFrame:
    """Listings of a dump of page cards: a JSON array of objects with title, company, url and location."""
    rows = payloads.select("source", F.explode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("item"))
    return rows.select(
        "source", *[F.coalesce(get(n), empty()).alias(n) for n in ("title", "company", "url", "location")], F.lit(None).cast("date").alias("posted"), nothing().alias("tags"),
        empty().alias("description"),
    )


def merge_pages(pages: DataFrame, items: str = "content", total: str = "totalFound", size: int = 100, most: int = 5) -> DataFrame:
    """The pages (source, page, payload) of a paged board that count: up to the first short page, the stated total or ``most``."""
    v = F.try_parse_json("payload")
    n = F.coalesce(F.size(F.try_variant_get(v, f"$.{items}", "array<variant>")), F.lit(0))
    counted = pages.where(F.col("page") < most).withColumns({"__n": F.greatest(n, F.lit(0)), "__t": F.coalesce(F.try_variant_get(v, f"$.{total}", "bigint"), F.lit(0))})
    before = W.partitionBy("source").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    ended = F.max(F.when((F.col("__n") < size) | (F.col("__sum") >= F.col("__t")), 1).otherwise(0)).over(before)
    summed = counted.withColumn("__sum", F.sum("__n").over(W.partitionBy("source").orderBy("page").rowsBetween(W.unboundedPreceding, 0)))
    return summed.withColumn("__end", F.coalesce(ended, F.lit(0))).where("__end = 0").drop("__n", "__t", "__sum", "__end")


def with_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Listings with the text of their detail page (source, url, detail) added to the description; those without a page stay."""
    once = details.groupBy("source", "url").agg(F.min("detail").alias("__d"))
    return listings.join(once, ["source", "url"], "left").withColumn("description", joined(" ", F.col("description"), F.col("__d"))).drop("__d").select(*listings.columns)


def _starts(word: str) -> Callable[[Column], Column]:
    return lambda t: F.startswith(t, F.lit(word))


# Classes that repeat on every page, and words boards use for their cards.
NOISE = r"(?i)^(?:icon|btn|button|col|row|container|wrapper|flex|grid|hidden|sr-only|active|nav|menu|footer|header|logo|social)"
CARD = r"(?i)job|card|vacanc|posting|listing|result|item"
# End of fixed values.


def card_candidates(elements: DataFrame, minimum: int = 3, top: int = 10) -> DataFrame:
    """(selector, cards, score, sample): repeated classes that could be a page's listing cards.

    elements: tag, classes (array), has_link, text, ord. Layout classes and elements without
    a link or with under eight characters do not count; selectors that speak of cards count
    twice. Ties go to more cards, then to the selector that comes first on the page.
    """
    good = elements.where(F.col("has_link") & (F.length("text") >= 8))
    one = good.select("tag", "text", "ord", F.posexplode("classes").alias("at", "c")).where(~F.col("c").rlike(NOISE) & F.col("c").rlike(r"^[A-Za-z_][\w-]*$"))
    selector = F.concat_ws(".", "tag", "c").alias("selector")
    counted = one.groupBy(selector).agg(
        F.count("*").alias("cards"), F.min_by("text", F.struct("ord", "at")).alias("sample"), F.min(F.struct("ord", "at")).alias("first")
    ).where(F.col("cards") >= minimum)
    score = (F.col("cards") * F.when(F.col("selector").rlike(CARD), 2).otherwise(1)).alias("score")
    return counted.select("selector", "cards", score, text.normalise_text(F.col("sample")).alias("sample"), "first").orderBy(
        F.desc("score"), F.desc("cards"), "first"
    ).limit(top).drop("first")


def preview(rows: DataFrame, usable: DataFrame, top: int = 3) -> DataFrame:
    """(title, company, location, usable): the first rows a selector would give, and how many become listings."""
    return rows.limit(top).select("title", "company", "location").withColumn("usable", usable.agg(F.count("*").alias("n")).scalar())
