import datetime as dt
import json

import pytest

from vacantia.sources import parse

PAYLOAD = "source string, kind string, company string, slug string, payload string"


CASES = [
    ("greenhouse", {"jobs": [{"title": "QA", "absolute_url": "u", "location": {"name": "Oslo"}, "updated_at": "2026-01-02T00:00:00Z", "content": "&lt;p&gt;x"}]},
     {"title": "QA", "company": "Acme", "url": "u", "location": "Oslo", "posted": dt.date(2026, 1, 2)}),
    ("lever", [{"text": "QA", "hostedUrl": "", "applyUrl": "u", "categories": {"location": "Oslo", "team": "T"}, "createdAt": 1766000000000, "descriptionPlain": "d", "lists": [{"text": "L", "content": "c"}], "additionalPlain": "e"}],
     {"url": "u", "location": "Oslo", "tags": ["T"], "posted": dt.date(2025, 12, 17), "description": "d\nL\nc\ne"}),
    ("ashby", {"jobs": [{"title": "A", "isListed": False}, {"title": "QA", "jobUrl": "u", "location": "Oslo", "isRemote": True, "department": "D", "team": "T"}]},
     {"title": "QA", "location": "Remote (Oslo)", "tags": ["D", "T"]}),
    ("workable", {"name": "Named", "jobs": [{"title": "QA", "url": "", "shortlink": "s", "city": "Oslo", "country": "Norway", "telecommuting": True, "published_on": "2026-01-02"}]},
     {"company": "Acme", "url": "s", "location": "Remote (Oslo, Norway)", "posted": dt.date(2026, 1, 2)}),
    ("smartrecruiters", {"content": [{"id": "7", "name": "QA", "location": {"city": "Oslo", "country": "no", "remote": False}}]},
     {"url": "https://jobs.smartrecruiters.com/acme/7", "location": "Oslo, no"}),
    ("breezy", [{"name": "QA", "friendly_id": "f", "location": {"city": "Oslo", "country": {"name": "Norway"}, "is_remote": True}, "type": {"name": "Full"}, "department": "D"}],
     {"url": "https://acme.breezy.hr/p/f", "location": "Remote (Oslo, Norway)", "tags": ["D", "Full"]}),
    ("recruitee", {"offers": [{"title": "QA", "slug": "qa", "city": "Oslo", "country": "Norway", "remote": "True", "description": "<p>a &amp; b</p>", "requirements": "c"}]},
     {"url": "https://acme.recruitee.com/o/qa", "location": "Remote (Oslo, Norway)", "description": "a & b c"}),
    ("remotive", {"jobs": [{"title": "QA", "company_name": "Io", "url": "u", "candidate_required_location": "Worldwide", "publication_date": "2026-01-02T10:00:00", "tags": ["a"], "category": "dev"}]},
     {"company": "Io", "location": "Remote (Worldwide)", "tags": ["a", "dev"]}),
    ("remoteok", [{"legal": "notice"}, {"position": "QA", "company": "Io", "apply_url": "u", "location": "", "epoch": "1766000000"}],
     {"title": "QA", "url": "u", "location": "Remote", "posted": dt.date(2025, 12, 17)}),
    ("jobicy", {"jobs": [{"jobTitle": "QA", "companyName": "Io", "url": "u", "jobGeo": "Europe", "jobIndustry": ["a"], "jobLevel": "Mid", "jobExcerpt": "x"}]},
     {"location": "Remote (Europe)", "tags": ["a", "Mid"], "description": "x"}),
    ("himalayas", {"jobs": [{"title": "QA", "companyName": "Io", "guid": "u", "locationRestrictions": ["Spain", {"name": "Italy"}], "pubDate": 1766000000}]},
     {"url": "u", "location": "Remote (Spain, Italy)", "posted": dt.date(2025, 12, 17)}),
    ("arbeitnow", {"data": [{"title": "QA", "company_name": "Io", "url": "u", "remote": True, "location": "Berlin", "tags": [], "job_types": ["full"]}]},
     {"location": "Remote (Berlin)", "tags": ["full"]}),
    ("jobtech", {"hits": [{"headline": "QA", "employer": {"workplace": "Io"}, "id": "9", "workplace_address": {"municipality": "Lund", "country": "Sverige"}, "description": {"text": "x"}}]},
     {"company": "Io", "url": "https://arbetsformedlingen.se/platsbanken/annonser/9", "location": "Lund, Sverige", "description": "x"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, k, "Acme", "acme", json.dumps(p)) for k, p, _ in CASES], PAYLOAD)
    out = {}
    for r in parse.parse(df).collect():
        out.setdefault(r["source"], []).append(r.asDict())
    return out


@pytest.mark.parametrize("kind, payload, expected", CASES, ids=[c[0] for c in CASES])
def test_board(parsed, kind, payload, expected):
    assert len(parsed[kind]) == 1
    assert {k: parsed[kind][0][k] for k in expected} == expected


def test_malformed_payloads_give_no_titles(spark):
    bad = ["", "{", "[]", "{}", "7", '{"jobs": "x"}', '[1, null, "a"]']
    df = spark.createDataFrame([("s", c[0], "Acme", "acme", p) for c in CASES for p in bad], PAYLOAD)
    assert [r for r in parse.parse(df).collect() if r["title"]] == []


def payloads(spark, text, source="feed"):
    return spark.createDataFrame([(source, text)], "source string, payload string")


def test_custom_json(spark):
    text = json.dumps({"data": {"jobs": [{"position": "<b>QA</b>", "pdf": "a.pdf", "description": "x"}, {"position": "No link"}]}})
    got = parse.parse_custom(payloads(spark, text), "data.jobs", "position", "https://x.example/{pdf}", "Acme").collect()
    assert [(r["title"], r["url"]) for r in got] == [("QA", "https://x.example/a.pdf")]


def test_page_watch(spark):
    empty = "<html><script>No openings</script><p>No  openings right now</p></html>"
    assert parse.watch_page(payloads(spark, empty), "Acme", "u", "no openings right now").count() == 0
    assert parse.watch_page(payloads(spark, "<script>no openings right now</script><p>Jobs!</p>"), "Acme", "u", "No openings right now").count() == 1
    with pytest.raises(ValueError):
        parse.watch_page(payloads(spark, ""), "Acme", "u", " ")


RSS = """<rss><channel><title>x</title>
<item><title>Acme is hiring a QA Lead to work from EET ± 2 hours</title><link>https://x.example/1</link><pubDate>Thu, 20 Aug 2026 01:00:00 +0200</pubDate><category>pytest</category><category>qa</category><description>Text Tags: [a b]</description></item>
<item><title>Tester, Io ApS</title><link>https://x.example/2</link><author>Someone</author></item>
<item><title>No link</title></item></channel></rss>"""


def test_rss(spark):
    got = {r["url"]: r for r in parse.parse_rss(payloads(spark, RSS), company_in_title=True).collect()}
    assert len(got) == 2
    assert (got["https://x.example/2"]["title"], got["https://x.example/2"]["company"]) == ("Tester", "Io ApS")
    assert got["https://x.example/1"]["tags"] == ["pytest", "qa", "a b"]
    assert got["https://x.example/1"]["posted"] == dt.date(2026, 8, 19)
    by_pattern = {r["url"]: r for r in parse.parse_rss(payloads(spark, RSS), title_pattern="(?<company>.+) is hiring an? (?<title>.+) to work from (?<location>.+)").collect()}
    one = by_pattern["https://x.example/1"]
    assert (one["company"], one["title"], one["location"]) == ("Acme", "QA Lead", "Remote (EET ± 2 hours)")
    assert by_pattern["https://x.example/2"]["company"] == "Someone"
    assert {r["company"] for r in parse.parse_rss(payloads(spark, RSS), employer="Own").collect()} == {"Own"}


def test_atom_and_feed_rules(spark):
    text = """<feed><entry><title type="html">QA &amp;amp; test</title><link rel="self" href="https://x.example/self"/><link href="https://x.example/1"/><published>2026-01-02T00:00:00Z</published>
    <author><name>Someone</name></author><category term="qa"/><summary>Office in Aarhus</summary><content type="html">A much longer text of the advert</content></entry></feed>"""
    r = parse.parse_atom(payloads(spark, text)).first()
    assert (r["company"], r["url"], r["location"], r["description"], r["tags"]) == ("Someone", "https://x.example/1", "Aarhus", "A much longer text of the advert", ["qa"])
    rss = """<rss><channel><item><title>QA in Odense</title><link>l</link><source url="u">The Paper</source><description>x</description></item>
    <item><title>QA</title><link>m</link><location>Ghent</location><description>in Lund</description></item></channel></rss>"""
    got = {x["url"]: x for x in parse.parse_rss(payloads(spark, rss), default_company="Fallback").collect()}
    assert (got["l"]["company"], got["l"]["location"]) == ("The Paper", "Odense") and (got["m"]["company"], got["m"]["location"]) == ("Fallback", "Ghent")


def test_job_bank(spark):
    feed = """<feed><entry><title><![CDATA[QA analyst]]></title><link href="https://x.example/1"/><updated>2026-01-02T00:00:00Z</updated>
    <summary type="html">&lt;strong&gt;Location:&lt;/strong&gt; Montr&amp;eacute;al (QC)&lt;br/&gt;&lt;strong&gt;Salary:&lt;/strong&gt; 10&lt;br /&gt;</summary></entry></feed>"""
    r = parse.parse_job_bank(payloads(spark, json.dumps({"feed": feed, "who": {"https://x.example/1": "You can apply without a valid Canadian work permit."}}))).first()
    assert (r["title"], r["company"], r["location"]) == ("QA analyst", "Job Bank employer", "Montréal (QC), Canada")
    assert r["description"] == "Salary: 10. " + parse.NO_PERMIT
    assert parse.parse_job_bank(payloads(spark, feed)).first()["description"] == "Salary: 10."
    page = spark.createDataFrame([("<p>Who can apply for this job?</p> Citizens &amp; others Show how to apply x",), (None,)], "p string")
    assert [x[0] for x in page.select(parse.who_can_apply(page["p"])).collect()] == ["Citizens & others", ""]


def test_pages_cards_and_paging(spark):
    page = '<script>itemprop="title">no</script><span itemprop="title">QA &amp; X</span> Job Location:</span> <span>Nordborg, DK, Wilmington, DE, US</span><div itemprop="description"><p>Text</p></div>'
    df = spark.createDataFrame([("s", "u", page), ("s", "v", "<p>none</p>")], "source string, url string, page string")
    got = parse.parse_pages(df, "Acme").collect()
    assert [(r["title"], r["location"], r["description"]) for r in got] == [("QA & X", "Nordborg, Denmark, Wilmington, DE, United States", "Text")]
    cards = parse.parse_cards(payloads(spark, json.dumps([{"title": "QA", "company": "A", "url": "u", "location": "Oslo"}, {"title": "only"}]))).collect()
    assert [(r["title"], r["company"], r["location"]) for r in cards] == [("QA", "A", "Oslo"), ("only", "", "")]
    pages = spark.createDataFrame([("s", i, json.dumps({"content": [1] * n, "totalFound": 250})) for i, n in enumerate((100, 100, 50, 100))] + [("t", 0, "{"), ("t", 1, "{}")], "source string, page int, payload string")
    assert sorted((r["source"], r["page"]) for r in parse.merge_pages(pages).collect()) == [("s", 0), ("s", 1), ("s", 2), ("t", 0)]
    text = json.dumps({"data": [{"title": "A", "company_name": "x", "url": "u", "remote": True}, {"title": "B", "company_name": "x", "url": "u"}]})
    kind = spark.createDataFrame([("s", "arbeitnow", text)], "source string, kind string, payload string")
    assert [r["title"] for r in parse.parse(kind, remote_only=True).collect()] == ["A"] and parse.parse(kind).count() == 2


def test_sitemap_and_cards(spark):
    text = "<urlset><url><loc>https://x.example/job/Quality-Intern-X/1/</loc></url><url><loc>https://x.example/job/Cook/2/</loc></url><url><loc>https://x.example/job/Supporter/3/</loc></url></urlset>"
    assert [r["url"] for r in parse.sitemap_urls(payloads(spark, text), ["quality", "support"]).orderBy("url").collect()] == ["https://x.example/job/Quality-Intern-X/1/", "https://x.example/job/Supporter/3/"]
    els = [("div", ["job-card", "row"], True, "A position in Oslo", i) for i in range(3)] + [("li", ["menu-x"], True, "Something long", i) for i in range(5)] + [("li", ["post"], True, "Something long", i) for i in range(5)] + [("div", ["x"], False, "unlinked text", 9)]
    got = parse.card_candidates(spark.createDataFrame(els, "tag string, classes array<string>, has_link boolean, text string, ord bigint")).collect()
    assert [(r["selector"], r["cards"], r["score"]) for r in got] == [("div.job-card", 3, 6), ("li.post", 5, 5)]
