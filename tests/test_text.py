import pytest
from pyspark.sql import functions as F

from vacantia.functions import dates, text


def one(spark, fn, value):
    # A projection of a literal: folded by the optimizer, without a job.
    return spark.range(1).select(fn(F.lit(value).cast("string")).alias("o")).first()["o"]


@pytest.mark.parametrize("value, expected", [
    (None, ""), ("", ""), ("  a   b\t\n c ", "a b c"), (" x y", "x y"),
])
def test_normalise_text(spark, value, expected):
    assert one(spark, text.normalise_text, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("QA Engineer (m/f/d)", "QA Engineer"), ("[Remote] QA Engineer - New", "QA Engineer"), ("NEW! QA | ", "QA"),
    ("QA - Newcastle", "QA castle"), ("(hybrid)", ""), (None, ""), ("Tester (M/W/D) (m/w/d)", "Tester"),
])
def test_normalise_title(spark, value, expected):
    assert one(spark, text.normalise_title, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("https://x.example/a/?utm_source=f&id=3#top", "https://x.example/a?id=3"), ("https://x.example/a///", "https://x.example/a"),
    ("https://x.example/a?ref=1&gh_jid=2", "https://x.example/a"), ("https://x.example/?a=1&&b=2", "https://x.example?a=1&b=2"), (None, ""),
])
def test_canonical_url(spark, value, expected):
    assert one(spark, text.canonical_url, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("Paradox Interactive AB (publ)", "paradox interactive"), ("Acme Pty Ltd", "acme"), ("Søstrene Grene ApS", "sostrene grene"), ("AB", "ab"),
    ("The Company, Inc.", "company"), ("IO INTERACTIVE A/S", "io interactive"), ("", ""), (None, ""), ("a/s ab", "a s"),
])
def test_company_key(spark, value, expected):
    assert one(spark, text.company_key, value) == expected


@pytest.mark.parametrize("value", ["QA Engineer", "QA Engineer (m/k)", "qa engineer (all genders)", "QA  Engineer [Remote]", "QA-Engineer (h/f)", "QA Engineer - New"])
def test_title_key(spark, value):
    assert one(spark, text.title_key, value) == "qa engineer"


def test_names_in_other_scripts_share_the_empty_key(spark):
    assert one(spark, text.company_key, "求人") == ""


def test_description(spark):
    html = "&lt;p&gt;Fluent English&lt;/p&gt;<ul><li>A &amp;amp; B</li><li> c  d </li></ul><br/>"
    assert one(spark, text.normalise_description, html) == "Fluent English\nA & B\nc d"
    assert len(one(spark, text.normalise_description, "x" * 30_000)) == 20_000
    assert one(spark, text.normalise_description, None) == ""


def test_fold_and_words(spark):
    assert one(spark, text.fold, "KØBENHAVN Æß łódź") == "kobenhavn aess lodz"
    assert one(spark, lambda c: text.word_in(c, "lead"), "a lead role") is True
    assert one(spark, lambda c: text.word_in(c, "lead"), "leadership") is False
    assert one(spark, lambda c: text.word_in(c, "språk"), "språkæ") is False
    assert one(spark, lambda c: text.slug(c, 10), "  Hello, World wide ") == "hello-worl"
    assert one(spark, lambda c: text.slug(c, 10), "--") == "ad"


@pytest.mark.parametrize("value, expected", [
    ("2026-08-20T23:30:00+02:00", "2026-08-20"), ("2026-08-20T00:30:00Z", "2026-08-20"), ("2026-08-20", "2026-08-20"), ("1766000000", "2025-12-17"),
    ("1766000000000", "2025-12-17"), ("soon", None), ("", None), (None, None), ("2026-13-40", None), ("99999999999999999999", None),
])
def test_parse_date(spark, value, expected):
    got = one(spark, dates.parse_date, value)
    assert (got and str(got)) == expected


@pytest.mark.parametrize("value, expected", [("Thu, 20 Aug 2026 01:00:00 +0200", "2026-08-19"), ("20 Aug 2026 10:00:00 GMT", "2026-08-20"), ("2026-08-20T10:00:00Z", "2026-08-20"), ("x", None)])
def test_feed_date(spark, value, expected):
    got = one(spark, dates.feed_date, value)
    assert (got and str(got)) == expected


def test_places(spark):
    assert one(spark, dates.remote_location, None) == "Remote"
    assert one(spark, dates.remote_location, "Worldwide") == "Remote (Worldwide)"
    assert one(spark, dates.remote_location, "USA") == "Remote (USA)"
    assert one(spark, dates.place_or_remote, "EET ± 2 hours") == "Remote (EET ± 2 hours)"
    assert one(spark, dates.place_or_remote, "Berlin, DE") == "Berlin, DE"
    assert one(spark, dates.bracket_tags, "text Tags: [qa & cs] [x]") == ["qa & cs", "x"]
    assert tuple(one(spark, dates.split_title_company, "QA Engineer, Nordic, Acme ApS")) == ("QA Engineer, Nordic", "Acme ApS")
    assert tuple(one(spark, dates.split_title_company, "QA Engineer")) == ("QA Engineer", "")
    assert tuple(one(spark, dates.split_title_company, "QA, " + "x" * 61))[1] == ""


@pytest.mark.parametrize("value", ["a &amp; b", "&#8217;&hellip;&nbsp;x", "&#x41;&#X42;&#150;", "&foo; &copy; &copy 5 & 6 &", "&notin;", "&amp;lt;", "&#0;&#1114112;", "plain", "", "&Aacute;&euml;"])
def test_unescape_as_the_standard_does(spark, value):
    import html

    assert one(spark, text.unescape, value) == html.unescape(value)
