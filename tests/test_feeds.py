import datetime as dt
import http.client
import urllib.error

import pytest

from vacantia.operators import store
from vacantia.sources import feeds, saved


def test_request_urls():
    assert feeds.request_url("lever", "acme") == "https://api.lever.co/v0/postings/acme?mode=json"
    assert feeds.request_url("remotive", query="qa lead", category="") == "https://remotive.com/api/remote-jobs?search=qa+lead"
    assert feeds.request_url("jobicy", geo="europe") == "https://jobicy.com/api/v2/remote-jobs?count=50&geo=europe"
    assert feeds.request_url("jobtech", query="QA", region=["a", "b"], remote=True).endswith("search?q=QA&limit=100&region=a&region=b&remote=true")


@pytest.mark.parametrize("code, again", [(429, True), (500, True), (503, True), (403, False), (404, False), (410, False)])
def test_transient(code, again):
    assert feeds.is_transient(urllib.error.HTTPError("u", code, "m", None, None)) is again


def test_retry():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise TimeoutError("late")
        return "ok"

    assert feeds.with_retry(flaky, sleep=pauses.append) == ("ok", "") and pauses == [5.0]
    assert feeds.with_retry(lambda: 1 / 0, sleep=pauses.append)[1].startswith("ZeroDivisionError") and len(pauses) == 1


def test_robots():
    text = "User-agent: *\nDisallow: /private"
    assert feeds.robots_allow(text, "https://x.example/jobs", "me") and not feeds.robots_allow(text, "https://x.example/private/1", "me")
    assert feeds.robots_allow("", "https://x.example/private", "me")


def test_robots_and_sources():
    assert feeds.robots_verdict(404, "", "https://x.example/a", "me") and not feeds.robots_verdict(None, "", "u", "me") and not feeds.robots_verdict(503, "", "u", "me")
    assert not feeds.robots_verdict(200, "User-agent: *\nDisallow: /", "https://x.example/a", "me")
    good, bad = feeds.sources_of({"sources": [{"name": "a", "url": "u"}, {"name": "b", "type": "lever"}, {"name": "c", "type": "what"}, {"name": "d", "type": "lever", "enabled": False}]})
    assert [g["name"] for g in good] == ["a"] and len(bad) == 2
    assert feeds.page_url("smartrecruiters", 2, "acme", city="Oslo") == "https://api.smartrecruiters.com/v1/companies/acme/postings?limit=100&offset=200&city=Oslo"
    assert feeds.is_transient(http.client.IncompleteRead(b"")) and not feeds.is_transient(EOFError())


def test_merge_config():
    public = {"keywords": ["qa"], "locations": ["a"], "sources": [{"name": "x", "type": "rss", "url": "u"}, {"name": "y"}]}
    private = {"keywords+": ["test"], "locations": ["b"], "sources": [{"name": "x", "url": "v"}, {"name": "z"}]}
    got = feeds.merge_config(public, private)
    assert got["keywords"] == ["qa", "test"] and got["locations"] == ["b"]
    assert got["sources"] == [{"name": "x", "type": "rss", "url": "v"}, {"name": "y"}, {"name": "z"}]


def test_payload_files(spark, tmp_path):
    (tmp_path / "one.remotive.json").write_text('{"jobs": []}')
    (tmp_path / "two.lever.json").mkdir()
    feeds.register(spark)
    got = {r["source"]: r for r in spark.read.format("payload_files").load(str(tmp_path)).collect()}
    assert (got["one"]["kind"], got["one"]["payload"], got["one"]["error"]) == ("remotive", '{"jobs": []}', "")
    assert got["two"]["payload"] == "" and "IsADirectory" in got["two"]["error"]


def test_saved(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# remark\nexpected: blocked\nUrl: https://x.example/1\n---\nBody\nline --- two\n")
    (tmp_path / "b.txt").write_text("expected: ok\nno separator\n")
    got = {r["path"][-5:]: r for r in saved.read_saved(spark, str(tmp_path)).collect()}
    assert (got["a.txt"]["expected"], got["a.txt"]["text"], got["a.txt"]["valid"]) == ("blocked", "Body\nline --- two\n", True)
    assert got["a.txt"]["meta"] == {"expected": "blocked", "url": "https://x.example/1"}
    assert got["b.txt"]["valid"] is False and got["b.txt"]["text"] == ""
    v = spark.createDataFrame([("Acme ApS", "QA Engineer!", "0123456789abcdef"), ("Io", "Dev", "ff")], "company string, title string, fingerprint string")
    names = spark.createDataFrame([("io--dev--ff",)], "name string")
    assert [r["name"] for r in saved.to_save(v, names).collect()] == ["acme-aps--qa-engineer--01234567"]


def test_status_events(spark):
    seen = spark.createDataFrame([("f1", "a|q", dt.datetime(2025, 1, 5)), ("f2", "a|q", dt.datetime(2025, 1, 6)), ("f3", "b|q", dt.datetime(2025, 1, 7))], "fingerprint string, vacancy_key string, first_seen timestamp_ntz")
    events = spark.createDataFrame([], "vacancy_key string, status string, status_at date, note string, seq bigint")
    e1 = store.set_status(events, seen, "a|q", "applied", "2025-02-01", "n")
    events = events.union(e1)
    events = events.union(store.set_status(events, seen, "a|q", "new", "2025-03-01"))
    got = {r["vacancy_key"]: (r["status"], r["note"]) for r in store.folded_status(events, seen).collect()}
    assert got == {"a|q": ("new", ""), "b|q": ("new", "")}
    assert store.set_status(events, seen, "zz", "applied", "2025-01-01").count() == 0
    with pytest.raises(ValueError):
        store.set_status(events, seen, "a|q", "gone", "2025-01-01")
    back = {r["fingerprint"]: r["first_seen"].day for r in store.backdate(store.backdate(seen, "f1", "2025-01-02"), "f2", "2025-01-09").collect()}
    assert back == {"f1": 2, "f2": 6, "f3": 7}
    assert store.single_vacancy(seen.where("vacancy_key = 'a|q'")) == "a|q" and store.single_vacancy(seen) is None and store.single_vacancy(seen.limit(0)) is None
    assert [r["fingerprint"] for r in store.same_vacancy_elsewhere(seen.where("fingerprint = 'f1'"), seen).collect()] == ["f2"]
