import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sharescope.llm import warc
from sharescope.llm.url_filter import bloom, judge
from sharescope.llm.warc import LoserTree, archive_digest, captures, records_of

from .cases import with_clashes

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("a.net", "/x" * 800, "allow"), ("com", "/en/", "block"), (None, "/", "block")]
URLS = ["http://example.com/en/71", "https://EXAMPLE.com/en/8?q=1", "http://notcom/en/7", "http://x.com/EN/7", "ftp://a.net", "http://a.net" + "/x" * 900, None, "", "no scheme/en/", "http://b.com/en/#f",
        "http://b.com?/en/", "x://y://com/en/", "http://com/en/", "http://com/en/"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, after = rest[:cut].lower(), rest[cut:]
    path = after[:min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls_are_judged_as_rules_say(spark):
    pages = with_clashes(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), "rule", "key", "_url", "__url")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, listed).collect()}
    assert got == {i: judged(u) for i, u in enumerate(URLS)}
    assert {(r["key"], r["_url"], r["__url"]) for r in judge(pages, listed).collect()} == {("mine",) * 3}
    swapped = judge(pages.select("page_id", "url").withColumnRenamed("url", "_url"), listed, "_url").collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in swapped} == got and swapped[0]["_url"] is not None
    hosts = judge(pages.select("page_id", F.col("url").alias("host")), listed, "host")
    assert hosts.columns.count("host") == 1 and {r["page_id"]: r["verdict"] for r in hosts.collect()} == {i: v[3] for i, v in got.items()}
    assert {r["verdict"] for r in judge(pages, listed.limit(0)).collect()} == {"allow"} and judge(pages.limit(0), listed).collect() == []


def test_filter_keeps_every_listed_key_and_drops_most_others(spark):
    listed = spark.range(2000).selectExpr("concat('h', id, '.com/') AS key", "'/' AS path")
    filter_, lengths = bloom(listed)
    assert lengths.nonzero()[0].tolist() == [1] and 0 < filter_.size < 1 << 16


PAGES = [(1, "http://a.com/", "same"), (2, "http://b.a.com/\r\nx", "same"), (3, None, None), (4, "http://a.com/", ""), (5, "http://a.com/", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\né"), (6, "http://z.org/", "long " * 40000),
         (7, "http://z.org/", "long " * 40000), (7, "http://z.org/", "long " * 40000), (None, "http://n.org/", "same"), (None, "http://n.org/", "alone")]


@pytest.mark.parametrize("size", [32768, 3])
def test_archives_give_back_what_was_written(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "RANGE", size)
    monkeypatch.setattr(warc, "SAMPLE", 2)
    payload = {i: (h or "").encode() for i, (_, _, h) in enumerate(PAGES)}
    keeper = {}
    for i, (page, _, _) in enumerate(PAGES):
        if page is not None:
            keeper[payload[i]] = max(page, keeper.get(payload[i], page))
    want = sorted(((p, len(payload[i]), base64.b32encode(hashlib.sha1(payload[i]).digest()).decode(),
                    "response" if keeper.get(payload[i], p) == p else "revisit", None if keeper.get(payload[i], p) == p else keeper[payload[i]]) for i, (p, _, _) in enumerate(PAGES)), key=str)
    pages = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string"), "sha", "value")
    got = captures(pages, folder=str(tmp_path / "warc"), records=2).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=str) == want
    ordered = sorted(got, key=lambda r: r["place"])
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and [r["place"] for r in ordered] == list(range(1, len(PAGES) + 1))
    raw = [gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "warc").glob("*.gz")]
    assert sum(len(list(records_of(gzip.compress(x)))) for x in raw) == len(PAGES) and all(x.endswith(b"\r\n\r\n") for x in raw if x)


def test_empty_pages(spark):
    assert archive_digest(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_loser_tree_merges_any_runs():
    row = lambda k: {"url_key": f"{k:04}", "captured": "", "page_id": k}
    for runs in ([], [[]], [[3]], [[1, 4], [2], [], [0, 9, 9]], [[i, i + 7] for i in range(13)]):
        assert [r["page_id"] for r in LoserTree([[row(k) for k in r] for r in runs])] == sorted(k for r in runs for k in r)
