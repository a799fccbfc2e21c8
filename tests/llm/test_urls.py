"""URL filter against its SQL and against a plain search."""

from __future__ import annotations

import random

import duckdb
import pytest

from tallyfolio.llm import url_filter
from tallyfolio.llm.page_queries import FIXED_RULES, SQL, op5


def test_query_equals_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert sorted(map(str, db.execute(SQL).fetchall())) == sorted(str(tuple(r)) for r in op5(spark, sf_dir).collect())


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.net/en/x?y#z", "https://a.b.example.NET/en", "x://net/", "x://net", "x://internet/", "x://example.com/de/",
        "x://example.com?/de/", "x://w.org/fr/a/b", "x://org/fr", "x://a://b.net/c", "x://a.net\n/b", "x://.net/", "x://é.NET/É", "x://net/" + "a/" * 5000]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[end:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("few", [True, False])
def test_both_ways_equal_a_plain_search(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    chance = random.Random(1)
    rules = [*FIXED_RULES, ("b.net", "", "allow"), ("net", "/a", "block"), ("net", "/a/b", "allow"), ("a.b.net", "/a/", "block")]
    rules += [(".".join(chance.choices("ab", k=k)) + ".net", "/" + "/".join(chance.choices("ab", k=k)), chance.choice(["allow", "block"])) for k in (1, 2, 3, 4)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = URLS + [f"x://{'.'.join(chance.choices('ab', k=chance.randint(1, 4)))}.net/{'/'.join(chance.choices(['a', 'b', 'ab'], k=chance.randint(0, 5)))}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, host string")
    extra = spark.createDataFrame([*rules, *rules[:2], (None, "/", "block"), ("com", None, "block")], url_filter.RULES)
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages.unionAll(pages.limit(3)), extra).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "x://a.net/"), (1, "x://a.net/")], "page_id bigint, url string")
    rules = spark.createDataFrame([], url_filter.RULES)
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules).collect()] == [(1, "a.net", "/", None, "allow")] * 2
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_block_goes_before_allow_of_the_same_rule(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(1, "x://a.net/b/c"), (2, "x://c.net/")], "page_id bigint, url string")
    both = [("a.net", "/b/", "allow"), ("a.net", "/b/", "block"), ("c.net", "/", "block"), ("c.net", "/", "allow")]
    for rules in (both, both[::-1]):
        judged = url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULES)).collect()
        assert {(r.page_id, r.rule, r.verdict) for r in judged} == {(1, "a.net/b/", "block"), (2, "c.net/", "block")}
