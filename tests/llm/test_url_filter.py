"""URL decisions against the longest matching prefix by brute force."""

from __future__ import annotations

import random

from phonoflow.llm import url_filter as U


def brute_key(url):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)[^/?#]*([^#]*)", url or "")
    if not m:
        return None
    host = re.sub(r"^www\.|\.$", "", m.group(1).lower())
    path = m.group(2) if m.group(2).startswith("/") else "/" + m.group(2)
    return ".".join(reversed(host.split("."))) + "." + path if host else None


def brute(url, rules):
    key, best = brute_key(url), None
    for i, pattern, action in rules:
        if not pattern or action not in ("allow", "block"):
            continue
        host, _, path = pattern.partition("/")
        prefix = ".".join(reversed(host.lower().split("."))) + "." + ("/" + path if "/" in pattern else "")
        if key is not None and key.startswith(prefix):
            rank = (len(prefix), action == "block", -i)
            best = max(best, (rank, i, action)) if best else (rank, i, action)
    return (best[1], best[2] != "block") if best else (-1, True)


def test_against_brute_force(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "ab", "c"])
    host = lambda: ".".join(part() for _ in range(rng.randrange(1, 4))) + "." + rng.choice(["org", "net"])
    path = lambda: "".join("/" + part() for _ in range(rng.randrange(0, 4)))
    rules = [(i, host() + rng.choice(["", "", path(), path() + "/"]), rng.choice(["allow", "block"])) for i in range(150)]
    rules += [(900, "org", "block"), (901, None, "block"), (902, "", "block"), (903, "a.org", None), (904, "A.ORG", "allow"), (905, "a.org", "block")]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'u:p@'])}{host()}{rng.choice(['', ':80'])}{path()}{rng.choice(['', '?q=1', '#f'])}" for _ in range(600)]
    urls += [None, "", "no url", "https://", "https:///x", "HTTP://A.ORG/", urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, kind int")
    table = spark.createDataFrame(rules, "rule_id long, pattern string, action string")
    for parts in (1, 7):
        got = {r["page_id"]: (r["rule_id"], r["keep"]) for r in U.decisions(pages, table, parts).collect()}
        assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    kept = U.accepted(pages, table)
    assert kept.columns == pages.columns
    assert sorted(r["page_id"] for r in kept.collect()) == [i for i, u in enumerate(urls) if brute(u, rules)[1]]


def test_query_against_sql(spark, sf, duck, same_rows):
    same_rows(U.op2_url_filters(spark, sf), duck.execute(U.ORACLE).df())
    assert U.op2_url_filters(spark, sf).where("not keep").count() > 0


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.decisions(pages, U.default_rules(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    got = U.decisions(one, U.default_rules(spark).limit(0)).first()
    assert (got["rule_id"], got["keep"]) == (-1, True)


def test_very_long_urls(spark):
    """Urls of hundreds of kilobytes are decided like any other."""
    path = "x" * 300_000
    pages = spark.createDataFrame([(1, f"http://a.example/{path}"), (2, f"http://b.example/{path}"), (3, f"http://{'s.' * 50_000}b.example/"), (4, f"http://b.example/{path}")], "page_id long, url string")
    rules = spark.createDataFrame([(7, "b.example", "block"), (8, f"b.example/{path[:200_000]}", "allow")], "rule_id long, pattern string, action string")
    got = {r["page_id"]: (r["rule_id"], r["keep"]) for r in U.decisions(pages, rules).collect()}
    assert got == {1: (-1, True), 2: (8, True), 3: (7, False), 4: (8, True)}
    assert {r["page_id"] for r in U.accepted(pages, rules).collect()} == {1, 2, 4}
