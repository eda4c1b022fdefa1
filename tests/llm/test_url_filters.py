import random

import pytest

from ehrseq.llm.url_filters import judge_urls, matching_rules

PAGES = "page_id bigint, url string, host string, rule string, suffix string"
RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    """The definition, rule by rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fitting = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fitting, default=None)
    return host, path, best and best[3], best[4] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(n, u, "x", "y", "z") for n, u in enumerate(urls)], PAGES)
    out = judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_random_urls_against_the_definition(spark):
    rng = random.Random(1)
    labels, parts = ["a", "b", "co", "x-y", ""], ["", "en", "de", "e", "en2"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 5))) for _ in range(150)]
    urls = [rng.choice(["http://", "HTTPS://", "", "a://b://"]) + h.upper() + "/".join(["", *rng.choices(parts, k=rng.randint(0, 4))]) + rng.choice(["", "?q=/en/", "#/de", "?"]) for h in hosts]
    rules = [(rng.choice(hosts), "/".join(["", *rng.choices(parts, k=rng.randint(0, 3))]), rng.choice(["block", "allow"])) for _ in range(40)]
    rules += [("co", "/e", "block"), ("co", "/en/", "allow"), ("a", "", "block"), ("b", "/", "allow"), ("b", "/", "block")]
    assert judged(spark, urls, rules) == {n: plain(u, rules) for n, u in enumerate(urls)}


def test_odd_urls(spark):
    rules = [("net", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("example.net", "/en/", "allow")]
    urls = [None, "", "no scheme", "http://", "http://net", "http://NET/", "http://a.net/" + "x/" * 50_000, "x://" + "a." * 5_000 + "net/en/", "http://example.net/en/é?ü", "http://évil.net/\n/"]
    assert judged(spark, urls, rules) == {n: plain(u, rules) for n, u in enumerate(urls)}


@pytest.mark.parametrize("rules", [[], [("net", "/", "block")]])
def test_empty_tables(spark, rules):
    assert judged(spark, [], rules) == {}
    assert judged(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}


def test_repeated_rows_and_null_ids_stay(spark):
    pages = spark.createDataFrame([(None, "http://a.net/"), (7, "http://a.net/"), (7, "http://a.net/")], "page_id bigint, url string")
    out = judge_urls(pages, spark.createDataFrame([("net", "/", "block")], RULES))
    assert sorted((str(r.page_id), r.verdict) for r in out.collect()) == [("7", "block"), ("7", "block"), ("None", "block")]


def test_urls_meet_rules_by_hash_prefix(spark):
    urls = spark.createDataFrame([("a.net", "/")], "host string, path string")
    plan = matching_rules(urls, spark.createDataFrame([("net", "/", "block")], RULES))._jdf.queryExecution().analyzed().toString()
    assert "Join Inner, (hash_prefix" in plan
