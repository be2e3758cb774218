import random

from marketpulse.llm import url_filter as U


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in urls], "page_id long, url string, host string, verdict string")
    got = U.judge(pages, U.rule_table(spark, rules)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, *brute(u, rules)) for k, u in urls], key=str)


def test_contract_rules_and_edges(spark):
    urls = [None, "", "org", "http://", "http://ORG/", "https://a.org/x", "https://aorg/x", "https://example.org/en/12", "https://x.Example.org/es/1?q",
            "https://example.org", "https://example.org?x=/es/", "https://example.com/fr/", "https://b.com/de/#a", "a://b://org/", "http://org:80/",
            "http://example.org/" + "a/" * 5000, "http://" + "a." * 3000 + "org/x", "https://a.org/x\ny", "http://É.org/ü"]
    check(spark, [*enumerate(urls), (4, urls[4]), (None, urls[7])], U.RULES)


def test_many_rules(spark):
    rng = random.Random(4)
    labels = ["a", "b", "cc", "org"]
    rules = sorted({(".".join(rng.choices(labels, k=rng.randrange(1, 4))), "/" + "".join(rng.choices("xy/", k=rng.randrange(0, 4))), "") for _ in range(80)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p, _ in rules] + [("a", "/x", "block"), ("a", "/x", "allow")]
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randrange(1, 6)))}/{''.join(rng.choices('xy/', k=rng.randrange(0, 6)))}" for _ in range(500)]
    check(spark, [*enumerate(urls)], rules)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, U.rule_table(spark)).collect() == []
    page = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in U.judge(page, U.rule_table(spark, [])).collect()] == [(1, "a.org", "/", None, "allow")]


def test_join_compares_short_prefixes_alone(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = U.judge(pages, U.rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "short" in line]
    assert len(joins) == 2 and all("full" not in j and "asked" not in j for j in joins)
    # one hex digit: most expressions meet a rule's prefix, the full digests keep them apart
    monkeypatch.setattr(U, "PREFIX", 1)
    test_many_rules(spark)
