"""URL rules by index against trying every rule."""

import random
import re

import pytest

from quillon.llm import urls
from quillon.llm import urls as U


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        ("http://WWW.Example.ORG/es/x?q=1", ("www.example.org", "/es/x", "example.org/es/", "block")),
        ("http://example.org/en/1", ("example.org", "/en/1", "example.org/en/1", "block")),
        ("http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
        ("http://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
        ("http://myexample.org/es/2", ("myexample.org", "/es/2", "org/", "allow")),
        ("http://a.com/fr/x#y", ("a.com", "/fr/x", "com/fr/", "allow")),
        ("http://a.com/de/", ("a.com", "/de/", "com/de/", "block")),
        ("http://a.com?x=/de/", ("a.com", "", None, "allow")),
        ("http://b.cheap-pills.net/", ("b.cheap-pills.net", "/", None, "block")),
        ("http://b.cheap-pillsx.net/", ("b.cheap-pillsx.net", "/", None, "allow")),
        ("http://cheap-pills.example.com/fr/1", ("cheap-pills.example.com", "/fr/1", "com/fr/", "allow")),
        ("http://x.net/banner/a.swf", ("x.net", "/banner/a.swf", None, "block")),
        ("http://É.net/", ("É.net", "/", None, "allow")),
    ],
)
def test_judge(url, want):
    rules = [urls.site_rule(*r) for r in urls.SITE_RULES] + [urls.pattern_rule(*p) for p in urls.PATTERNS]
    assert urls.RuleIndex(rules, {}).judge(url) == want


def test_index_equals_all_rules():
    rng = random.Random(6)
    token = lambda: rng.choice(["ads", "a", "b1", "shop", "x9", "org", "com", "de"])
    sites = [(rng.choice(["allow", "block"]), ".".join(token() for _ in range(rng.randint(1, 2))), "/" + "/".join(token() for _ in range(rng.randint(0, 2)))) for _ in range(60)]
    sites = list({h + p: (v, h, p) for v, h, p in sites}.values())
    pats = [(rng.choice(["allow", "block"]), rng.choice(["^", "", "*"]) + token() + rng.choice(["-", ".", "*", "/"]) + token() + rng.choice(["^", "", "*"])) for _ in range(40)]
    rules = [urls.site_rule(*s) for s in sites] + [urls.pattern_rule(*p) for p in pats]
    index = urls.RuleIndex(rules, {"ads": 5, "a": 1, "org": 9})
    every = urls.RuleIndex(rules, {})
    every.always, every.by_token = list(enumerate(rules)), {}
    assert len(index.always) < len(rules)
    for _ in range(3000):
        url = f"http://{'.'.join(token() for _ in range(rng.randint(1, 3)))}/{rng.choice(['/', '-', '.']).join(token() for _ in range(rng.randint(0, 4)))}"
        assert index.judge(url) == every.judge(url), url


def test_frame(spark):
    rows = [(1, "http://a.org/x", "v"), (1, "http://a.org/x", "v"), (None, None, None), (2, "", "q")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"))
    got = [tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()]
    assert got == [(1, "a.org", "/x", "org/", "allow")] * 2 + [(None, "", "", None, "allow"), (2, "", "", None, "allow")]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_thousands_of_rules_from_tables(spark):
    rng = random.Random(6)
    name = lambda: rng.choice(["shop", "news", "ads", "mail", "x", "img"]) + str(rng.randrange(60))
    site = [(rng.choice(["allow", "block"]), f"{name()}.{rng.choice(['com', 'org'])}", "/" + "/".join(name() for _ in range(rng.randrange(3)))) for _ in range(3000)]
    site = list({(h, p): (v, h, p) for v, h, p in site}.values())
    patterns = [("block", f"^{name()}-{name()}^") for _ in range(2000)] + [("allow", f"/{name()}/*.{rng.choice(['gif', 'js'])}") for _ in range(300)] + [("block", "*banner")]
    addresses = [f"https://{rng.choice(['', 'www.'])}{name()}.{rng.choice(['com', 'org', 'net'])}/{name()}/{name()}-{name()}/{rng.choice(['a.gif', 'b.js', 'banner', ''])}" for _ in range(600)]
    tables = spark.createDataFrame([*site, (None, "a", "/")], "verdict string, host string, path string"), spark.createDataFrame([*patterns, ("block", None)], "verdict string, pattern string")
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(pages, *tables).collect()}
    rules = [U.pattern_rule(*p) for p in patterns]
    seen = set()
    for k, url in enumerate(addresses):
        host, path = U.split_url(url)
        fits = [(len(h + p), -n, h + p, v) for n, (v, h, p) in enumerate(sorted(site)) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        hit = {r.verdict for r in rules if re.search(r.regex, url.lower(), re.S)}
        want = max(fits)[2:] if fits else (None, "block" if hit == {"block"} else "allow")
        seen.add((want[0] is None, want[1]))
        assert got[k] == want, url
    assert len(seen) == 4
