import math
import random
import re
from collections import Counter

import numpy as np

from wherewhen.llm import url_filter as module
from wherewhen.llm.url_filter import boost, url_filter

CASES = {
    None: ("", "", None),
    "no scheme": ("", "", None),
    "http://Example.ORG/es/1?q#f": ("example.org", "/es/1", "example.org/es/"),
    "http://a.example.org/en/12": ("a.example.org", "/en/12", "example.org/en/1"),
    "http://a.example.org/en/2": ("a.example.org", "/en/2", "org/"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/"),
    "http://x.org": ("x.org", "", None),
    "http://org/": ("org", "/", "org/"),
    "x://a.com/fr/?x=://b": ("a.com", "/fr/", "com/fr/"),
    "http://a.com/de/9": ("a.com", "/de/9", "com/de/"),
    "http://a.com/DE/9": ("a.com", "/DE/9", None),
    "http://a.com?x=/fr/": ("a.com", "", None),
    "http://": ("", "", None),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string")
    for r in url_filter(df).collect():
        assert (r.host, r.path, r.rule) == list(CASES.values())[r.page_id]
        assert r.verdict in ("allow", "block")
        if r.rule:
            assert r.verdict == ("block" if r.rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")


def test_trees_learn(spark):
    urls = [f"http://site{i}.com/de/{i}?a=1&b=2" for i in range(200)] + [f"http://www.s{i}.com/fr/{i}" for i in range(200)]
    rest = ["http://site7.net/de/7?a=1&b=2", "http://www.s9.net/fr/9"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + rest)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(df).collect()}
    assert got[400] == "block" and got[401] == "allow"


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (1, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter(df).collect()} == {"allow"}
    assert url_filter(df.limit(0)).collect() == []


def lexical(url, rates, prior):
    """The features by the plainest means."""
    url = url or ""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    shares = [c / len(host) for c in Counter(host).values()]
    query = re.search(r"(?s)\?([^#]*)", url)
    last = host.rsplit(".", 1)[-1]
    return [len(url), len(host), len(path), len(re.findall("/[^/]", path)), len([x for x in host.split(".") if x]), sum(c in "0123456789" for c in url) / max(1, len(url)),
            host.count("-"), round(-sum(p * math.log2(p) for p in shares), 9), len([x for x in query[1].split("&") if x]) if query else 0, float(url.startswith("https")), rates.get(last, prior)]


def test_trees_match_brute_force(spark, monkeypatch):
    """The chances of all other urls are those of trees walked in Python over features worked out in Python, with rates of over 200 suffixes."""
    rnd = random.Random(4)
    urls = [f"http{'s' * rnd.randint(0, 1)}://{rnd.choice(['a', 'bb-c', 'x1'])}{rnd.randint(0, 99)}.{rnd.choice(['com', 'org', 'net', f't{rnd.randint(0, 299)}'])}/{rnd.choice(['de', 'fr', 'en', 'es'])}/{rnd.randint(0, 50)}" + rnd.choice(["", "?a=1&b=2", "#x?y"]) for _ in range(3000)]
    rules = (*module.RULES, *((("block", "allow")[k % 2], f"t{k}", "/e") for k in range(300)))
    df = spark.createDataFrame(list(enumerate(urls)) + [(9000, None)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter(df, rules).collect()}
    told = [(u, got[i].verdict == "block") for i, u in enumerate(urls) if got[i].rule]
    prior = (sum(y for _, y in told) + 1) / (len(told) + 2)
    n, hit = Counter(), Counter()
    for u, y in told:
        s = got[urls.index(u)].host.rsplit(".", 1)[-1]
        n[s] += 1
        hit[s] += y
    assert len(n) > 200
    rates = {s: round((hit[s] + 10 * prior) / (n[s] + 10), 9) for s in n}
    order = [(r.h, r.url) for r in df.selectExpr("xxhash64(url) AS h", "url").orderBy("h", "url").collect()]
    said = dict(told)
    train = [u for _, u in order if u in said]
    bias, trees = boost(np.array([lexical(u, rates, prior) for u in train]), np.array([float(said[u]) for u in train]))
    x = np.array([lexical(u, rates, prior) for u in [*urls, None]])
    score = bias + sum(t.predict(x) for t in trees)
    for i, (p, r) in enumerate(zip(1 / (1 + np.exp(-score)), [*[got[i] for i in range(3000)], got[9000]], strict=True)):
        assert (r.p_block is None) == bool(r.rule)
        if not r.rule:
            assert abs(r.p_block - p) < 2e-6, (i, r)
    monkeypatch.setattr(module, "MAX_BROADCAST_SUFFIXES", 1)
    assert sorted(url_filter(df, rules).collect(), key=str) == sorted(got.values(), key=str)


def test_trees_on_held_out_urls():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    bias, trees = boost(x[:3000], y[:3000])
    score = bias + sum(t.predict(x[3000:]) for t in trees)
    assert ((score > 0) == (y[3000:] > 0)).mean() > 0.97


def test_clashing_columns_and_long_urls(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/" + "x" * 100_000, "h", 1), (1, "http://b.net/" + "y/" * 9000, "h", 2)], "page_id long, url string, host string, f_length int")
    got = url_filter(df).collect()
    assert [len(r.path) for r in sorted(got, key=lambda r: r.host)] == [100_004, 18_001]
