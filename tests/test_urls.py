import random

import pytest
from pyspark.sql import functions as F

from reldrift.functions import urls

HOSTS = {
    "https://Example.COM/x": "example.com",
    "http://a_b.example.com": "a_b.example.com",
    "http://user:pw@host.io:8080/p": "host.io",
    "http://[::1]:80/": "::1",
    "http://host:": "host",
    "http://host?x=1@y": "host",
    "http://host#x@y": "host",
    "http://a@b@c/": "c",
    "http://h/%41": "h",
    "https://x.é.io/": "x.é.io",
    "http://": "",
    "http://host:80a/": None,
    "http://host/%zz": None,
    "http://host/%4": None,
    "http://h%41st/": None,
    "http://h|st/": None,
    "http://h\\st/": None,
    "http://[::1/": None,
    "http://a^b@host/": None,
    "http://host/\x01": None,
    "http://host#%g1": None,
}

# url -> (noise, payload, raw address)
RULES = {
    "https://cdn.example.com/a.js": (False, False, False),
    "https://example.com/a.js": (True, False, False),
    "http://localhost:3000/": (True, False, False),
    "http://[::1]/": (True, False, False),
    "http://db.local/": (True, False, False),
    "http://dblocal/": (False, False, False),
    "http://local/": (False, False, False),
    "http://x.test/": (True, False, False),
    "https://docs.rs/serde": (True, False, False),
    "https://proj.readthedocs.io/": (True, False, False),
    "https://notdocs.rs/": (False, False, False),
    "https://pkg.go.dev.evil.io/": (False, False, False),
    "https://api.io/{id}": (True, False, False),
    "https://github.com/a/b.git": (True, False, False),
    "https://github.com/a/b.GIT": (False, False, False),
    "https://github.com/a/b/tree/main": (True, False, False),
    "https://github.com/a/b/releases/download/x": (False, False, False),
    "http://127.0.0.1/x.sh": (True, True, True),
    "http://10.1.2.3/x": (False, False, True),
    "http://999.999.999.999": (False, False, True),
    "https://a.io/?to=http://1.2.3.4": (False, False, True),
    "https://PASTEBIN.com/raw/1": (False, True, False),
    "https://x.sh": (False, True, False),
    "https://x/y.sh;": (False, False, False),
    "https://x/y.EXE": (False, True, False),
    "http://testserver:80a/": (False, False, False),
    "http://me@localhost/": (True, False, False),
    "http://docs.rs@evil.io/": (False, False, False),
}


@pytest.mark.parametrize("url", HOSTS)
def test_host(spark, hosts, url):
    assert hosts[url] == HOSTS[url]


@pytest.fixture(scope="module")
def hosts(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "u string")
    return {r.u: r.h for r in df.select("u", urls.url_host(F.col("u")).alias("h")).collect()}


@pytest.fixture(scope="module")
def rules(spark):
    u = F.col("u")
    df = spark.createDataFrame([(x,) for x in RULES], "u string")
    rows = df.select(u, urls.is_noise_url(u), urls.is_payload_url(u), urls.is_raw_ip_url(u),
                     urls.is_reserved_host(u) | urls.is_doc_host(u)).collect()
    return {r[0]: r for r in rows}


@pytest.mark.parametrize("url", RULES)
def test_rules(rules, url):
    assert tuple(rules[url][1:4]) == RULES[url]


def test_the_shortcut_in_the_noise_rule_misses_no_listed_host(rules):
    for url, row in rules.items():
        assert not row[4] or row[1], url


def test_very_long_url(spark):
    url = "http://" + "a" * 200_000 + "/" + "b" * 200_000
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(urls.is_noise_url(F.col("u")), F.length(urls.url_host(F.col("u")))).first() == (False, 200_000)


def test_simple_urls_are_decided_by_their_whole_host(spark):
    rng = random.Random(3)
    pieces = ["a", ".", "example.com", "EXAMPLE.org", "localhost", "docs.rs", "Godoc.org", "test", ":", "80", "/", "?", "#", "%41", "@", "::1", "ſ", "-", "_", "127.0.0.1"]
    urls_ = {rng.choice(["http://", "https://"]) + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(3000)}
    url = F.col("u")
    df = spark.createDataFrame([(u,) for u in urls_], "u string").where(url.rlike(urls._SIMPLE_URL))
    rows = df.select("u", url.rlike(urls._SIMPLE_LISTED).alias("one"), (urls.is_reserved_host(url) | urls.is_doc_host(url)).alias("host")).collect()
    assert [r.u for r in rows if r.one != r.host] == []
    assert sum(r.one for r in rows) > 100 and sum(not r.one for r in rows) > 200
    assert not spark.createDataFrame([("http://::1",)], "u string").where(url.rlike(urls._SIMPLE_LISTED)).count()
