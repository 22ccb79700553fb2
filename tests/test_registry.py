import json

import pytest
from pyspark.sql import functions as F

from reldrift.operators import changes, ranking, registry

DOCS = {
    ("npm", "left"): {"dist-tags": {"latest": "2", "next": "3"}, "versions": {"2": {"dist": {"tarball": "https://r/2.tgz"}}}, "extra": 1},
    ("pypi", "six"): {"info": {"version": "2"}, "releases": {
        "1": [{"url": "w1", "packagetype": "bdist_wheel"}, {"url": "s1", "packagetype": "sdist"}, {"url": "s2", "packagetype": "sdist"}],
        "2": [{"url": "w2", "packagetype": "bdist_wheel"}], "0": []}},
    ("cargo", "serde"): {"crate": {"newest_version": "2"}, "versions": [
        {"num": "2", "dl_path": "/d/2"}, {"num": "2", "dl_path": "/other"}]},
    ("maven", "org.a.b:art"): {"response": {"docs": [{"v": "2"}, {"v": "1"}]}},
    ("go", "github.com/BurntSushi/toml"): {"Version": "v2.0.0+incompatible"},
    ("nuget", "Newtonsoft.Json"): {"versions": ["1", "10", "9-Beta"]},
}
EXPECTED = {
    "left": ("2", "https://r/2.tgz", ""),
    "six": ("2", "w2", "s1"),
    "serde": ("2", "https://crates.io/d/2", ""),
    "org.a.b:art": ("2", "https://repo1.maven.org/maven2/org/a/b/art/2/art-2.jar", "https://repo1.maven.org/maven2/org/a/b/art/1/art-1.jar"),
    "github.com/BurntSushi/toml": ("v2.0.0+incompatible",
        "https://proxy.golang.org/github.com/!burnt!sushi/toml/@v/v2.0.0+incompatible.zip",
        "https://proxy.golang.org/github.com/!burnt!sushi/toml/@v/1.zip"),
    "Newtonsoft.Json": ("9-Beta", "https://api.nuget.org/v3-flatcontainer/newtonsoft.json/9-beta/newtonsoft.json.9-beta.nupkg",
        "https://api.nuget.org/v3-flatcontainer/newtonsoft.json/1/newtonsoft.json.1.nupkg"),
}


def documents(spark, rows):
    return spark.createDataFrame(rows, "ecosystem string, name string, body string")


def test_six_shapes(spark):
    docs = documents(spark, [(e, n, json.dumps(d)) for (e, n), d in DOCS.items()])
    parsed = registry.registry_latest(docs).withColumn("last_seen", F.lit("1"))
    rows = registry.resolve_changes(changes.changed_only(parsed)).collect()
    assert {r.name: (r.version, r.source_url, r.prev_source_url) for r in rows} == EXPECTED


def test_unusable_documents_are_dropped_and_explained(spark):
    rows = [
        ("npm", "broken", '{"dist-tags":'),
        ("npm", "untagged", '{"dist-tags":{}}'),
        ("npm", "mistyped", '{"dist-tags":"x"}'),
        ("pypi", "blank", '{"info":{"version":""}}'),
        ("maven", "nocolon", '{"response":{"docs":[{"v":"1"}]}}'),
        ("maven", "g:none", '{"response":{"docs":[]}}'),
        ("nuget", "none", '{"versions":[]}'),
        ("go", "example.org/fine", '{"Version":"v1"}'),
    ]
    docs = documents(spark, rows)
    assert [(r.name, r.latest) for r in registry.registry_latest(docs).collect()] == [("example.org/fine", "v1")]
    assert {r.name: r.reason for r in registry.rejected_documents(docs).collect()} == {
        "broken": "malformed document", "untagged": "no latest version", "mistyped": "malformed document",
        "blank": "no latest version", "nocolon": "bad coordinate", "g:none": "no latest version", "none": "no latest version",
    }


@pytest.mark.parametrize("version, segment", [("1.0~rc1", "1.0~rc1"), ("1 2", "1%202"), ("a/b*c", "a%2Fb%2Ac"), ("$&+:=@", "$&+:=@"), ("é;,?", "%C3%A9%3B%2C%3F")])
def test_version_in_a_go_address(spark, version, segment):
    df = spark.createDataFrame([(version,)], "v string")
    assert df.select(registry.go_url(F.lit("m"), F.col("v"))).first()[0] == f"https://proxy.golang.org/m/@v/{segment}.zip"


def test_top_names_counts_a_repeated_name_once_at_its_best_place(spark):
    rows = [("npm", "a", 5, 1), ("npm", "b", 9, 2), ("npm", "a", 7, 3), ("npm", "", 99, 4), ("npm", "c", 5, 0), ("pypi", "z", 1, 5)]
    df = spark.createDataFrame(rows, "ecosystem string, name string, dependents bigint, part_key bigint")
    top = ranking.top_names(df, 2).orderBy("ecosystem", "rank").collect()
    assert [tuple(r) for r in top] == [("npm", 1, "b"), ("npm", 2, "a"), ("pypi", 1, "z")]


def test_module_paths(spark):
    from reldrift.operators.registry import is_module_path

    good = ["example.org/a", "example.org/A/b-c_d~e", "a.b", "example.org/a/v2", "gopkg.in/yaml.v3", "gopkg.in/x.v0", "example.org/v1x"]
    bad = ["example/a", "Example.org/a", "-a.org/b", "example.org//a", "example.org/a/", "/a.b", "example.org/.a", "example.org/a.", "",
           "example.org/a b", "example.org/con", "example.org/Aux.go/b", "example.org/a~1", "example.org/a/v1", "example.org/a/v0", "example.org/a/v02",
           "example.org/a/v1.2", "gopkg.in/yaml", "example.org/\u00e9"]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string")
    found = {r.p: r.ok for r in df.select("p", is_module_path(F.col("p")).alias("ok")).collect()}
    assert [p for p in good if not found[p]] == [] and [p for p in bad if found[p]] == []
