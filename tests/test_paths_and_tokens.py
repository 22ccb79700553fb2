import pytest
from pyspark.sql import functions as F

from reldrift.functions import paths
from reldrift.operators import tokens

# path -> (text, scannable, language)
PATHS = {
    "src/Main.JS": (True, True, "c"),
    "a.d.ts": (True, True, "c"),
    "x/y.pyi": (True, True, "python"),
    "conf.yaml": (True, True, "other"),
    "README.md": (True, False, "other"),
    "notes.txt": (True, False, "other"),
    "doc.rst": (False, False, "other"),
    "js": (False, False, "other"),
    "lib/readme.js": (True, False, "c"),
    "lib\\History.js": (True, False, "c"),
    "changes.go": (True, False, "c"),
    "exchanges.go": (True, True, "c"),
    "package-lock.json": (True, False, "other"),
    "a/pnpm-lock.yaml": (True, False, "other"),
    "my-package-lock.json": (True, True, "other"),
    "app.min.js": (True, False, "c"),
    "min.js": (True, True, "c"),
    "app.js.map": (False, False, "other"),
    "dist/app.js": (True, False, "c"),
    "a/DOCS/x.py": (True, False, "python"),
    "a/mydist/x.py": (True, True, "python"),
    "dist\\x.py": (True, True, "python"),
    "node_modules": (False, False, "other"),
    "yarn.lock": (False, False, "other"),
}


@pytest.fixture(scope="module")
def classified(spark):
    p = F.col("p")
    df = spark.createDataFrame([(x,) for x in PATHS], "p string")
    rows = df.select(p, paths.is_text_file(p), paths.is_scannable_file(p), paths.file_language(p)).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.mark.parametrize("path", PATHS)
def test_path_rules(classified, path):
    assert classified[path] == PATHS[path]


@pytest.mark.parametrize("path", PATHS)
def test_unpacking_applies_the_same_path_rule(path):
    from reldrift.sources.archives import _wanted

    assert bool(_wanted(path)) == PATHS[path][1]


def found(spark, kind, text):
    df = spark.createDataFrame([(text,)], "content string")
    return df.select(tokens.tokens_in(F.col("content"), kind)).first()[0]


@pytest.mark.parametrize(
    "kind, text, expected",
    [
        ("url", "see http://a.io/x), 'https://b.io' HTTP://c.io `https://d.io`", ["http://a.io/x", "https://b.io", "https://d.io"]),
        ("url", "https://a.io/x\x0by https://", ["https://a.io/x\x0by"]),
        ("import", "énet net inet net_ x.net os/exec evaluate eval", ["net", "os/exec", "eval"]),
        ("import", "subprocess.child_process", ["subprocess", "child_process"]),
        ("literal", 'a "' + "x" * 20 + '" "' + "y" * 19 + '" "' + "z" * 21 + "\n\"", ['"' + "x" * 20 + '"']),
        ("literal", '"short" + "' + "é" * 20 + '"', ['"' + "é" * 20 + '"']),
        ("hook", '{"PreInstall" :\n "run"} "install":"" "uninstall": "no"', ['"PreInstall" :\n "run"', '"install":""']),
        ("hook", '"poſtinſtall": "folded"', ['"poſtinſtall": "folded"']),
    ],
)
def test_token_patterns(spark, kind, text, expected):
    assert found(spark, kind, text) == expected


def test_positions_follow_the_text(spark):
    df = spark.createDataFrame([(1, 'eval net eval "https://a.io/1" https://b.io')], "file_ord int, content string")
    rows = sorted((r.kind, r.pos, r.token) for r in tokens.extract_tokens(df).collect())
    assert rows == [
        ("import", 0, "eval"), ("import", 1, "net"), ("url", 0, "https://a.io/1"), ("url", 1, "https://b.io"),
    ]


def test_release_text(spark):
    rows = [("e", "n", "1", 1, "b.py", "x # gone"), ("e", "n", "1", 0, "a.json", "{}"), ("e", "n", "1", 2, "README.md", "no")]
    df = spark.createDataFrame(rows, "ecosystem string, name string, version string, file_ord int, path string, content string")
    pieces = sorted(tokens.release_text(df).collect(), key=lambda r: r.chunk)
    assert "".join(r.text for r in pieces) == "{}\nx \n"


def test_release_text_comes_in_pieces(spark, tmp_path):
    import re

    from reldrift.operators.tokens import release_text, write_release_text

    rows = [("npm", "p", "1", i, f"{i}.js", f"let v{i} = 1 // note\n" * 9) for i in range(3)] + [("npm", "p", "1", 7, "e.js", ""), ("npm", "q", "1", 0, "a.md", "no")]
    files = spark.createDataFrame(rows, "ecosystem string, name string, version string, file_ord int, path string, content string")
    write_release_text(release_text(files, chunk_chars=10), str(tmp_path / "text"))
    pieces = sorted(spark.read.parquet(str(tmp_path / "text")).collect(), key=lambda r: (r.name, r.chunk))
    assert max(len(r.text) for r in pieces) == 10 and {r.name for r in pieces} == {"p"}
    assert "".join(r.text for r in pieces) == "".join(re.sub("//.*", "", r[5]) + "\n" for r in rows[:4])


def test_query_gives_whole_release_texts(spark, tmp_path):
    from datetime import datetime

    from crosscheck import queries

    row = (22, 5, "O", 1.0, datetime(2024, 1, 1), "1-URGENT")
    spark.createDataFrame([row], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    found = queries.release_text(spark, str(tmp_path)).collect()
    assert [(r.ecosystem, r.name, r.version) for r in found] == [("nuget", "pkg-5", "1.22")]
    assert found[0].text == (
        'const v = 1\n\nsend("http://198.51.100.22/in")\n\n' '\nhome = "https://example.com/"\n\n' '{"repository": "https://github.com/o/r.git"}\n'
    )
