"""Comment removal against an independent scanner, by hand and on random text."""

import random

import pytest
from pyspark.sql import functions as F

from reldrift.functions.comments import strip_comments


def _quoted_end(text, start, escapes=True):
    """Index behind the literal that opens at ``start``."""
    quote, i = text[start], start + 1
    while i < len(text):
        if escapes and text[i] == "\\":
            i += 2
        elif text[i] == quote:
            return i + 1
        else:
            i += 1
    return len(text)


def _c_piece(text, i):
    """(end, kept) of the piece of C-like source at ``i``."""
    if text.startswith("//", i):
        end = text.find("\n", i)
        return (len(text) if end < 0 else end), False
    if text.startswith("/*", i):
        end = text.find("*/", i + 2)
        return (len(text) if end < 0 else end + 2), False
    if text[i] == '"':
        return _quoted_end(text, i), True
    if text[i] == "`":
        return _quoted_end(text, i, escapes=False), True
    if text[i] == "'":
        width = 3 if text[i + 1 : i + 2] == "\\" else 2
        inner = text[i + 1 : i + width]
        if inner.isascii() and text[i + width : i + width + 1] == "'":
            return i + width + 1, True
    return i + 1, True


def _python_piece(text, i):
    if text[i] == "#":
        end = text.find("\n", i)
        return (len(text) if end < 0 else end), False
    if text[i] in "\"'":
        if text.startswith(text[i] * 3, i):
            end = text.find(text[i] * 3, i + 3)
            return (len(text) if end < 0 else end + 3), False
        return _quoted_end(text, i), True
    return i + 1, True


def scan(text, piece):
    out, i = [], 0
    while i < len(text):
        end, kept = piece(text, i)
        out.append(text[i:end] if kept else "")
        i = end
    return "".join(out)


def stripped(spark, path, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", strip_comments(F.lit(path), F.col("s")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


@pytest.mark.parametrize(
    "path, text, gone, kept",
    [
        ("main.go", 'package p\n// at https://bad.io/x\nvar u = "https://good.io/v" // end\n', "bad.io", "good.io"),
        ("m.py", 'def f():\n  """at https://bad.io/x"""\n  u = "https://good.io/v#part"\n', "bad.io", "good.io/v#part"),
        ("lib.rs", "fn f<'a>(s: &'a str) {\n  // https://bad.io/x\n}\n", "bad.io", "&'a str"),
        ("a.js", "let u = 'http://lost.io'\nnext()", "lost.io", "next()"),
        ("a.kt", "x /* bad /* */ y", "bad", " y"),
        ("b.ts", "s = `a // kept ${x}` // bad", "bad", "a // kept"),
        ("c.cs", "c = '\"'; // bad\nd", "bad", "'\"'"),
    ],
)
def test_by_hand(spark, path, text, gone, kept):
    (out,) = stripped(spark, path, [text])
    assert gone not in out and kept in out


@pytest.mark.parametrize("path", ["a.json", "b.yaml", "run.sh", "x.toml"])
def test_other_languages_keep_their_text(spark, path):
    text = '// a\n# b\n"""c"""'
    assert stripped(spark, path, [text]) == [text]


@pytest.mark.parametrize("path, piece", [("a.js", _c_piece), ("a.py", _python_piece)])
def test_random_text(spark, path, piece):
    rng = random.Random(11)
    parts = ["//", "/*", "*/", "/", "*", '"', "'", "`", "\\", "\n", "#", '"""', "'''", "a", "é", "😀", " ", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    for text, out in zip(texts, stripped(spark, path, texts)):
        assert out == scan(text, piece), repr(text)


def test_large_inputs_do_not_overflow(spark):
    texts = ['"' + "\\n" * 300_000 + '" // c', "/*" + "x" * 3_000_000, '"' + "a" * 2_000_000]
    out = stripped(spark, "a.js", texts)
    assert out[0].endswith('" ') and out[1] == "" and out[2] == texts[2]
