"""Install hooks over several files, against one scan of the whole text."""

import io
import random
import re
import zipfile

from reldrift.operators import tokens
from reldrift.plans import jobs

HOOK = re.compile(r'"(?:pre|post)?install"[\t\n\f\r ]*:[\t\n\f\r ]*"[^"]*"', re.I)
PIECES = ['"', '"install"', '"PreInstall"', ":", ' : "', "\n", "x", '"postinstall": "sh', '"install": "a"', " "]


def releases(n):
    rng = random.Random(11)
    return {f"1.{i}": ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6))] for i in range(n)}


def expected(files):
    return HOOK.findall("".join(f + "\n" for f in files))


def test_hooks_of_whole_releases(spark):
    given = releases(400)
    rows = [("npm", "p", v, 3 * i, f"{i}.json", text) for v, files in given.items() for i, text in enumerate(files)]
    files = spark.createDataFrame(rows, "ecosystem string, name string, version string, file_ord int, path string, content string")
    found = {v: [] for v in given}
    for r in sorted(tokens.joined_release_tokens(files).where("kind = 'hook'").collect(), key=lambda r: (r.file_ord, r.pos)):
        found[r.version].append(r.token)
    assert {v: f for v, f in found.items() if f != expected(given[v])} == {}
    assert sum(len(f) for f in found.values()) > 200
    split = [v for v, files in given.items() if expected(files) != [h for f in files for h in HOOK.findall(f)]]
    assert len(split) > 40
    assert tokens.joined_release_tokens(files.limit(0)).count() == 0


def zipped(files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for i, text in enumerate(files):
            archive.writestr(f"{i}.json", text)
    return bytearray(buffer.getvalue())


def test_hooks_of_archives(spark):
    given = {"a": ['{"install": "sh one', 'two" }'], "b": ['{"install": "whole"}'], "c": ['{"install"', ' : "x"'], "d": ['{"install": "never']}
    packed = spark.createDataFrame([(f"mem://{k}", zipped(v)) for k, v in given.items()], "source_url string, content binary")
    rows = jobs.unpacked_tokens(packed).collect()
    hooks = {r.source_url[-1]: r.token for r in rows if r.kind == "hook"}
    assert hooks == {"a": '"install": "sh one\ntwo"', "b": '"install": "whole"', "c": '"install"\n : "x"'}
    assert {r.archive_status for r in rows} == {"ok"} and not [r for r in rows if r.kind == "tail"]
    assert {r.source_url[-1] for r in rows if r.kind == "verdict"} == set(given)


def test_many_broken_hooks_take_no_rounds(spark, monkeypatch):
    """Tables written do not follow the number of broken hooks; a missing text is no file, and what never ends is no hook."""
    from reldrift.operators import split_hooks

    written = []
    monkeypatch.setattr(split_hooks, "materialize", lambda df, label, to=split_hooks.materialize: written.append(label) or to(df, label))
    chain = ['"install": "0'] + [f'{i - 1}", "install": "{i}' for i in range(1, 15)]
    given = {"chain": [*chain, 'end"'], "null": ['"install": "a', None, "", None, 'b"'], "open": ['"install": "a"', '"install": "b', "c", "d"],
             "not": ['"install"', " ", '"install": "b"', '"install" :', "x"]}
    rows = [("npm", "p", v, 2 * i, f"{i}.json", text) for v, files in given.items() for i, text in enumerate(files)]
    files = spark.createDataFrame(rows, "ecosystem string, name string, version string, file_ord int, path string, content string")
    found = {v: [] for v in given}
    for r in sorted(tokens.joined_release_tokens(files).where("kind = 'hook'").collect(), key=lambda r: (r.file_ord, r.pos)):
        found[r.version].append(r.token)
    assert found == {v: expected([f for f in files if f is not None]) for v, files in given.items()}
    assert len(found["chain"]) == 15 and len(written) <= 4
