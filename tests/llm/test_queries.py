"""Every registered query against SQL, a public library, or plain Python, on the smallest tables."""

import base64
import hashlib
import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from crosscheck.compare import oracle_connection, oracle_rows, spark_rows  # noqa: E402
from reldrift.llm import queries as Q  # noqa: E402
from reldrift.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs():
    return [(d, t or "") for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(Q.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", Q.ORACLE)
def test_against_sql(spark, name):
    columns, rows = spark_rows(Q.QUERIES[name](spark, SF))
    expected_columns, expected = oracle_rows(oracle_connection(SF), Q.ORACLE[name])
    assert columns == expected_columns and rows == expected


def test_language_model(spark, docs):
    rows = by_id(Q.QUERIES["op1_hpy_lm"](spark, SF))
    tokens = {d: [*brute.words(t), None] for d, t in docs}
    counts = Counter(w for d, ws in tokens.items() if fold(d, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    better = Counter()
    for d, ws in tokens.items():
        r = rows[d]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 7) == 2, len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
        better[r.held_out] += r.score - r.base_score
    assert better[True] > 0 and better[False] > 0


def test_secrets(spark, docs):
    rows = by_id(Q.QUERIES["op2_secret_scan"](spark, SF))
    for d, t in docs:
        base = [f"{k}:{s}:{e}" for s, _, k, e in brute.secrets(t)]
        assert rows[d].base_sha256 == sha(",".join(base))
        assert set(base) <= set(rows[d].spans.split(",")) | {""}


def test_toxicity_of_rows_held_out(spark):
    rows = by_id(Q.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.1"))
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall()
    held = [(rows[d].score, y) for d, y in labels if fold(d, 5) == 0]
    assert all(rows[d].held_out == (fold(d, 5) == 0) and rows[d].predicted == (rows[d].score >= 0.5) for d, _ in labels)
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert wins > 0.93
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95


def test_suffix_dedup(spark, docs):
    rows, gone = by_id(Q.QUERIES["op4_suffix_dedup"](spark, SF)), brute.repeats(docs)
    for d, t in docs:
        data, mask = t.encode(), gone[d]
        kept = bytes(b for b, g in zip(data, mask) if not g)
        spans = sum(g and not (i and mask[i - 1]) for i, g in enumerate(mask))
        r = rows[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(mask), spans, sha(kept))


def test_decontamination_finds_whole_benchmark_texts(spark, docs):
    found = {(r.doc_id, r.item_id) for r in Q.QUERIES["op5_spaced_seeds"](spark, SF).collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert found >= {(d, i) for d, t in docs for i, x in items if x in t}


def test_fingerprints(spark, docs):
    rows = by_id(Q.QUERIES["op7_fingerprint"](spark, SF))
    down = docs[::-1]
    for (d, t), (_, n) in zip(down, [*down[1:], down[0]]):
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2]))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    for d, t in docs:
        assert same.setdefault(t, rows[d].fingerprint) == rows[d].fingerprint
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)


def test_bpe_equals_tiktoken(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(Q.QUERIES["op8_byte_bpe"](spark, SF))
    for d, t in docs:
        ids = np.array(plain.encode_ordinary(t), "<u4")
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(t))


def test_pii(spark, docs):
    rows = by_id(Q.QUERIES["op9_pii_spans"](spark, SF))
    for d, t in docs:
        base = brute.pii(t)
        names = [f"{k}:{s}:{e}" for k, spans in base.items() for s, e in spans]
        r = rows[d]
        assert r.base_sha256 == sha(",".join(names)) and set(names) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in base.values()]


def test_near_duplicates(spark, docs):
    rows, (root, size) = by_id(Q.QUERIES["op10_odd_sketch"](spark, SF)), brute.groups(docs)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in rows.items()} == {d: (size[d], root[d], root[d] == d) for d, _ in docs}


def test_pipeline(spark, docs):
    import corpus_pipeline as C

    given = spark.read.parquet(f"{SF}/documents.parquet")
    columns = given.columns
    stages = dict(C.STAGES)
    clean = stages["toxicity"](spark, given, SF)
    assert clean.columns == columns
    left = [(r.doc_id, r.text or "") for r in clean.collect()]
    scores = {r.doc_id: r.score for r in toxicity.score(given, toxicity.fit(given, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert sorted(d for d, _ in left) == sorted(d for d, _ in docs if scores[d] < 0.5)
    one = stages["near_duplicates"](spark, clean, SF)
    root, _ = brute.groups(left)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(d for d in root if root[d] == d)
    items = [x for (x,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    free = stages["decontamination"](spark, one, SF)
    before, after = {r.doc_id: r.text or "" for r in one.collect()}, {r.doc_id: r.text or "" for r in free.collect()}
    assert free.columns == columns and not any(x in t for t in after.values() for x in items) and set(after) < set(before)
    safe = stages["secrets"](spark, free, SF)
    told = {r.doc_id: r.text or "" for r in safe.collect()}
    assert safe.columns == columns and set(told) == set(after)
    for d, t in after.items():
        assert (told[d] == t) == (not brute.secrets(t)) and not brute.secrets(told[d])
    last = stages["byte_bpe"](spark, safe, SF).collect()
    assert len(last) == len(told) and all(r.round_trip for r in last)
