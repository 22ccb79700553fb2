"""The tables of the language model against the exact law, and the model against a plain one."""

import numpy as np
import pytest

from reldrift.llm import hpylm


def law(c, base, slope, discount):
    """Mean of the table count by the recursion of the Stirling numbers."""
    row = np.zeros(1)
    for n in range(1, c):
        t = np.arange(1, n + 1)
        row = np.logaddexp(np.append(row + np.log(n - discount * t), -np.inf), np.append(-np.inf, row))
    odds = row + np.cumsum(np.log(base + slope * np.arange(c)))
    share = np.exp(odds - odds.max())
    return (share * np.arange(1, c + 1)).sum() / share.sum()


@pytest.mark.parametrize("discount", [0.5, 0.8])
@pytest.mark.parametrize("c, base, slope", [
    (1, 1, 0.1), (2, 0.5, 0.05), (10, 0.5, 0.05), (200, 5, 0.01), (1000, 5, 0.001), (1000, 50, 0.01), (1024, 300, 0.3),
    (1025, 0.01, 1e-4), (2000, 5, 0.01), (2000, 500, 0.2), (5000, 3, 0.1), (5000, 2000, 0.4),
])
def test_table_means(c, base, slope, discount):
    rng = np.random.default_rng(7)
    drawn = hpylm.seat(np.full(20_000, c), np.full(20_000, float(base)), np.full(20_000, slope), discount, rng)
    assert drawn.min() >= 1 and drawn.max() <= c
    assert drawn.mean() == pytest.approx(law(c, base, slope, discount), rel=0.02)


def test_dishes_of_all_sizes_side_by_side():
    rng = np.random.default_rng(3)
    c = np.array([1, 5000, 2, 3, 1, 700, 1_000_000, 2])
    out = hpylm.seat(c, np.full(8, 0.5), np.full(8, 0.05), 0.5, rng)
    assert (out >= 1).all() and (out <= c).all() and (out[c == 1] == 1).all()
    assert len(hpylm.seat(c[:0], np.zeros(0), np.zeros(0), 0.5, rng)) == 0


def test_perplexity_of_held_out_rows(spark):
    """A model of text with structure predicts it better than counts of single words."""
    from pyspark.sql import functions as F

    docs = spark.range(400).select("id", F.expr("concat_ws(' ', transform(sequence(1, 40), i -> element_at(array('the cat', 'a dog', 'the sun', 'one day'), cast(1 + (id * 7 + i * i) % 4 as int))))").alias("text"))
    model = hpylm.train(docs.where("id % 7 <> 2"))
    held = hpylm.score(docs.where("id % 7 = 2").withColumnRenamed("id", "doc_id"), model)
    sums = held.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).head()
    assert 10 ** (-sums.s / sums.n) < 0.75 * 10 ** (-sums.b / sums.n)


def test_a_rare_context_has_a_restaurant_of_its_own(spark):
    """Words far below 1/1024 of the tokens, all with one last character, each always before one other word."""
    from pyspark.sql import functions as F

    pair = lambda i, j: F.format_string("q%dz r%dy", i, j)
    model = hpylm.train(spark.range(6000).select(pair(F.col("id") % 2000, F.col("id") % 2000).alias("text")))
    asked = spark.range(40).select(F.col("id").alias("doc_id"), pair(F.expr("id div 2 * 7"), F.expr("id div 2 * 7 + id % 2 * 7")).alias("text"))
    score = {r.doc_id: r.score for r in hpylm.score(asked, model).collect()}
    assert all(score[d] > score[d + 1] + 1 for d in range(0, 40, 2))


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts with pairs of words seen once and often, and words that only some of them have; every fifth is not learnt from."""
    rng = np.random.default_rng(5)
    words = [f"w{k:x}" + "abcé"[k % 4] for k in range(300)]
    rows = [(d, " ".join(words[min(int(k), 299 if d % 5 == 0 else 250)] for k in rng.zipf(1.3, 60) - 1)) for d in range(150)]
    return spark.createDataFrame([*rows, (150, ""), (151, "never seen words")], "doc_id long, text string")


def scored(docs, monkeypatch, **constants):
    for name, value in constants.items():
        monkeypatch.setattr(hpylm, name, value)
    model = hpylm.train(docs.where("doc_id % 5 <> 0"))
    return {r.doc_id: r for r in hpylm.score(docs, model).collect()}, model


def test_rare_contexts_obey_the_law_of_common_ones(spark, mixed, monkeypatch):
    """With the same draws, all contexts rare or all common give the same scores; contexts of both kinds nearly so."""
    common, model = scored(mixed, monkeypatch, SHARE=1)
    assert model.homes.selectExpr("sum(length(contexts))").first()[0] is None
    rare, model = scored(mixed, monkeypatch, COMMON=0)
    assert model.homes.selectExpr("sum(length(contexts)) div 8").first()[0] > 150
    both, _ = scored(mixed, monkeypatch, COMMON=20, NEAR=5)
    assert len(common) == len(rare) == len(both) == 152
    for d, r in common.items():
        for other in (rare[d], both[d]):
            assert (other.n_tokens, other.n_known, other.train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
            assert other.base_score == pytest.approx(r.base_score)
        assert rare[d].score == pytest.approx(r.score)
        assert both[d].score == pytest.approx(r.score, rel=0.02)


def test_frequent_words_in_parts(spark, mixed, monkeypatch):
    """Copies of the buckets of frequent words change no score."""
    whole, model = scored(mixed, monkeypatch, SHARE=50, CHUNK_TOKENS=500, COMMON=20, NEAR=5)
    assert len(model.shape.frequent) > 2 and model.shape.parts.max() == 1
    model.shape.parts = model.shape.parts + np.arange(len(model.shape.parts)) % 3
    parts = hpylm.score(mixed, model).collect()
    assert len(parts) == len(whole)
    for r in parts:
        assert r[1:] == pytest.approx(whole[r.doc_id][1:])
