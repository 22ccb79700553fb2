"""Decontamination of benchmark texts with substituted words, against brute force over all offsets."""

import random

from pyspark.sql import functions as F

from reldrift.llm import decontam


def leaks(docs, items):
    """{(doc, item): equal words} by the operator's rule, at the best of all offsets."""
    out = {}
    for d, words in docs.items():
        for i, item in items.items():
            n = len(item)
            for offset in range(1 - n, len(words)):
                same = [k for k in range(n) if 0 <= k + offset < len(words) and words[k + offset] == item[k]]
                local = any(b - a < 40 for a, b in zip(same, same[29:]))
                if len(same) >= max((n + 1) // 2, min(8, n)) or local:
                    out[d, i] = max(out.get((d, i), 0), len(same))
    return out


def test_masks_are_hit_wherever_half_of_the_words_are_equal():
    """Most equal words without a hit, over the states of the last ten words; see the module."""
    masks = [int(m, 2) for m in decontam.MASKS]
    best, state = {0: 0}, (1 << 10) - 1
    for n in range(1, 32):
        after = {}
        for s, most in best.items():
            for bit in (0, 1):
                t = (s << 1 | bit) & state
                if not any(t & m == m for m in masks):
                    after[t] = max(after.get(t, 0), most + bit)
        best = after
        assert n < 8 or max(best.values()) < max(8, (n + 1) // 2)


def test_substituted_words(spark):
    rng = random.Random(5)
    fresh = (f"f{i}" for i in range(10**6))
    items = {i: [f"w{rng.randrange(400)}" for _ in range(n)] for i, n in enumerate((16, 23, 40, 59, 90, 8, 12, 5))}
    docs, expected_hidden = {}, set()

    def plant(i, wrong, front=True):
        d = len(docs)
        body = [next(fresh) if wrong(k) else w for k, w in enumerate(items[i])]
        docs[d] = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30) if front else 0)] + body + [next(fresh) for _ in range(5)]
        return d

    for i in items:
        for period in (2, 3, 4, 5, 7):
            for rest in range(min(period, 3)):
                d = plant(i, lambda k: k % period == rest)
                if period == 4 and i == 3:
                    expected_hidden.add((d, i))
                plant(i, lambda k: k % period != rest)
        for share in (0.1, 0.3, 0.45, 0.5, 0.55, 0.7):
            for _ in range(4):
                gone = set(rng.sample(range(len(items[i])), int(share * len(items[i]))))
                plant(i, lambda k: k in gone)
    cut = items[4][50:]
    docs[len(docs)] = cut + [next(fresh) for _ in range(20)]  # begins before the document
    expected = leaks(docs, items)
    assert expected_hidden and expected_hidden <= set(expected)
    given = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_equal for r in decontam.find_leaks(given, bench).collect()}
    assert found == expected


def test_every_seed_begins_with_an_opening_of_its_place(spark):
    texts = ["one", "one two", "a b c d e f g", " ".join(f"w{i}" for i in range(23))]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    cut, seeds, masks = decontam.benchmark_seeds(items)
    gaps = sorted({max(m.find("1", 1), 0) for m in masks})
    assert len(gaps) < 6 < len(masks)
    at = cut.select("item", decontam.word_hashes("item_words").alias("hashes"), F.explode(F.sequence(F.lit(0), F.size("item_words") - 1)).alias("at"))
    asked = at.select("item", "at", F.array(*[decontam._opening(F.lit(g), F.col("hashes"), F.col("at")) for g in gaps]).alias("asked"))
    both = seeds.join(asked, ["item", "at"])
    assert both.count() == seeds.count() > 200
    assert both.where(~F.array_contains("asked", F.col("opening"))).isEmpty()
    assert seeds.select("item").distinct().count() == len(texts)
