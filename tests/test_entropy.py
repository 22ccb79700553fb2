import math
import random
from collections import Counter

from pyspark.sql import functions as F

from reldrift.functions import entropy
from reldrift.functions.entropy import is_high_entropy, longest_encoded_run, shannon_entropy


def reference_run(text):
    best, current = b"", b""
    for byte in text.encode():
        current = current + bytes([byte]) if byte >= 0x2B else b""
        if len(current) > len(best):
            best = current
    return best.decode()


def reference_entropy(text):
    size = len(text.encode())
    return -sum(n / size * math.log2(n / size) for n in Counter(text).values()) if size else 0.0


def samples():
    rng = random.Random(5)
    alphabet = "abcXYZ019+/=,-.:;<>@[]_{}~ !\"#$%&'()*\n\té漢😀"
    yield from ["", " ", "ab cd ef", "héé hé", "a.b-c,d;e<f>g@h", "漢字漢字 abcdef"]
    for _ in range(300):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
    yield "".join(chr(0x4E00 + i % 700) for i in range(1500))  # more characters than are counted singly
    wide = [chr(c) for c in range(0x2B, 0x7F)]
    for _ in range(100):
        yield "".join(rng.choice(wide[: rng.randint(20, 84)]) for _ in range(rng.randint(20, 200)))


def test_runs_and_entropy_match_a_plain_count(spark):
    texts = list(samples())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    run = longest_encoded_run(F.col("s"))
    rows = df.select("i", run.alias("run"), shannon_entropy(F.col("s")).alias("h"),
                     is_high_entropy(F.col("s")).alias("high")).collect()
    for row in rows:
        text = texts[row.i]
        expected = reference_run(text)
        assert row.run == expected, text
        assert abs(row.h - reference_entropy(text)) < 1e-9, text
        high = len(expected.encode()) >= 24 and round(reference_entropy(expected), 9) > 5.0
        assert row.high == high, text


def test_texts_ruled_out_before_their_runs_are_cut_have_no_high_run(spark):
    texts = [*samples(), "x" * 40 + " " + "".join(map(chr, range(0x2B, 0x4B))), " " + "".join(map(chr, range(0x2B, 0x4C)))]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    run = F.col("s").rlike(entropy._LONG_RUN)
    rows = df.select("s", run.alias("long"), entropy.is_high_entropy_run(longest_encoded_run(F.col("s"))).alias("high")).collect()
    assert [r.s for r in rows if r.high and not r.long] == []
    assert sum(r.high for r in rows) > 50 and sum(not r.long for r in rows) > 200
    assert rows[-1].high and rows[-2].long and not rows[-2].high
