"""Planted personal data that the base patterns don't find."""

import random

import brute
from reldrift.llm import pii


def card(rng):
    body = f"4{rng.randrange(10**14):014d}"
    return next(c for c in (body + str(d) for d in range(10)) if brute.luhn(c))


def test_obfuscated_personal_data(spark):
    rng, rows, wanted = random.Random(9), [], {}
    for d in range(6000):
        c = card(rng)
        bad = str((int(c[-1]) + 1) % 10)
        value, kind = [
            (f"joe{d}[at]mail[dot]test", "email"), (f"joe{d}@mail.test", "email"), (".".join(c[i : i + 4] for i in (0, 4, 8, 12)), "card"),
            (" ".join(c[i : i + 4] for i in (0, 4, 8, 12)), "card"), (f"(555) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", "phone"),
            (c[:15] + bad, None),
        ][d % 6]
        before = {"email": "write to ", "card": "paid with ", "phone": "call ", None: "order "}[kind]
        rows.append((d, f"{before}{value} please"))
        wanted[d] = "" if kind is None else f"{kind}:{len(before)}:{len(before) + len(value)}"
    given = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.report(pii.scan(given)).collect()}
    assert found == wanted
