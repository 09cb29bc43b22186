"""Claims quoted from passages, against every phrase tried on every passage."""

import random
import re

from tidemark.operators import claims


def flat(t):
    return " ".join((t or "").split()).lower()


def brute(claim, context, passages):
    """The first label whose passage holds the number and a phrase of four to six words beside it."""
    n, c = claim.strip().lower(), flat(context)
    at = c.find(n)
    if at < 0 or not n:
        return None
    after, before = c[at + len(n) :].split(), c[:at].split()
    tries = [" ".join(w).strip(" .,;:") for k in (4, 5, 6) for w, full in ((after[:k], len(after) >= k), (before[-k:], len(before) >= k)) if full]
    tries = [t for t in tries if len(t) >= 12]
    for label, text in sorted(passages, key=lambda p: int(p[0][1:])):
        if n in flat(text) and any(t in flat(text) for t in tries):
            return label
    return None


def test_against_every_phrase(spark):
    rng = random.Random(12)
    words = ["cash", "flows", "notes,", "mature", "Within", "two", "years.", "a", "of", "debt;", "to", "fell"]
    rows, held, want = [], [], {}
    for d in range(150):
        number = f"${rng.randrange(3)} million"
        texts = [(f"C{i}", "  ".join(rng.choices(words, k=rng.randrange(3, 25))) + f" {number}\n" + " ".join(rng.choices(words, k=rng.randrange(3, 25)))) for i in rng.sample(range(1, 14), 3)]
        source = re.split(r"\s+", rng.choice(texts)[1])
        at = rng.randrange(len(source))
        context = " ".join(source[max(0, at - 7) : at + 7]) if rng.random() < 0.7 else " ".join(rng.choices(words, k=9))
        context = context if number in context else f"{context} {number} {' '.join(rng.choices(words, k=rng.randrange(7)))}"
        status = rng.choice(["unsupported", "contradicted", "verified"])
        rows.append((d, 0, number, context, status, "old", 1.0, 2.0))
        held += [(d, *t) for t in texts]
        want[d] = None if status == "verified" else brute(number, context, texts)
    rows.append((999, 0, "$1 million", None, "unsupported", None, None, None))
    checked = spark.createDataFrame(rows, "d int, ordinal int, claim string, context string, status string, matched_key string, matched_value double, deviation double")
    passages = spark.createDataFrame([*held, (0, "C99", None)], "d int, label string, text string")
    got = {r.d: r for r in claims.ground(checked, passages, "d").collect()}
    assert len(got) == 151 and sum(v is not None for v in want.values()) > 15
    for d, label in want.items():
        if label:
            assert (got[d].status, got[d].matched_key, got[d].matched_value, got[d].deviation) == ("cited", label, None, None), rows[d]
        else:
            assert (got[d].status, got[d].matched_key) == (rows[d][4], "old"), rows[d]


def test_labels_in_the_order_first_seen(spark):
    seen = spark.createDataFrame([(1, 30, 2), (1, 10, 1), (1, 30, 0), (1, 20, 5), (2, 20, 9)], "d int, chunk int, turn int")
    assert {(r.d, r.chunk): r.label for r in claims.ledger(seen, "d", "chunk", "turn").collect()} == {(1, 30): "C1", (1, 10): "C2", (1, 20): "C3", (2, 20): "C1"}
