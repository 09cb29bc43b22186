"""Names in texts against a search for each name by itself."""

import random
import re
import time

from tests.oracle import assert_same, connect
from tidemark.operators import mentions
from tidemark.plans import mentions as plan

SF = "/root/testdata/sf0.01"


def brute(text, name):
    left = r"(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", name) else ""
    right = r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9_]$", name) else ""
    return [m.start() for m in re.finditer(left + re.escape(name) + right, text)]


def test_against_one_search_a_name(spark):
    rng = random.Random(3)
    letters = ["a", "b", " ", "-", "é", "_", "(", "日"]
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(200)] + [(900, None), (901, "")]
    names = list({"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(60)})
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "id long, text string, places string").repartition(3)
    table = spark.createDataFrame([(n,) for n in [*names, names[0], None, ""]], "name string")
    want = {(i, n, tuple(p)) for i, t in texts for n in names if (p := brute(t or "", n))}
    for limit in (1 << 20, 200):  # one automaton, and several
        got = mentions.mentions(spark, df, table, ["id"], limit)
        assert got.columns == ["id", "name", "places"]
        rows = [(r.id, r.name, tuple(r.places)) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_no_names_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "name string")
    assert mentions.mentions(spark, df, none, ["id"]).count() == 0
    assert mentions.mentions(spark, df.filter("id > 1"), spark.createDataFrame([("a",)], "name string"), ["id"]).count() == 0


def test_overlapping_places_of_one_name():
    machine = mentions.automaton(["a a", "a"])
    assert sorted(mentions.found(machine, "a a a")) == [("a", 0), ("a", 2), ("a", 4), ("a a", 0)]


def test_time_does_not_grow_with_names():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200_000))

    def seconds(n):
        machine = mentions.automaton([f"zz{i}" for i in range(n)])
        best = 9.0
        for _ in range(3):
            start = time.process_time()
            assert list(mentions.found(machine, text)) == []
            best = min(best, time.process_time() - start)
        return best

    assert seconds(50_000) < 5 * seconds(50) + 0.05


def test_matches_oracle(spark):
    assert assert_same(plan.entity_mentions(spark, SF), connect(SF), plan.oracle_sql()["entity_mentions"]) > 20
