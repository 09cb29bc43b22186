"""Ball k-means, mixture packing and periodic runs against brute force; nulls, ties, repeated rows, long texts, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import balls, neardup, packing, periodic, queries, repeats
from tidemark.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# words


def thue_morse(n, a="a", b="b"):
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [3, 8, 9, 10, 11])
def test_word_hashes_part_complements(n):
    t, c = thue_morse(n)
    words = Words(pa.array([f"{t} {c} x{t} x{c} {t}x {c}x"]))
    assert len(set(words.hashes().tolist())) == 6
    assert len(set(words.exact_ids(np.arange(6), words.hashes()).tolist())) == 6
    # equal hashes do not make words equal
    assert len(set(words.exact_ids(np.arange(6), np.zeros(6, np.uint64)).tolist())) == 6


@pytest.mark.parametrize("n", [10, 11])
def test_long_words_share_no_shingle_and_no_run(spark, n):
    t, c = thue_morse(n)
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(0, t), (1, c), (2, f"{head} {t}"), (3, f"{head} {c}"), (4, f"{head} {t}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, docs, size=3, percent=85).collect()}
    assert near[0] == 0 and near[1] == 1 and near[4] == 2
    gone = {r.doc_id: r.n_removed for r in repeats.drop_repeats(spark, docs, 20).collect()}
    assert gone == {0: 0, 1: 0, 2: 0, 3: 0, 4: 20}


def test_joined_words():
    texts = [None, "", "  a\t\tb\n c ", "é x", " y z"]
    words = Words(pa.array(texts))
    lists = [WORD.findall(t or "") for t in texts]
    rng = random.Random(3)
    for _ in range(50):
        keep = np.array([rng.random() < 0.6 for _ in range(len(words))], bool)
        marks = iter(keep.tolist())
        want = [" ".join(w for w in ws if next(marks)) for ws in lists]
        assert words.joined(keep).to_pylist() == want


# ball k-means


def brute_kmeans(vectors, k, rounds):
    """vectors: (id, integers)."""
    first = sorted(vectors, key=lambda v: (hashlib.sha256(f"1:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    centroids = [list(p) for _, p in first]

    def assign():
        out = []
        for _, p in vectors:
            out.append(min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(centroids)):
            mine = [p for (_, p), (_, i) in zip(vectors, got, strict=True) if i == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [i for _, i in assign()], [d for d, _ in assign()], centroids


def test_reassigning_equals_all_comparisons():
    rng = np.random.default_rng(5)
    for spread in (3, 40, 400):
        points = rng.integers(-spread, spread, (400, 6)) + rng.integers(-3, 4, (400, 1)) * 200
        centroids = points[:12].copy()
        cluster, distance = balls.nearest(points, centroids)
        moved = np.array([points[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(12)])
        radius = [balls._root_up(int(distance[cluster == c].max(initial=0))) + balls._root_up(int(d)) for c, d in enumerate(balls._square(moved, centroids))]
        near = balls.neighbours(moved, radius)
        got, best, compared = balls.reassign(points, cluster, moved, near)
        want, least = balls.nearest(points, moved)
        assert got.tolist() == want.tolist() and best.tolist() == least.tolist()
        assert compared < 400 * 11
        # balls hold all their members
        assert all(int(d) <= radius[c] ** 2 for c, d in zip(cluster.tolist(), balls._square(points, moved[cluster]).tolist(), strict=True))


def test_kmeans_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    good = [(int(i), [float(x) for x in rng.normal(i % 5, 0.3, 64)], "x", i) for i in range(120)]
    good += [(200 + i, good[0][1], "same vector", i) for i in range(60)]
    bad = [(300, None, "", 0), (301, [1.0] * 63, "", 0), (302, [1.0] * 65, "", 0), (303, [1.0] * 63 + [None], "", 0), (304, [float("nan")] + [1.0] * 63, "", 0), (305, [float("-inf")] + [1.0] * 63, "", 0), (306, [], "", 0)]
    schema = "vec_id long, embedding array<float>, cluster string, distance int"
    got = queries.op11_ball_kmeans(spark, write(spark, tmp_path, "embeddings", good + bad, schema))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = {r.vec_id: r for r in got.collect()}
    vectors = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, *_ in good]
    cluster, distance, centroids = brute_kmeans(vectors, 16, 3)
    assert sorted(rows) == sorted(i for i, _ in vectors)
    for (i, _), c, d in zip(vectors, cluster, distance, strict=True):
        r = rows[i]
        assert (r.cluster, r.distance) == (c, d)
        assert r.cluster_inertia == sum(x for x, y in zip(distance, cluster, strict=True) if y == c) and r.inertia == sum(distance)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


def test_kmeans_of_few_repeated_and_no_vectors(spark):
    schema = "vec_id long, v array<double>"
    few = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [5.0, 5.0]), (2, [5.0, 5.0])], schema)
    rows, found = balls.ball_kmeans(spark, few, "vec_id", "v", width=2, k=16, rounds=2)
    assert len(found.centroids) == 4 and sum(found.members) == 4 and sum(found.inertia) == 0
    # equal centroids: the smaller number takes all
    assert sorted(Counter(r.cluster for r in rows.collect()).values()) == [2, 2]
    rows, found = balls.ball_kmeans(spark, few.filter("vec_id > 9"), "vec_id", "v", width=2)
    assert rows.columns == ["vec_id", "cluster", "distance"] and rows.count() == 0 and len(found.centroids) == 0
    with pytest.raises(Exception, match="64 bits"):
        balls.ball_kmeans(spark, spark.createDataFrame([(1, [1e30, 0.0])], schema), "vec_id", "v", width=2)


# mixture packing


def ids_of(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    return [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def check_packing(rows, docs, window):
    """Every id of every document lies in one piece; sequences have no gaps; all are full or of a power of two."""
    wanted = Counter()
    for (i, _, _), ids in zip(docs, ids_of([d[1] for d in docs]), strict=True):
        wanted[i, ids.tobytes()] += 1
    pieces, seats = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seats[r.sequence_id].append((r.offset, r.length))
    for i, rs in pieces.items():
        if len([k for k in wanted if k[0] == i]) == 1 and wanted[next(k for k in wanted if k[0] == i)] == 1:
            rs.sort(key=lambda r: r.start)
            whole = b"".join(bytes(r.ids) for r in rs)
            assert wanted[i, whole] == 1 and all(r.doc_tokens * 4 == len(whole) for r in rs)
            assert [r.start for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist()
    assert sum(r.length for r in rows) == sum(len(k[1]) // 4 * n for k, n in wanted.items())
    sizes = {}
    for s, places in seats.items():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at and length > 0
            at += length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    short = [n for n in sizes.values() if n != window]
    assert all(n & (n - 1) == 0 for n in short) and len(short) < window.bit_length() and sum(short) < window
    return seats


def make_docs(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "c", None])
        out.append((i, " ".join(rng.choice(["alpha", "beta", "don't", "x1", "日本"]) for _ in range(rng.choice([0, 1, 5, 60]))), source))
    return [*out, (n, None, "b"), (None, "no id", "c"), (None, "", None), (3, "an id again", "b"), (n + 1, "long " * 9000, "c")]


@pytest.mark.parametrize("block,small", [(2, 200_000), (256, 200_000), (3, 0)])
def test_packing(spark, monkeypatch, block, small):
    monkeypatch.setattr(packing, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", small)
    docs = make_docs(150)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, ids string").repartition(5)
    rows = packing.pack(spark, df, queries.vocabulary("byte_bpe_50k.json"), window=64, least=1).collect()
    check_packing(rows, docs, 64)
    # every window has the sources' shares, within an id for each source
    total, share, mixed = 0, Counter(), defaultdict(Counter)
    for r in rows:
        share[r.source] += r.length
        mixed[r.sequence_id][r.source] += r.length
        total += r.length
    for counts in mixed.values():
        n = sum(counts.values())
        if n == 64:
            assert all(abs(counts[s] - n * share[s] / total) <= len(share) for s in share)


def test_packing_to_given_proportions(spark):
    docs = [(i, "word " * 50, "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(spark, df, queries.vocabulary("byte_bpe_50k.json"), window=64, weights={"a": 0.5, "b": 0.25}, least=1).collect()
    check_packing(rows, docs, 64)
    mixed = defaultdict(Counter)
    for r in rows:
        mixed[r.sequence_id][r.source] += r.length
    size = sum(r.length for r in rows if r.source == "a")
    both = int(size / 32)  # windows until a has run out
    assert all(abs(mixed[i]["a"] - 32) <= 3 and abs(mixed[i]["b"] - 16) <= 3 for i in range(both - 1))
    # then b and the rest share alike
    assert all(mixed[i]["a"] == 0 and abs(mixed[i]["b"] - 32) <= 3 for i in range(both + 2, both + 6))
    with pytest.raises(ValueError):
        packing.pack(spark, df, queries.vocabulary("byte_bpe_50k.json"), weights={"a": 0.9, "b": 0.2})


def test_packing_with_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 3)
    docs = [(i, "some words here", f"s{i % 7}") for i in range(70)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(spark, df, queries.vocabulary("byte_bpe_50k.json"), window=16).collect()
    check_packing(rows, docs, 16)
    assert {r.source for r in rows} == {"s0", "s1", None}


def test_packing_of_nothing_and_of_one_queue(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    path = queries.vocabulary("byte_bpe_50k.json")
    assert packing.pack(spark, df.filter("doc_id > 1"), path, source=None).count() == 0
    rows = packing.pack(spark, df, path, source=None).collect()
    check_packing(rows, [(1, "a b c", None)], 1024)
    assert packing.capacities(2 * 1024 + 700, 1024) == [1024, 1024, 512, 128, 32, 16, 8, 4]


def test_queue_order_is_one_order():
    rng = random.Random(4)
    for t in range(60):
        totals = [rng.choice([rng.randrange(1, 5), rng.randrange(1, 200), rng.randrange(1, 2000)]) for _ in range(rng.randrange(1, 7))]
        weights = [float(x) for x in totals] if t % 2 else [rng.random() + 0.01 for _ in totals]
        mixture = packing.Mixture(totals, weights)
        queue, k = np.repeat(np.arange(len(totals)), totals), np.concatenate([np.arange(x) for x in totals])
        rank = mixture.rank(queue, k)
        assert sorted(rank.tolist()) == list(range(sum(totals)))
        for b in range(0, sum(totals), 32):
            inside = (rank >= b) & (rank < b + 32)
            there = np.unique(queue[inside])
            sizes, place = np.array([(queue[inside] == q).sum() for q in there]), np.array([k[inside & (queue == q)].min() for q in there])
            capacity = packing.capacities(int(sizes.sum()), 8)
            out = packing.deal(sizes, mixture.weights[there], mixture.due(b, there) - place, capacity)
            assert out.sum(axis=1).tolist() == capacity and out.sum(axis=0).tolist() == sizes.tolist() and (out >= 0).all()


def test_small_claims_wait():
    """Pieces of at least ``least`` ids; no queue is ever further than that, and a turn of the others, from its due."""
    shares = np.array([0.36] + [0.64 / 19] * 19)
    sizes = np.round(shares * 1024 * 256).astype(np.int64)
    sizes[0] += 1024 * 256 - sizes.sum()
    out = packing.deal(sizes, sizes.astype(float), np.zeros(20), [1024] * 256, 128)
    assert out.sum(axis=1).tolist() == [1024] * 256 and out.sum(axis=0).tolist() == sizes.tolist()
    served, due = np.cumsum(out, axis=0), np.outer(np.arange(1, 257), shares * 1024)
    assert np.abs(served - due).max() <= 2 * 128
    # all but the last piece of a window are whole, but for the block's last windows
    assert (out > 0).sum(axis=1)[:-20].max() <= 8 and ((out > 0) & (out < 128)).sum(axis=1)[:-20].max() <= 1


def test_packing_query(spark, tmp_path):
    docs = make_docs(60)
    rows = queries.op12_mixture_packing(spark, write(spark, tmp_path, "documents", docs, "doc_id long, text string, source string")).collect()
    ids = {i: x for (i, _, _), x in zip(docs, ids_of([d[1] for d in docs]), strict=True)}
    for r in rows:
        if r.doc_id not in (None, 3):
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])


# periodic runs


def brute_runs(s, min_length=2, min_exponent=2):
    n, out = len(s), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(min_length, min_exponent * p) and not any(all(s[x] == s[x + q] for x in range(i, i + length - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_symbols_against_brute_force():
    rng = random.Random(1)
    for _ in range(700):
        letters = rng.choice([1, 2, 2, 3, 4])
        s = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.4:
            s += s[: rng.randrange(1, 8)] * rng.randrange(1, 6) + [rng.randrange(letters)]
        assert list(zip(*(x.tolist() for x in periodic.runs(np.array([*s, 99]))), strict=True)) == brute_runs(s), s


def test_extensions_and_places_of_the_tree():
    rng = random.Random(6)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randrange(2, 50))] + [9]
        tree = periodic.SuffixTree(np.array(s))
        n = len(s)
        assert tree.sa.tolist() == sorted(range(n), key=lambda i: s[i:])
        i, j = np.array([(a, b) for a in range(n) for b in range(n) if a != b]).T
        for x, y, f, b in zip(i.tolist(), j.tolist(), tree.ahead(i, j).tolist(), tree.behind(i, j).tolist(), strict=True):
            assert f == next((d for d in range(n) if max(x, y) + d >= n or s[x + d] != s[y + d]))
            assert b == next((d for d in range(n + 1) if min(x, y) - d < 0 or s[x - d] != s[y - d]))
        tree.nodes()
        for depth in (1, 2, 5):
            at = np.arange(max(0, n - depth))
            for x, node in zip(at.tolist(), tree.places(at, np.full(len(at), depth)).tolist(), strict=True):
                same = sorted(y for y in range(n) if s[y : y + depth] == s[x : x + depth])
                low, high = (-1 - node, -1 - node) if node < 0 else (tree.low[node], tree.high[node])
                assert sorted(tree.sa[low : high + 1].tolist()) == same


@pytest.mark.parametrize("min_length,min_exponent", [(6, 4), (2, 2), (4, 3), (9, 5)])
def test_runs_of_rows_against_brute_force(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(120):
        rows = []
        for _ in range(rng.randrange(1, 6)):
            s = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(60))]
            if rng.random() < 0.6:
                p, k = rng.randrange(1, 9), rng.randrange(20)
                w = [rng.randrange(30) for _ in range(p)]
                s[k:k] = (w * 9)[: rng.randrange(1, 9 * p)]
            rows.append(s)
        found = periodic.runs_of(Words(pa.array([" ".join(f"w{x}" for x in s) for s in rows])), min_length, min_exponent)
        got = list(zip(*(x.tolist() for x in (found.row, found.start, found.length, found.period)), strict=True))
        assert got == [(r, *x) for r, s in enumerate(rows) for x in brute_runs(s, min_length, min_exponent)]


def test_find_runs(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "x y " * 5 + "z", "d"), (4, "x y " * 5 + "z", "d"), (None, "q " * 7, "e"), (5, "é ü ö " * 4, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.find_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    out = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    assert out == [(0, [(0, 7, 1)], "q"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 10, 2)], "x y z"), (4, [(0, 10, 2)], "x y z"), (5, [(0, 12, 3)], "é ü ö")]
    assert periodic.find_runs(docs.filter("doc_id > 9")).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_exponent=1)


def test_long_texts_with_many_runs():
    text = "a " * 100_000 + "b c " * 50_000 + " ".join(f"w{i}" for i in range(3000)) + " d" * 9
    nested = ("a a a a a a b " * 5 + "c ") * 9
    found = periodic.runs_of(Words(pa.array([text, nested])), 6, 4)
    rows = list(zip(*(x.tolist() for x in (found.row, found.start, found.length, found.period)), strict=True))
    assert [r[1:] for r in rows if r[0] == 0] == [(0, 100_000, 1), (100_000, 100_000, 2), (203_000, 9, 1)]
    assert [r[1:] for r in rows if r[0] == 1] == brute_runs(nested.split(), 6, 4)


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    docs = []
    for i in range(300):
        n = rng.choice([0, 1, 3, 30, 200])
        docs.append((i, rng.choice([" ", "\n", "  "]).join(rng.choice(["der", "die", "x", "y", "zu", f"u{j}"]) for j in range(n))))
    docs += [(1000, None), (1001, " \t"), (1002, "la " * 40), (1003, "héé ñ " * 9)]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, write(spark, tmp_path, "documents", docs, "doc_id long, text string")).collect()}
    looped = 0
    for i, text in docs:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            looped += 1
        runs = brute_runs(w, 6, 4)
        keep = [not any(s + p <= j < s + length for s, length, p in runs) for j in range(n)]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        text = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        assert got[i] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), i
    assert looped > 10
