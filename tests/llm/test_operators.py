"""The training-data operators against brute force, round trips and planted cases, nulls and ties included."""

import base64
import io
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, chat, decontaminate, idfiles, neardup, queries, repeats, severity, warc, winnow
from tidemark.llm.workspace import Workspace

HOSTILE = ["", None, " ", "a", "b b b b b b b b", "héllo wörld 你好 🎉", "<|endoftext|> x <|endoftext|>", "x" * 5000, "tab\tand\nline  end ", "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra") for i, t in enumerate(HOSTILE)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def test_codec_is_the_library(docs):
    import tiktoken

    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs, path).collect():
        assert r.ids == lib.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.n_tokens == "extra"


def test_counts_are_the_library(docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.token_counts(docs, path).collect():
        assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)


def test_perfect_hash():
    keys = [str(i).encode() for i in range(999)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(999))
    assert h.slot(b"none") == -1


@pytest.mark.parametrize("n", [0, 1, 7, 2048, 2049, 6000])
def test_range_coder_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.int64)
    packed = idfiles.MAGIC + idfiles.pack_chunk([3], [n], ids)
    ((names, lengths, back),) = idfiles.read_chunks(io.BytesIO(packed))
    assert back.tolist() == ids.tolist() and names.tolist() == [3] and lengths.tolist() == [n]
    if n:
        with pytest.raises(ValueError):
            list(idfiles.read_chunks(io.BytesIO(packed[:-1] + bytes([packed[-1] ^ 1]))))


def test_blocks_share_the_chances_of_their_chunk(monkeypatch):
    rng = np.random.default_rng(5)
    follow = rng.integers(0, 3000, (3000, 4))
    ids = np.zeros(100_000, np.int64)
    for i, pick in enumerate(rng.integers(0, 4, len(ids) - 1).tolist()):
        ids[i + 1] = follow[ids[i], pick]
    packed = idfiles.MAGIC + idfiles.pack_chunk([1], [len(ids)], ids)
    assert next(idfiles.read_chunks(io.BytesIO(packed)))[2].tolist() == ids.tolist()
    assert 8 * len(packed) < 8 * len(ids)  # blocks that each start from nothing took 13.4 bits an id
    counts = np.array([idfiles.BLOCK] * 4 + [100])
    model, payloads = idfiles.encode_blocks(ids[: counts.sum()], counts)
    model = idfiles._Model.unpacked(model.packed())
    assert idfiles.decode_blocks(model, payloads[2:3], counts[2:3])[0].tolist() == ids[2 * idfiles.BLOCK : 3 * idfiles.BLOCK].tolist()
    monkeypatch.setattr(idfiles, "GRID", 0)
    assert idfiles.MAGIC + idfiles.pack_chunk([1], [len(ids)], ids) == packed


def test_range_coder_of_odd_ids():
    for ids in (np.zeros(5000, np.int64), np.arange(5000) * 13 % 100003, np.tile([70000, 5, 70000, 9], 1200), np.random.default_rng(3).integers(0, 1 << 20, 4097)):
        packed = idfiles.MAGIC + idfiles.pack_chunk([1, 2], [4, len(ids) - 4], ids)
        ((_, _, back),) = idfiles.read_chunks(io.BytesIO(packed))
        assert back.tolist() == ids.tolist()


def test_ids_are_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), idfiles.IdEncoder(path)
    rng = random.Random(9)
    bits = ["a", "Be", " ", "  ", "\n", "\t", "'s", "12", ".", "<|endoftext|>", "é", "\u00a0", "\u3000", "你", "\x1c", "!?", "\r\n", "\u200b"]
    texts = [(t or "") for t in HOSTILE] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(600)]
    for _ in range(2):
        ids, counts = own.encode(texts)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
        column, counts = own.encode_column(pa.array([*texts, None, "plain words only", "a\nb c\td"]))
        at = np.concatenate([[0], np.cumsum(counts)])
        for i, t in enumerate([*texts, "", "plain words only", "a\nb c\td"]):
            assert column[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
        own.MEMO_CHARS = 0  # the memory starts anew
    assert own.encode([])[1].tolist() == [] and own.encode_column(pa.array([], pa.string()))[1].tolist() == []
    # a vocabulary that is not byte-level gets texts whole
    path = queries.vocabulary("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), idfiles.IdEncoder(path)
    ids, counts = own.encode_column(pa.array(["Some words here", None, "x  y"]))
    assert ids.tolist() == [i for t in ("Some words here", "", "x  y") for i in lib.encode(t, add_special_tokens=False).ids] and len(counts) == 3


def test_id_files(spark, docs, empty, monkeypatch):
    import zlib

    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(None, "no id", "x"), (4, "an id again", "x")], docs.schema)
    monkeypatch.setattr(idfiles, "BLOCK", 7)
    monkeypatch.setattr(idfiles, "LANES", 5)  # documents go over blocks and chunks
    got = idfiles.file_round_trip(spark, docs.union(extra), path, Workspace(spark, "t")).collect()
    start, want = 0, []
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    for t, i in [*((t, i) for i, t in enumerate(HOSTILE)), ("no id", None), ("an id again", 4)]:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((-1 if i is None else i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)]
    assert sorted(key) == sorted(want) and [k[0] for k in key] == sorted(k[0] for k in key)
    assert idfiles.file_round_trip(spark, empty, path, Workspace(spark, "t")).collect() == []


def _brute_repeats(texts, n):
    words = [[] if t is None else t.split() for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for d, w in enumerate(words):
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            if key in seen:
                gone[d] |= set(range(p, p + n))
            seen.add(key)
    return [[x for i, x in enumerate(w) if i not in gone[d]] for d, w in enumerate(words)]


@pytest.mark.parametrize("group_rows, list_rows", [(4096, 4096), (2, 4096), (1, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, group_rows, list_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(repeats, "LIST_ROWS", list_rows)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(40)] + [None, "", "a a a a a a a a a a"] + ["a b b a b a a b a b b a"] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.drop_repeats(spark, df, 4).collect()}
    for i, want in enumerate(_brute_repeats(texts, 4)):
        assert (got[i].text or "").split() == want
        assert got[i].n_words - got[i].n_removed == len(want)
    assert repeats.drop_repeats(spark, df.filter("doc_id < 0"), 4).count() == 0


@pytest.mark.parametrize("group_rows", [4096, 1])
def test_repeats_of_rows_given_twice(spark, monkeypatch, group_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    clean, again = "a b c d e f g h", "p q r s t p q r s t"
    rows = [(1, clean), (1, clean), (2, again), (2, again), (3, "x a b c d y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in repeats.drop_repeats(spark, df, 4).collect())
    assert got == [(1, clean), (1, clean), (2, "p q r s t"), (2, "p q r s t"), (3, "x y")]


def test_near_duplicate_stage_keeps_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (None, "other words"), (1, text), (2, text)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, text), (0, "other words"), (1, text)])


def _brute_groups(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    return comp


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "one", "one", "One two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, df, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_groups(texts, 3, 85)
    assert neardup.near_duplicates(spark, df.filter("doc_id < 0")).count() == 0


def test_posterior_bound():
    assert neardup.least_matches(0.85, 160) < 0.85 * 160
    assert neardup.least_matches(0.85, 32) <= neardup.least_matches(0.85, 64)


def test_preference_format(spark):
    rows = [(0, "chosen", 0, 0, "user", "hi"), (0, "chosen", 0, 1, "assistant", "yes"), (0, "rejected", 1, 0, "user", "hi"), (0, "rejected", 1, 1, "assistant", None), (None, "chosen", 2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "pair_id long, side string, conv_id long, turn long, role string, text string")
    got = sorted((r.segment, r.rendered, r.rendered[r.loss_from : r.loss_to]) for r in chat.preference_format(df, 5).collect())
    assert got == [("chosen", "<|assistant|>\nyes<|end|>\n", "yes<|end|>\n"), ("prompt", "<|user|>\nhi<|end|>\n", ""), ("rejected", "<|assistant|>\n<|end|>\n", "<|end|>\n")]


def test_preference_pairs(spark):
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    rows = [(1, s, c, t, r, x) for s, c, last in (("chosen", 5, "good"), ("rejected", 6, "bad")) for t, (r, x) in enumerate([("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", last), ("user", "ok"), ("assistant", last)])]
    rows += [(2, "chosen", 7, 0, "User", "alone"), (2, "chosen", 7, 1, None, None), (3, "chosen", 8, 0, "user", "a"), (3, "rejected", 9, 0, "user", "a")]
    rows += [(4, "chosen", 10, 0, "user", "x"), (4, "chosen", 10, 0, "user", "y"), (4, "rejected", 11, 0, "user", "y"), (4, "rejected", 11, 0, "user", "x"), (4, "rejected", 11, None, "assistant", "early")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "pair_id long, side string, conv_id long, turn long, role string, text string, segment string")
    got = {r.pair_id: r for r in chat.paired(chat.preference_format(df, len(rows))).collect()}
    one = got[1]
    assert one.prompt == turn("system", "be kind") + turn("user", "hi") + turn("assistant", "hello") + turn("user", "more")
    assert one.chosen == turn("assistant", "good") + turn("user", "ok") + turn("assistant", "good") and one.rejected == one.chosen.replace("good", "bad")
    assert [one.chosen[a:b] for a, b in one.chosen_spans] == ["good<|end|>\n"] * 2 and [one.rejected[a:b] for a, b in one.rejected_spans] == ["bad<|end|>\n"] * 2
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("", turn("user", "alone") + turn("unknown", ""), "") and got[2].chosen_spans == []
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == (turn("user", "a"), "", "")
    assert got[4].prompt == "" and got[4].rejected.startswith(turn("assistant", "early")) and len(got) == 4
    assert chat.paired(chat.preference_format(df.filter("pair_id < 0"), 0)).count() == 0
    # long conversations go on in further rows
    parts = sorted((r.part, r) for r in chat.paired(chat.preference_format(df.filter("pair_id = 1"), len(rows)), 2).collect())
    assert [p for p, _ in parts] == [0, 1, 2, 3]
    assert all("".join(r[s] for _, r in parts) == one[s] for s in ("prompt", "chosen", "rejected"))
    assert [r.rejected[a:b] for _, r in parts for a, b in r.rejected_spans] == ["bad<|end|>\n"] * 2


def test_preference_query(spark, tmp_path):
    import duckdb

    rows = [(c, t, r, f"{x} {c % 3}") for c in range(40) for t, (r, x) in enumerate([("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "thé end")][: 1 + c % 4])]
    rows += [(50, None, "user", "early"), (50, 0, None, None), (51, 1, "assistant", "twice"), (51, 1, "assistant", "twice"), (None, 0, "user", "x"), (52, 0, "Assistant", ""), (53, 300, "assistant", "late"), (53, 2, "user", "a"), (54, None, "assistant", None)]
    spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, side string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    df = queries.op3_preference_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.OP3_SQL})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want) and sum(bool(r[2]) for r in got) > 25


def test_winnowing_against_brute_force(spark):
    rng = random.Random(2)
    lists = [[rng.randrange(6) for _ in range(n)] for n in (0, 1, 3, 7, 8, 9, 40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<bigint>")
    for r in df.select("h", winnow.winnow(df.h).alias("m")).collect():
        want = []
        for a in range(max(1, len(r.h) - winnow.WINDOW + 1) if r.h else 0):
            part = r.h[a : a + winnow.WINDOW]
            at = a + max(i for i, v in enumerate(part) if v == min(part))
            if (r.h[at], at) not in want:
                want.append((r.h[at], at))
        assert [(m["hash"], m["pos"]) for m in r.m] == want


def test_winnowing_meets_shared_runs(spark):
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(500)] + ["\U0001F389", "\U00020000"]
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for offset in range(20):  # unspaced text, at each offset; one run of just the length that is guaranteed
        shared = some(winnow.GRAM + winnow.WINDOW - 1)
        rows.append((some(40) + shared + some(30), some(40 + offset) + shared + some(9)))
    rows += [("abcdefghij klmnopqrst", "abcdefghij kl 9876543"), ("", ""), ("Short", "sHORT")]
    df = spark.createDataFrame(rows, "a string, b string")
    marks = [winnow.winnow(winnow.gram_hashes(df[c])) for c in "ab"]
    got = df.select(winnow.likeness(marks[0]["hash"], marks[1]["hash"]).alias("x"), F.size(winnow.gram_hashes(df.a)).alias("n"), "a").collect()
    assert all(r.x > 0 for r in got[:21]) and [r.x for r in got[21:]] == [1.0, 1.0]
    assert [r.n for r in got] == [max(len(r.a) - winnow.GRAM + 1, min(len(r.a), 1)) for r in got]


def test_gram_hashes_against_brute_force(spark):
    import xxhash

    texts = ["ab\ncd\r\n ef gh\x00ij klmnopqrstuvw", "\u00e9\U0001F389" * 11, "", None, *("x" * n for n in (1, 7, 8, 15, 16, 17, 22, 23, 24, 40))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(F.coalesce("text", F.lit("")).alias("t"), winnow.gram_hashes(df.text).alias("h")).collect():
        grams = [r.t[i : i + winnow.GRAM] for i in range(max(1, len(r.t) - winnow.GRAM + 1))] if r.t else []
        assert [h % 2**64 for h in r.h] == [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]


def test_lookups_of_few_rows_are_one_broadcast_join(spark):
    from pyspark.sql import functions as F
    from tidemark.llm import workspace

    rows = spark.createDataFrame([(None if i % 7 == 0 else i % 5, i) for i in range(40)], "k long, i long")
    table = rows.filter("k < 4").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("most"))
    found = {whole: workspace.lookup(rows, table, "k", "n", 40, "i", whole=whole) for whole in (0, 39, workspace.WHOLE)}
    got = {whole: sorted(df.collect(), key=lambda r: r.i) for whole, df in found.items()}
    assert got[0] == got[39] == got[workspace.WHOLE] and len(got[0]) == 40
    assert [r.most for r in got[0][:6]] == [None, 36, 37, 38, None, 30]
    joins = {whole: df._jdf.queryExecution().optimizedPlan().toString().count("Join") for whole, df in found.items()}
    assert joins == {0: 2, 39: 2, workspace.WHOLE: 1}


def test_near_duplicates_release_the_driver_after_each_round(spark, monkeypatch):
    from tidemark.llm.workspace import Workspace

    calls, true = [], Workspace.release
    monkeypatch.setattr(Workspace, "release", lambda self: (calls.append(1), true(self)))
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "other words here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, df, size=3, percent=85).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(calls) >= 4


def test_known_words_of_a_column_are_found_by_their_bytes(monkeypatch):
    import pyarrow as pa
    from tidemark.llm.words import Words

    path = queries.vocabulary("byte_bpe_50k.json")
    rng = random.Random(12)
    some = lambda: "".join(rng.choice("abc\u00e9\U0001F389") for _ in range(rng.randrange(1, 21)))
    texts = [rng.choice(" \n\t").join(some() for _ in range(30)) for _ in range(40)] + ["", None, "a  b", "abcdefgh abcdefghi abcdefgh"]
    column = pa.array(texts)
    plain = idfiles.IdEncoder(path)
    want = [plain.library.encode(t or "", add_special_tokens=False).ids for t in texts]

    def check(encoder):
        ids, counts = encoder.encode_column(column)
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]

    check(plain)
    learnt = plain.learnt
    check(plain)
    assert plain.learnt == learnt > 500 and len(plain.memo) < 10  # only the text with two spaces is cut as a string
    true = Words.hashes
    monkeypatch.setattr(Words, "hashes", lambda self: true(self) % 50)  # words that share hashes
    shared = idfiles.IdEncoder(path)
    check(shared)
    check(shared)


def test_spliced_marks_are_those_of_the_joined_text(spark):
    rng = random.Random(11)
    kinds = ["abcdefgh XYZ", "ab", "\u00e9\U0001F389aB", "\u03a3\u0391 x", "\u0130I ab"]
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    rows = [(some(n, rng.choice(kinds)), some(m, rng.choice(kinds)), h, t) for n in (0, 5, 20, 21, 22, 60, 200) for m in (0, 7, 20, 21, 22, 60, 200) for h in {0, n // 2, n} for t in {m // 2, m, 300}]
    df = spark.createDataFrame(rows, "a string, b string, h int, t int")
    df = df.withColumn("ma", winnow.winnow(winnow.gram_hashes(df.a))).withColumn("mb", winnow.winnow(winnow.gram_hashes(df.b)))
    whole = F.concat(F.substring(df.a, F.lit(1), df.h), F.substring(df.b, F.lit(1), df.t))
    got = df.select(winnow.spliced_marks(df.a, df.ma, df.h, df.b, df.mb, df.t).alias("x"), winnow.winnow(winnow.gram_hashes(whole)).alias("y")).collect()
    assert len(got) > 200 and all(r.x == r.y for r in got)


def test_sets_of_marks_are_compared_outside_lambdas(spark):
    plan = queries.op7_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    (bound,) = [line for line in plan.split("\n") if "Generate inline" in line]
    assert "array_union" in plan and "array_union" not in bound


def test_next_text(spark):
    df = spark.createDataFrame([(i * 7, f"t{i}") for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: r.nx for r in winnow.with_next(df, "doc_id", "text", "nx").collect()}
    assert got == {i * 7: f"t{(i - 1) % 50}" for i in range(50)}


def test_runs_of_neighbours_grow_in_number_with_the_texts(spark, monkeypatch):
    """Runs of a bounded size whatever the input; long texts, repeated and null ids, one id alone, no rows."""
    monkeypatch.setattr(winnow, "BLOCKS", 3)
    monkeypatch.setattr(winnow, "RUN_BYTES", 500)
    rng = random.Random(5)
    ids = [*rng.sample(range(-500, 500), 200), 7, 7, 7, None, None]
    rows = [(i, f"text {rng.randrange(10**9)} " * 5) for i in ids]
    for given in (rows, rows[:-2], rows[:1], rows[-1:], [(None, "a"), (3, "b")], [(9, "a"), (9, "a"), (9, "b")]):
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        got = winnow.with_next(df, "doc_id", "text", "nx")
        found = sorted((r.doc_id is None, -(r.doc_id or 0), r.text, r.nx) for r in got.collect())
        assert sorted(x[2] for x in found) == sorted(t for _, t in given) and sorted(x[3] for x in found) == sorted(t for _, t in given)
        after = {x[:3]: x[3] for x in found}
        keys = sorted({x[:2] for x in found})
        of = {k: {x[2] for x in found if x[:2] == k} for k in keys}
        for k, following in zip(keys, keys[1:] + keys[:1]):  # a key's rows are followed by each other, and one of them by the next key's
            assert sum(after[(*k, t)] in of[following] for t in of[k]) >= 1 and all(after[(*k, t)] in of[k] | of[following] for t in of[k])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(winnow, "_upto", lambda key, bounds, f=winnow._upto: counts.append(len(bounds)) or f(key, bounds))
    counts = []
    for n in (50, 200):
        winnow.with_next(df.limit(n), "doc_id", "text", "nx")
    size = sum(len(t) for _, t in rows[:200])
    assert counts[1] > 3 * counts[0] > 9 and counts[1] >= 0.9 * size / 500 - 2


def test_leaks(spark):
    rng = random.Random(3)
    item = [f"b{i}" for i in range(30)]
    clean = [f"c{rng.randrange(900)}" for _ in range(300)]
    edited = list(item)
    edited[0] = "other"
    df = spark.createDataFrame([(0, " ".join(clean)), (1, " ".join(clean[:50] + item + clean[50:])), (2, " ".join(edited)), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "zz yy")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.pos) for r in decontaminate.find_leaks(df, bench).collect())
    assert got == [(1, 0, 50), (2, 0, 0)]
    assert decontaminate.find_leaks(df, bench.filter("item_id < 0")).collect() == []


def _brute_leaks(texts, items, threshold=0.8):
    out = {}
    for d, text in enumerate(texts):
        w = (text or "").lower().split()
        for k, item in enumerate(items):
            v = item.lower().split()
            size = min(5, len(v))
            grams = lambda x: Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1))
            for pos in range(len(w) - len(v) + 1):
                a, b = grams(w[pos : pos + len(v)]), grams(v)
                score = sum((a & b).values()) / sum((a | b).values())
                if score >= max(threshold, out.get((d, k), (0,))[0]) and score > out.get((d, k), (0,))[0]:
                    out[d, k] = (score, pos)
    return {key: (pos, score) for key, (score, pos) in out.items()}


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    items = [" ".join(f"b{rng.randrange(400)}" for _ in range(n)) for n in (1, 3, 5, 6, 13, 20, 40, 45, 52, 59, 59)] + ["a b a b a b a b a b a b a b", "a a a a a a a a a a a a a"]
    items.append(items[9])
    texts = [None, "", "a b a b a b a b a b a b a b a a a a a a a a a a a a a a"]
    for item in items:
        for edit in range(7):
            w = item.split()
            if edit == 1:  # halves swapped
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            elif edit == 2:  # rotated by some words
                w = w[3:] + w[:3]
            elif edit > 2:
                for _ in range(edit - 2):
                    at = rng.randrange(len(w) + 1)
                    w[at : at + rng.randrange(2)] = ["new"] * rng.randrange(2)
            around = [f"c{rng.randrange(900)}" for _ in range(rng.randrange(60))]
            cut = rng.randrange(len(around) + 1)
            texts.append(" ".join(around[:cut] + w + around[cut:]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.pos, r.similarity) for r in decontaminate.find_leaks(df, bench).collect()}
    want = _brute_leaks(texts, items)
    assert got == want
    assert (3 + 9 * 7 + 1, 9) in want and (3 + 9 * 7 + 2, 9) in want


def test_leaks_of_rows_with_one_id(spark):
    item = " ".join(f"b{i}" for i in range(20))
    halves = [" ".join(item.split()[:10]), " ".join(["x"] * 10 + item.split()[10:])]
    df = spark.createDataFrame([(0, halves[0]), (0, halves[1]), (1, item), (1, item), (2, "y " + item), (2, "z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.pos, r.similarity) for r in decontaminate.find_leaks(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect())
    assert got == [(1, 0, 1.0), (2, 1, 1.0)]


def test_severity_held_out():
    rng = random.Random(4)
    texts, grades = [], []
    for _ in range(600):
        words, g = [f"w{rng.randrange(300)}" for _ in range(40)], rng.choice([0, 0, 0, 1, 2])
        if g:
            words[rng.randrange(40)] = f"bad{g}"
        texts.append(" ".join(words))
        grades.append(g)
    grades = np.array(grades)
    ids, at = severity.features(pa.array(texts[:400]))
    model = severity.fit(ids, at, grades[:400], 3)
    up = model.above(model.scores(pa.array(texts[400:] + [None, ""])))
    assert ((up[:200, 0] >= severity.TOXIC_P) == (grades[400:] > 0)).mean() > 0.97
    assert (np.diff(model.thresholds) >= 0).all() and (up[200:, 0] < severity.TOXIC_P).all()


def test_severity_features():
    ids, at = severity.features(pa.array(["Bad, bad (bad)!", "bad", "?! --", None, "badness bad"]))
    rows = [set(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert rows[0] == rows[1] and len(rows[0]) == 1 and rows[2] == rows[3] == set()
    assert len(rows[4]) == 1 + 1 + len(severity.STEMS) and rows[1] < rows[4]


def test_severity_on_tables(spark, empty):
    rng = random.Random(6)
    rows = [(i, " ".join([f"w{rng.randrange(90)}" for _ in range(30)] + ["awful"] * (i % 5 == 0)), "x") for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x"), (None, "awful", "x"), (3, rows[3][1], "x")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(7, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (500, 1, 0)], "doc_id long, quality int, toxic int")
    model = severity.fit_on_labels(docs, severity.label_grades(labels))
    got = severity.grade_documents(docs, model).collect()
    assert len(got) == 204
    for r in got:
        assert (r.toxic_p >= severity.TOXIC_P) == ("awful" in (r.text or ""))
    bounded = severity.fit_on_labels(docs, severity.label_grades(labels), train_bytes=0)
    assert not bounded.weights.any()
    none = severity.fit_on_labels(docs, severity.label_grades(labels.filter("doc_id < 0")))
    assert all(r.toxic_p < severity.TOXIC_P for r in severity.grade_documents(docs, none).collect())
    assert severity.grade_documents(empty, model).count() == 0


def test_archives(spark):
    big = "<p>x</p>" * 300
    rows = [(1, "http://a/\r\nb", big, "z"), (2, None, big, "z"), (3, "u", None, "z"), (4, "u", "small", "z"), (5, "u", "small", "z"), (6, "u", "é" * 999 + "1", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    got = {r.page_id: r for r in warc.archive_round_trip(spark, df, Workspace(spark, "t")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert got[6].payload_bytes == 1999 and got[1].url == "http://a/%0D%0Ab"
    assert warc.archive_round_trip(spark, df.filter("page_id < 0"), Workspace(spark, "t")).count() == 0


def test_no_id_is_searched_for(monkeypatch):
    rng = np.random.default_rng(8)
    ids = (rng.zipf(1.2, 60_000) % 50257).astype(np.int64)
    ids[::3] = ids[1::3] // 2  # pairs that are frequent
    searched, true = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **more: (searched.append(np.size(v)), true(a, v, *args, **more))[1])
    packs = set()
    for grid in (1 << 30, 0):
        monkeypatch.setattr(idfiles, "GRID", grid)
        packs.add(idfiles.MAGIC + idfiles.pack_chunk([1], [len(ids)], ids))
    (packed,) = packs
    assert next(idfiles.read_chunks(io.BytesIO(packed)))[2].tolist() == ids.tolist()
    assert sum(searched) < len(ids) // 10  # each id was, among all pairs of its chunk


def test_contexts_of_all_sizes_are_read_back(monkeypatch):
    """Contexts with one id, with more than FINE bits hold, and ids that nothing lists."""
    rng = np.random.default_rng(4)
    wide = np.stack([np.full(16_384 * 9, 7), 10 + np.repeat(np.arange(16_384), 9)], axis=1)
    wide = np.concatenate([wide, np.tile([7, 10], (100_000, 1))])
    ids = np.concatenate([rng.permutation(wide).ravel(), np.tile([1, 2], 500), rng.integers(1 << 18, 1 << 20, 40_000)]).astype(np.int64)
    for most in (1 << 14, 1 << 13, 100):
        monkeypatch.setattr(idfiles, "MOST", most)
        packed = idfiles.MAGIC + idfiles.pack_chunk([1], [len(ids)], ids)
        assert next(idfiles.read_chunks(io.BytesIO(packed)))[2].tolist() == ids.tolist()


def test_places_of_numbers():
    from tidemark.llm.words import Places

    rng = np.random.default_rng(2)
    for kind, step in ((np.uint64, 1 << 40), (np.int64, 3), (np.int32, 1)):
        keys = (rng.permutation(20_000) * step).astype(kind)
        places = Places(keys[:0])
        for a, b in ((0, 1), (1, 700), (700, 700), (700, 9_000)):
            places.add(keys[a:b])
            assert places.find(keys).tolist() == [i if i < b else -1 for i in range(len(keys))]


def test_punctuation_after_a_letter_is_a_stretch():
    import pyarrow as pa

    path = queries.vocabulary("byte_bpe_50k.json")
    own = idfiles.IdEncoder(path)
    bits = ["a", "Zq", "'s", "'re", "7", ".", ",", "!?", "***", "'", "\u00e9", "\u00d7", "\u00f7", "\u0301", "\u4f60", "\u2026", "\U0001F389", "\ufb01"]
    rng = random.Random(6)
    texts = [rng.choice(" \n\t").join("".join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    texts += [f"{c}, x{c}. b{c}?! {c}{c}'s {c}" for c in map(chr, range(0xC0, 0x260))] + ["...", "a", "a,", ", a", "' a'"]
    for _ in range(2):
        ids, counts = own.encode_column(pa.array(texts))
        want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    few = idfiles.IdEncoder(path)
    few.encode_column(pa.array(["x tree tree, tree. tree!? leaf leaf, leaf. leaf!?"]))
    assert few.learnt == 6  # x, tree, leaf and three endings; each word with each ending was learnt before: 9
