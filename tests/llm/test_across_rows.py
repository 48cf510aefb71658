"""Operators that compare rows, against brute force and SQL, with the awkward rows too."""

import base64
import hashlib
import random
import re
import struct
import time
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import groups, plain_contamination, plain_dedup, plain_fingerprint, plain_windows
from vecpack.llm import bpe, common, decontaminate, embedding_dedup, language_id, line_dedup, oracle, simhash
from vecpack.llm.components import connected_components
from vecpack.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) AS expected").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))


# Components

@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(None, 1), (2, None)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(i, i + 2) for i in range(100)] + [(500, 501)], [(-5, 7), (7, 2**62), (3, -(2**62))],
], ids=["none", "loop", "null", "double", "chain", "star", "two", "extremes"])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = groups({n for e in real for n in e}, real)
    assert len(got) == len(want) == len({r["node"] for r in got})
    named = defaultdict(set)
    for r in got:
        named[r["root"]].add(r["node"])
    assert sorted(map(sorted, named.values())) == sorted(map(sorted, (lambda d: [d[k].append(n) or d[k] for n, k in want.items()] and d.values())(defaultdict(list)))) if want else not named


# Vectors

def brute_vectors(rows, threshold=0.9):
    good = {i: np.array(v, np.float64) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    group = groups(range(len(rows)), links)
    least = {}
    for i, g in group.items():
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted(repr((rows[i][0], n[i], least.get(group[i]), rows[i][0] == least.get(group[i]))) for i in range(len(rows)))


def vector_rows(seed, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(16) if i % 3 == 0 or not rows else np.array(rows[rng.integers(0, i)][1]) + rng.standard_normal(16) * rng.choice([0.05, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in base * rng.choice([1, 5])]))
    return rows


@pytest.mark.parametrize(("piece", "cell"), [(1024, 512), (20, 512), (20, 32)])
def test_vectors_against_brute_force(spark, piece, cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PIECE", piece)
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rows = vector_rows(7)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # copies of one
    rows += [(2000 + i, [float(np.float32(x + 0.01 * i / 100)) for x in rows[5][1]]) for i in range(120)]  # one large group of near ones
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=0.999999).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_vectors(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.01]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]), (13, [1e30, 1e30]), (14, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, node string")
    got = embedding_dedup.near_duplicates(df, recall=0.999999).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_only_nulls_in_a_group(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()] == [(None, 1, None, True)] * 2


def at_cosine(rng, x, cosine):
    """A unit vector at that cosine from each row."""
    y = rng.standard_normal(x.shape)
    y = embedding_dedup._unit(y - (x * y).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * y


def test_plan_reaches_its_recall():
    for rows in (2, 1000, 10**6, 10**9):
        p = embedding_dedup.Plan.of(rows, 0.9, 0.999)
        assert rows / 2**p.bits <= embedding_dedup.CELL and p.lists >= 1 and 2 < p.count < embedding_dedup.PROJECTIONS
    rng = np.random.default_rng(3)
    plan = embedding_dedup.Plan.of(50_000, 0.9, 0.999)
    x = embedding_dedup._unit(rng.standard_normal((5000, 64)))
    z = at_cosine(rng, x, 0.9)
    share = (embedding_dedup._places(x, plan) == embedding_dedup._places(z, plan)).any(axis=1)
    own = embedding_dedup._directions(plan, 64)[2]
    collide = (np.abs(x @ own - z @ own) <= plan.window).sum(axis=1) >= plan.count
    frame = np.abs(x @ own - z @ own)[:, 0] <= plan.frame
    assert (share & collide & frame).mean() > 0.995


def test_windows_prune():
    """Most pairs of a cell don't collide often enough to be verified."""
    rng = np.random.default_rng(4)
    plan = embedding_dedup.Plan.of(50_000, 0.9, 0.999)
    values = embedding_dedup._unit(rng.standard_normal((500, 64))) @ embedding_dedup._directions(plan, 64)[2]
    collisions = (np.abs(values[:, None] - values[None]) <= plan.window).sum(axis=2)
    assert (collisions >= plan.count).mean() < 0.12


def test_planted_pairs_are_found_with_the_default_recall(spark):
    """Through the query's own parameters: pairs just above the threshold, pairs just below it, and unrelated rows."""
    rng = np.random.default_rng(9)
    x = embedding_dedup._unit(rng.standard_normal((2000, 64)))
    cosines = np.concatenate([rng.uniform(0.9001, 0.92, 1500), rng.uniform(0.88, 0.8999, 500)])[:, None]
    z = np.float32(at_cosine(rng, x, cosines))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([np.float32(x), z, np.float32(rng.standard_normal((4000, 64)))]))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)).collect()}
    assert len(got) == len(rows)
    found = sum(got[2000 + i] == (1, i) and got[i] == (1, i) for i in range(1500))
    assert found >= 0.99 * 1500
    assert all(got[i] == (0, i) for i in [*range(1500, 2000), *range(3500, 8000)])


# SimHash

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉß \t\n\x0b\x1c\xa0", max_size=40))
def test_fingerprints(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_hashes_in_sql():
    """The SQL's XXH64 is the library's, of texts of all lengths."""
    rng = random.Random(8)
    grams = {"", "a", "é", "日本語"} | {"".join(rng.choice("abc é日 xyz") for _ in range(rng.randint(0, 120))) for _ in range(300)}
    db = duckdb.connect()
    db.execute("CREATE TABLE grams (gram VARCHAR)")
    db.executemany("INSERT INTO grams VALUES (?)", [(g,) for g in grams])
    got = dict(db.sql(oracle.xxh64("grams")).fetchall())
    assert got == {g: xxhash.xxh64_intdigest(g.encode(), 42) for g in grams}


def test_fingerprint_of_long_text_in_pieces(monkeypatch):
    text = " ".join(map(str, range(3000)))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole and whole % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_anchors_cover(blocks):
    rng = np.random.default_rng(blocks)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    y = x.copy()
    for k in range(300):
        for b in rng.choice(64, k % 3, replace=False):
            y[k] ^= np.uint64(1 << int(b)).astype(np.int64)
    plan = simhash.Anchors(2, blocks)
    homes, of = plan.of_all(x, True)
    assert of.tolist() == list(range(300))  # each has one home
    anchors, rows = plan.of_all(y, False)
    assert set(zip(homes.tolist(), range(300), strict=True)) <= set(zip(anchors.tolist(), rows.tolist(), strict=True))
    assert len(set(zip(anchors.tolist(), rows.tolist(), strict=True))) == len(rows)


def test_codes_are_perfect():
    golay, hamming = simhash.Code(*simhash.Anchors.GOLAY, 2), simhash.Code(*simhash.Anchors.HAMMING, 2)
    assert (np.diff(golay.near[0][0]) == 1).all() and (np.diff(hamming.near[0][0]) == 1).all()


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:100]:
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64)}
    fps = [struct.unpack("<q", struct.pack("<Q", f))[0] for f in fps]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) % 2**64).count("1") <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicate_frame(spark):
    rows = [(5, "a b c d"), (3, "A b\tc  d"), (4, None), (9, ""), (9, ""), (None, " \n"), (None, "x y"), (None, "x y"), (1, "q")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, FP string")
    got = sorted(repr(tuple(r)) for r in simhash.near_duplicates(df).drop("tag", "group").collect())
    least = {0: 4, plain_fingerprint("a b c d"): 3, plain_fingerprint("x y"): None, plain_fingerprint("q"): 1}
    assert got == sorted(repr((i, f"{plain_fingerprint(t):016x}", least[plain_fingerprint(t)])) for i, t in rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@needs_data
def test_near_duplicates_of_the_test_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups(fps, [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, str(DATA)).collect()} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}


# Lines

@pytest.mark.parametrize("seed", range(3))
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(12)]
    docs = [(i, None if i == 7 else "\n".join(rng.choice([" ", ""]) + rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least=8).collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain_dedup(docs, 8)


def test_longer_match_with_a_later_document(spark):
    """A run that is equal to the second document's, of which the first has only a part."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    docs = [(1, f"{x}\n{y}"), (2, f"{x}\n{y}\n{z}\nown words"), (3, f"before\n{x}\n{y}\n{z}\nafter")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 2, 0), 2: (f"{z}\nown words", 4, 2), 3: ("before\nafter", 5, 3)}


def test_awkward_lines(spark):
    long = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, long, 7), (2, None, 7), (3, "", 7), (4, f"{long}\n\n{long}", 7), (5, "\n" * 2000, 7)], "doc_id long, text string, N_LINES int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted([(1, "", 1, 1), (1, "", 1, 1), (None, long, 1, 0), (2, None, 0, 0), (3, "", 1, 0), (4, "", 3, 2), (5, "\n" * 2000, 2001, 0)], key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [16 << 20, 0], ids=["broadcast", "shuffled"])
def test_long_documents_of_many_lines(spark, bound, monkeypatch):
    """A passage of a document of 20,000 lines stands again in others; the hot line between them isn't a passage."""
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", bound)
    long = [f"line {i} of the long one with words of its own" if i % 3 else "the hot line" for i in range(20_000)]
    docs = [(1, "\n".join(long)), (2, "\n".join(["before it", *long[5001:5021], "after it"])), (3, "\n".join(["the hot line"] * 9)), (4, "\n".join(long[19_000:]))] + [(10 + i, f"own {i}\nthe hot line\nend {i}") for i in range(300)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**{i: (t, 0) for i, t in docs}, 2: ("before it\nafter it", 20), 4: ("", 1000)}


def test_every_column_comes_back(spark):
    """Of names like those that are used within, too; repeated rows and nulls as they came."""
    text = "\n".join(f"words of line {i} and more of them" for i in range(9))
    names = ["tag", "doc_key", "cut_runs", "cut_key", "cut_tag", "h", "pos", "line", "gram", "place", "first"]
    df = spark.createDataFrame([(1, text, *names), (2, text, *names), (2, text, *names), (None, None, *[None] * len(names))], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    got = line_dedup.cut_runs(df)
    assert got.columns == df.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, [r if r["doc_id"] != 2 else type(r)(**{**r.asDict(), "text": ""}) for r in df.collect()]))


# Benchmark passages

def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["the", "É", "ﬁ"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 5, 12, 13, 14, 30, 40])] + [(10, None), (9, "the the the"), (100, "THE the-the"), (6, "w1 w2 nowhere")]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(i % 3):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(parts))
            parts[at:at] = w[rng.randint(0, 3) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(None, None), (None, ""), (70, "the " * 500), (70, "the " * 500)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, tag string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, bench).drop("tag").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((k, *plain_contamination(t, plain_windows(items)))) for k, t in docs)


def test_empty_tables_of_passages(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["contaminated"]) for r in decontaminate.contamination(docs, none).collect()] == [(2, False)]
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_items_without_an_id(spark):
    """They hit words and count once, and have no place in the digest; ids that come again are one item."""
    phrase = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"{phrase} q {phrase}"), (2, "q0 q1")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, phrase), (None, "q0 q1"), (7, phrase), (7, "q0 q1")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (27, 26, 2, hashlib.sha256(b"7").hexdigest()), 2: (2, 2, 2, hashlib.sha256(b"7").hexdigest())}


def test_a_long_text_and_its_passage(spark):
    words = [f"w{i % 5000}x{i // 5000}" for i in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50_000:50_030]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words[50_000:50_020]))], "item_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()) == [(1, 120_000, 20, False), (2, 30, 20, True)]


def test_shuffled_vocabulary_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_TERMS", 0)
    phrase = " ".join(f"p{i}" for i in range(13))
    docs = spark.createDataFrame([(1, f"x {phrase} y"), (2, phrase.replace("p6", "other p6")), (3, "p0 p1 p2"), (4, "none")], "doc_id long, text string")
    index = decontaminate.PositionalIndex(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert [(r["doc_key"], r["start"], r["length"]) for r in index.phrases().collect()] == [(1, 2, 13)]
    assert sorted(r["doc_key"] for r in index.proximity(1).select("doc_key").distinct().collect()) in ([1, 2], [1, 2, 3])
    assert 1 in [r["doc_key"] for r in index.proximity(0).collect()]


# Byte-level BPE

@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [6_000_000, 50])
def test_ids_are_those_of_the_library(spark, reference, block, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n  x", "it's 12345 the they're  \t", "日本語 😀é <|endoftext|>", "a" * 5000, "\x00\x1c \xa0"] + ["".join(rng.choice("ab c\n'1é😀") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i % 5 if i % 7 else None, t, i) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    encoded = bpe.encode(df, VOCABULARY, PATTERN)
    got = bpe.decode(encoded, VOCABULARY).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = reference.encode_ordinary(texts[r["n"]] or "")
        assert (r["ids"], bytes(r["decoded"])) == (ids, (texts[r["n"]] or "").encode())
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert bpe.encode(df.limit(0), VOCABULARY, PATTERN).count() == 0


def test_rows_of_a_shuffle(spark, reference):
    """Sorted within their partitions, rows make the same blocks in whatever order they come."""
    rows = [(i % 40, f"text {i} of some words {i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode(df, VOCABULARY, PATTERN, ordered=False).collect())
    assert got == sorted((i, reference.encode_ordinary(t)) for i, t in rows)


def test_word_lists_are_shuffled_once(spark):
    """Texts are split once, and two exchanges take lists to their buckets and ids back to the blocks."""
    encoded = bpe.encode(spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(3), VOCABULARY, PATTERN)
    assert len(encoded.collect()) == 40
    plan = encoded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sorted("ReusedExchange" in line for line in lines) == [False, False, True]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, IDS string, bpe_block string")
    assert bpe.encode(df, VOCABULARY, PATTERN).columns == ["doc_id", "ids", "n_tokens", "ids_sha256"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**28 - 1)))
def test_short_numbers(x):
    assert bpe._long(bpe._short(np.array(x, np.int64))).tolist() == x


@needs_data
def test_round_trip_of_the_test_documents(spark, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op9_bpe"](spark, str(DATA)).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


# Languages

@needs_data
def test_held_out_accuracy(spark):
    """A model of half the documents tells the language of the others, by their texts alone."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(str(DATA).replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), rows=400)
    judged = language_id.identify_documents(docs.where("doc_id % 2 = 1").select(F.col("lang").alias("truth"), "text", F.lit(None).cast("string").alias("source")), model)
    rows = judged.select("truth", "lid_lang", "lid_kept").collect()
    assert np.mean([r["truth"] == r["lid_lang"] for r in rows]) > 0.98
    assert np.mean([r["lid_kept"] for r in rows]) > 0.99


@pytest.fixture(scope="module")
def model(spark):
    texts = {"en": "the cat and the dog with that other thing taxi taxi", "de": "der hund und die katze mit einem anderen ding taxi taxi"}
    return language_id.fit(spark.createDataFrame([(i, f"{t} {i}", k) for i in range(20) for k, t in texts.items()], "doc_id long, text string, lang string"))


def test_rare_labels_have_a_class(spark):
    """Also where the sample of all rows has none of them, and where a label is one key many times."""
    common = [(i, f"the cat and the dog {i}", "en") for i in range(3000)]
    rare = [(10_000 + i, "der hund und die katze mit einem anderen ding", "de") for i in range(3)] + [(20_000, "le chat et le chien", "fr")] * 50
    labelled = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    assert language_id.fit(labelled, rows=20, label_rows=10).languages == ["de", "en", "fr"]
    hashed = labelled.selectExpr("lang AS label", "doc_id AS key", "xxhash64(doc_id) AS h").distinct()
    of_en = [r[0] for r in hashed.where("label = 'en'").orderBy("h").limit(10).select("key").collect()]
    assert sorted(key for _, key in language_id._least_of_each(hashed, 10)) == sorted(of_en + [10_000, 10_001, 10_002, 20_000])


def test_awkward_texts(spark, model):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "1234 !!", "en", "a"), (4, "the dog and that cat", None, None), (4, "the dog and that cat", None, None), (5, "дом и кот", "en", "a"), (None, "die katze und der hund " * 9000, "en", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, LID_KEPT int")
    got = {r["doc_id"]: (r["lid_lang"], r["lid_kept"]) for r in language_id.identify_documents(df, model).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("und", False), 4: ("en", True), 5: ("und", False), None: ("de", True)}
    assert language_id.identify_documents(df.limit(0), model).count() == 0
    none = language_id.fit(df.limit(0))
    assert {r["lid_lang"] for r in language_id.identify_documents(df, none).collect()} == {"und"}


def test_declarations_addresses_and_hosts_decide_short_texts(spark, model):
    """A text that says little takes the language that the markup, the address or the host's other pages say."""
    page = "<html lang='{}'><body><p>{}</p></body></html>"
    sure = [(i, f"http://h{i % 2}.x.com/p", page.format("", ["the cat and the dog", "der hund und die katze"][i % 2])) for i in range(40)]
    short = [(100, "http://u.org/p", page.format("de", "taxi")), (101, "http://u.org/p", page.format("en", "taxi")), (102, "http://de.u.net/p", "<p>taxi</p>"), (103, "http://h0.x.com/q", "<p>taxi</p>"), (104, "http://h1.x.com/q", "<p>taxi</p>"), (105, None, None)]
    df = spark.createDataFrame(sure + short, "page_id long, url string, html string")
    got = {r["page_id"]: r["lid_lang"] for r in language_id.identify_pages(df, model).collect()}
    assert [got[i] for i in range(100, 105)] == ["de", "en", "de", "en", "de"] and got[105] == "und" and got[0] == "en" and got[1] == "de"


def test_many_hosts_meet_in_a_join(spark, model, monkeypatch):
    df = spark.createDataFrame([(i, "the cat and the dog", None, f"s{i % 3}") for i in range(9)], "doc_id long, text string, lang string, source string")
    few = sorted(map(tuple, language_id.identify_documents(df, model).collect()))
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, language_id.identify_documents(df, model).collect())) == few


def plain_identity(rows, model):
    """(language, probability, kept) of rows (text, declared, code, domain, host), by the formulas, one row at a time."""
    n, weight, names = len(model.languages), language_id.PRIOR_WEIGHT, model.languages
    logs, known = [], []
    for text, declared, code, _, _ in rows:
        row, share = model.score(text)
        for said, right in ((declared, language_id.DECLARED_RIGHT), (code, language_id.ADDRESS_RIGHT)):
            if said in names:
                row = [x + np.log(right if said == k else (1 - right) / (max(n, 2) - 1)) for x, k in zip(row, names, strict=True)]
        logs.append(np.array(row))
        known.append(share)
    own = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs]
    counted = [i for i in range(len(rows)) if known[i] > 0]
    top = (sum((own[i] for i in counted), np.zeros(n)) + weight / n) / (len(counted) + weight)
    by_domain, by_host = defaultdict(list), defaultdict(list)
    for i in counted:
        by_domain[rows[i][3]].append(i)
        by_host[rows[i][3], rows[i][4]].append(i)
    out = []
    for i, (_, _, _, domain, host) in enumerate(rows):
        prior = top
        if known[i] > 0:
            for others in ([k for k in by_domain[domain] if k != i], [k for k in by_host[domain, host] if k != i]):
                prior = (sum((own[k] for k in others), np.zeros(n)) + weight * prior) / (len(others) + weight)
        p = np.exp(logs[i] - logs[i].max()) * prior
        p /= p.sum()
        kept = known[i] >= language_id.LEAST_KNOWN
        out.append((names[int(p.argmax())] if kept else "und", float(p.max()) if kept else 0.0, kept))
    return out


@needs_data
def test_language_query_against_brute_force(spark):
    """All documents and pages, each row's evidence and priors worked out by itself."""
    docs, pages = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "pages"))
    model = language_id.fit(docs)
    of_docs = [(r["doc_id"], (r["text"], None, None, r["source"] or "", r["source"] or "")) for r in docs.collect()]
    of_pages = []
    for r in pages.collect():
        host, domain, code = language_id.address(r["url"])
        of_pages.append((r["page_id"], (language_id.page_text(r["html"]), language_id.declared_language(r["html"]), code, domain, host)))
    want = {("d", i): x for (i, _), x in zip(of_docs, plain_identity([r for _, r in of_docs], model), strict=True)}
    want |= {("p", i): x for (i, _), x in zip(of_pages, plain_identity([r for _, r in of_pages], model), strict=True)}
    got = QUERIES["op10_language_id"](spark, str(DATA)).collect()
    assert len(got) == len(want)
    for r in got:
        language, score, kept = want["d", r["doc_id"]] if r["page_id"] is None else want["p", r["page_id"]]
        assert (r["lang"], r["kept"]) == (language, kept) and abs(r["score"] - score) < 2e-6


def test_sample_is_bounded_by_rows(spark):
    """However often a row or an id is repeated."""
    rows = [(1, f"text {i % 3}", "en") for i in range(2000)] + [(i, "noch ein text", "de") for i in range(500)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert language_id.sample(labelled, rows=10, label_rows=5).count() <= 10 + 2 * 5
    assert language_id.sample(labelled.limit(0)).count() == 0


def test_pages_of_any_tags_take_seconds():
    for soup in ("<meta ", "<html ", "<script>", "<!--", "<", "<a href='", "&amp;"):
        page = soup * (1_000_000 // len(soup))
        begun = time.monotonic()
        language_id.declared_language(page)
        language_id.page_text(page)
        assert time.monotonic() - begun < 5, soup


@pytest.mark.parametrize(("url", "parts"), [("https://www.a.co.uk/en-us/x", ("www.a.co.uk", "co.uk", "en")), ("http://u:p@Fr.Site.com:80", ("fr.site.com", "site.com", "fr")), ("http://site.de/?x=/en/", ("site.de", "site.de", "de")), ("http://site.co/", ("site.co", "site.co", None)), ("http://site.com.br/x", ("site.com.br", "com.br", "pt")), ("nothing", ("", "", None)), (None, ("", "", None))])
def test_addresses(url, parts):
    assert language_id.address(url) == parts
