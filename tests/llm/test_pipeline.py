import hashlib
import os
import shutil
import struct
import subprocess
import sys
from itertools import combinations
from pathlib import Path

import pytest

import corpus_pipeline
from brute import groups, plain_contamination, plain_dedup, plain_shingles, plain_windows
from vecpack.llm import common, decontaminate
from vecpack.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each, which is written and read again."""
    if not DATA.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], str(DATA)).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_schemas(stages):
    assert all(s.schema.names == stages[0].schema.names for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_against_their_operators(spark, stages):
    before, lang, lines, near, clean, last = [{r["doc_id"]: r for r in s.collect()} for s in stages]
    assert lang.keys() == before.keys() and all(lang[i]["text"] == before[i]["text"] for i in lang)
    assert {i: r["text"] for i, r in lines.items()} == plain_dedup([(i, r["text"]) for i, r in lang.items()], 50)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    sets = {i: plain_shingles(r["text"]) for i, r in lines.items()}  # five words and 0.8, not op4's three words and two bits
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert near.keys() == {i for i, g in groups(sets, links).items() if i == g}
    windows = plain_windows([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert clean.keys() == {i for i, r in near.items() if not plain_contamination(r["text"], windows)[-1]}
    assert last.keys() == clean.keys()
    for i, r in last.items():
        assert r["decoded_sha256"] == hashlib.sha256(clean[i]["text"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(r['ids'])}I", *r["ids"])).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_run_is_all_stages(spark, stages):
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    assert got == {r["doc_id"]: r["ids_sha256"] for r in stages[-1].collect()}


def test_stages_that_shuffle_keep_the_same(spark, stages, monkeypatch):
    """Beyond the bound of broadcasts each stage keeps what it keeps below it."""
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_TERMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            again = stage(spark, stages[i], str(DATA)).select(stages[i + 1].columns)
            assert sorted(map(repr, again.collect())) == sorted(map(repr, stages[i + 1].collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_awkward_documents(spark, tmp_path):
    """Nulls, repeated ids and rows: every stage takes what the one before it gives."""
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "the cat and the dog with that other thing "
    rows = [(1, text * 3, "en", "s", 1), (1, text * 3, "en", "s", 1), (1, text * 4, "en", "s", 1), (None, text, "en", "s", None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "x", "en", "s", 1), (5, text + "\n" + text * 2, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (len(rows), 0):
        left = docs.limit(n)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{n}-{i}-{name}")
            stage(spark, left, str(tmp_path)).write.parquet(path)
            left = spark.read.parquet(path)
        assert (left.count() > 0) == (n > 0)


def test_one_of_each_group_stays(spark):
    """Also of groups without ids, of rows that share an id, and of repeated rows."""
    rows = [(1, "a b c"), (1, "a b c"), (1, "A B C"), (1, "other words here"), (None, "x y z"), (None, "x y z"), (None, "p q r"), (2, "p q r"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, "a b c"), (1, "other words here"), (None, "x y z"), (2, "p q r"), (3, "")], key=repr)


def test_columns_of_any_name_pass_unchanged(spark, tmp_path):
    """Through all stages but the last, also where the operators use such names within."""
    names = ["tag", "doc_key", "cut_runs", "cut_key", "k0", "k1", "k2", "copy", "lid_text", "lid_lang", "lid_kept", "lid_known", "n_lines", "n_removed", "node", "first", "times", "gone_id", "bad_tag", "new_lang", "id", "place", "label", "fp", "words"]
    spark.createDataFrame([(1, "the very passage of a test")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "the cat and the dog with that other thing number {} and more of the same"
    rows = [(i, text.format(i) * (1 + i % 3), "en", "s", 1, *[f"{n}-{i}" for n in names]) for i in range(12)] + [(50, None, None, None, None, *[None] * len(names)), (51, text.format(1) * 2, "de", "s", 1, *["x"] * len(names))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    given = {r["doc_id"]: r for r in docs.collect()}
    left = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / f"{i}-{name}")
        stage(spark, left, str(tmp_path)).write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == docs.columns
        kept = left.collect()
        assert kept and all(r[n] == given[r["doc_id"]][n] for r in kept for n in names)


def test_labels_are_told_by_the_text(spark):
    """A wrong label changes, a right one doesn't; rows without letters go, the rest stay."""
    texts = {"en": "the cat and the dog with that other thing", "de": "der hund und die katze mit einem anderen ding"}
    rows = [(i, f"{t} {i}", k, "s", 1) for i in range(40) for k, t in texts.items()] + [(100, texts["de"], "en", "s", 1), (101, texts["de"], None, None, 1), (102, "12 34", "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["lang"]) for r in corpus_pipeline.identify_language(spark, docs, "").collect())
    assert got == sorted([(i, k) for i in range(40) for k in texts] + [(100, "de"), (101, "de")])


def test_entry_without_the_folders(tmp_path):
    """The library's own queries are there when the folders have gone, also where caches of them were left behind."""
    root = Path(corpus_pipeline.__file__).parent
    for name in ("__spark_entry__.py", "vecpack"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    for p in (tmp_path / "vecpack/llm").glob("*.py"):
        p.unlink()
    (tmp_path / "vecpack/llm/__pycache__").mkdir(exist_ok=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[-2]) >= 46


def test_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
