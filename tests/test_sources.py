"""Source trees, replies, budgets and vocabularies."""

import json
import os

import numpy as np

from graphloom.operators import extract
from graphloom.sources import files


def test_walk_read_and_hash(spark, tmp_path):
    for p, t in (("a/__init__.py", "x"), ("a-b.py", "y"), (".git/c", "z"), ("node_modules/d.js", "z"), ("AGENTS.md", "z"), ("a/b.py", "é")):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(t)
    w = files.walk(spark, str(tmp_path))
    assert sorted(r.path for r in w.collect()) == ["a-b.py", "a/__init__.py", "a/b.py"]
    f = files.read(w, str(tmp_path))
    assert {r.path: r.text for r in f.collect()}["a/b.py"] == "é"
    assert sorted(r.scope for r in files.scopes(w).collect()) == [".", "a"]
    h = files.tree_hash(f).first().tree_hash
    (tmp_path / "a/b.py").write_text("changed")
    assert files.tree_hash(files.read(w, str(tmp_path))).first().tree_hash != h
    assert files.tree_hash(f.limit(0)).first().tree_hash == "2e1cfa82b035c26cbbbdae632cea070514eb8b773f616aaeaf668e2f0be8f10d"


def test_vectors_and_caches(spark):
    v = np.array([1.5, -2.0], dtype=np.float32).tobytes()
    df = spark.createDataFrame([(1, bytearray(v)), (2, None), (3, bytearray(b"abc"))], "i int, raw binary")
    assert {r.i: r.v for r in files.unpack_vectors(df, "raw", "v").collect()} == {1: [1.5, -2.0], 2: [], 3: []}
    want = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "key string, text string")
    have = spark.createDataFrame([("a", "r")], "key string, reply string")
    assert [(r.key, r.text) for r in files.cache_misses(want, have).collect()] == [("b", "y")]


def test_transcripts(spark, tmp_path):
    rows = [{"session": "s", "type": "a", "usage": {"input_tokens": 3, "output_tokens": 4}, "content": "hi"}, {"session": "s", "type": "a", "content": [{"t": 1}], "tools": [{"name": "read", "input": "x"}, {"name": "read", "input": "x", "error": True}]}]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, rows), "no json"]))
    r = files.transcript_costs(spark, str(tmp_path / "t.jsonl")).first()
    assert (r.n_turns, r.tokens, r.n_tools, r.n_failed, r.n_repeated) == (2, 7, 2, 1, 1)


def test_snapshots_and_journal(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "id string")
    for _ in range(2):
        files.write_snapshot(df, str(tmp_path / "t"), "c1")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    files.append_journal(spark, str(tmp_path / "j"), "ingest", ["--all"], 5, 0, "0123456789")
    assert spark.read.json(str(tmp_path / "j")).first().graph_commit == "01234567"


def test_replies_and_budgets(spark):
    d = spark.createDataFrame([(1, '```json\n{"entities": [{"name": "A", "kind": "Class"}, {"kind": "x"}], "relationships": [{"source": "A", "target": "B", "kind": "CALLS"}, {"source": "A", "kind": "k"}]}\n```'), (2, "sorry"), (3, None)], "id int, text string")
    e, r = extract.parse_replies(d, "id", "text")
    assert [(x.name, x.kind) for x in e.collect()] == [("A", "class")] and [(x.target, x.kind) for x in r.collect()] == [("B", "calls")]
    rows = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "bbbb"), ("g", 3, "c"), ("h", 1, "x" * 50)], "g string, n int, t string")
    assert [(x.g, x.n) for x in extract.budgeted(rows, "g", ["n"], "t", 9).collect()] == [("g", 1)]
    f = spark.createDataFrame([("p", "# retry()\nretry()\nx\nretry()\nretry(2)")], "path string, text string")
    assert sorted((x.line, x.snippet) for x in extract.evidence(f, [r"retry\("]).collect()) == [(2, "retry()"), (5, "retry(2)")]


def test_vocabularies(spark):
    s = "kind string, family string, definition string"
    got = extract.compose_vocabulary(spark.createDataFrame([("class", "structural", "b"), ("risk", "semantic", "b")], s), spark.createDataFrame([("risk", "semantic", "p"), ("wish", "semantic", "p"), ("type", "structural", "p")], s), spark.createDataFrame([("wish", "semantic", "j")], s)).collect()
    assert {(r.kind, r.definition) for r in got} == {("class", "b"), ("risk", "b"), ("wish", "p")}
    c = "namespace string, key string, label string"
    assert [r.label for r in extract.compose_concepts([spark.createDataFrame([("n", "k", "old")], c), spark.createDataFrame([("n", "k", "new")], c)]).collect()] == ["new"]
    assert {(r.scope, r.n) for r in extract.rollup_ancestors(spark.createDataFrame([("a/b",), ("a",)], "s string"), "s").collect()} == {("a", 2), ("a/b", 1)}
    v = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, v double")
    assert sorted(r.id for r in extract.hotspots(v, "v").collect()) == [18, 19]
