"""Drift, the snapshot store, pages, evaluation and settings, on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import drift, evaluate, extract, graph, store
from graphloom.sources import chunkers, parsers, settings

ENT = "id string, name string, kind string, description string, aliases array<string>, sources array<string>, kinds array<string>, source_tier double, centrality double, confidence double, def_line int, graph_commit string, seen_at timestamp_ntz"


def ents(spark, rows):
    day = datetime.datetime(2025, 1, 1)
    return graph.nodes(spark.createDataFrame([(i, i, k, None, [], s, [k], None, c, f, None, "g", day) for i, k, s, c, f in rows], ENT))


def edge_rows(spark, rows):
    return graph.edges(spark.createDataFrame([(n, s, t, k, 0.5, None, "", n) for n, (s, t, k) in enumerate(rows)], "rel_id long, source_id string, target_id string, kind string, weight double, drift double, description string, source_line int"))


# ---- drift
def test_drift_charges_the_document(spark):
    n = ents(spark, [("doc", "concept", ["d.md"], 0.0, 1.0), ("code", "class", ["x.py"], 0.0, 1.0), ("old", "concept", ["o.md", "p.md"], 0.0, 1.0), ("lost", "concept", ["none.md"], 0.0, 1.0)])
    e = edge_rows(spark, [("doc", "code", "realizes"), ("code", "old", "calls"), ("doc", "old", "calls"), ("lost", "code", "realizes")])
    log = spark.createDataFrame([("d.md", 5, 1), ("x.py", 3, 100), ("x.py", 6, 30), ("x.py", 9, 20), ("o.md", 1, 4), ("x.py", 5, 7)], "path string, ord long, changed long")
    sizes = spark.createDataFrame([("x.py", 100)], "path string, size long")
    got = {(r.claimant, r.drift) for r in drift.edge_drifts(n, e, log, sizes).collect()}
    # x.py changed by 50 after the document's commit 5, and by 157 after commit 1; an unknown file has no commit, so no drift
    assert got == {("doc", 0.5), ("old", 1.0), ("lost", 0.0)}
    f = {r.id: r for r in drift.drift_pass(n, e, log, sizes).collect()}
    assert f["doc"].drift == 0.5 and f["code"].drift == 0.0 and f["old"].confidence == 0.0 and f["lost"].drift == 0.0
    assert drift.edge_drifts(n, e.limit(0), log.limit(0), sizes).count() == 0


def test_numstat(spark):
    text = "commit ab12 200\n\n3\t1\tsrc/a.py\n-\t-\tlogo.png\n\ncommit cd34 100\n10\t0\tsrc/a.py\nnoise".split("\n")
    lines = spark.createDataFrame([("r", k, x) for k, x in enumerate(text)], "repo string, pos int, value string")
    got = {tuple(r)[1:] for r in drift.numstat(lines).collect()}
    assert got == {("src/a.py", "ab12", 200, 3, 1), ("logo.png", "ab12", 200, 0, 0), ("src/a.py", "cd34", 100, 10, 0)}


def test_changes_after_each_row(spark):
    log = spark.createDataFrame([("p", 1, 2.0), ("p", 2, 3.0), ("p", 2, 4.0), ("p", 5, 1.0), ("q", 1, 9.0), (None, 1, 1.0), ("p", 3, None)], "path string, at long, lines double")
    got = {(r.path, r.at): (r.changed, r.n_later) for r in drift.changed_after(log, "path", "at", "lines").collect()}
    assert got == {("p", 1): (8.0, 4), ("p", 2): (1.0, 2), ("p", 3): (1.0, 1)}


# ---- store
def test_state_is_loaded_with_neutral_scores(spark, tmp_path):
    doc = {"commit": "c1", "entities": [{"id": "a", "name": "A", "kind": "class", "description": ""}, {"id": "a", "name": "A2", "kind": "class", "description": "", "confidence": 0.5}], "relationships": [{"source_id": "a", "target_id": "b", "kind": "calls", "description": "first"}, {"source_id": "a", "target_id": "b", "kind": "calls", "description": "second"}, {"source_id": "a", "target_id": "b", "kind": "imports", "description": ""}], "scope_entities": {"s": ["a"]}}
    (tmp_path / "state.json").write_text(json.dumps(doc))
    t = store.load_state(spark, str(tmp_path / "state.json"))
    e = t["entities"].first()
    assert (e.name, e.confidence, e.centrality, e.aliases) == ("A2", 0.5, 0.0, []) and t["entities"].count() == 1
    assert sorted((r.kind, r.description, r.weight) for r in t["relationships"].collect()) == [("calls", "first", 0.5), ("imports", "", 0.5)]
    assert t["summaries"].count() == 0 and t["scopes"].first().id == "a" and t["commit"].first().commit == "c1"


def test_upsert_and_union(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 9, 2), ("c", 4, 1)], "id string, v int, pos int")
    got = store.upsert(old.withColumn("pos", F.lit(0)), new, ["id"], "pos")
    assert sorted((r.id, r.v) for r in got.collect()) == [("a", 1), ("b", 3), ("c", 4)]
    both = store.unite({"p": old, "q": spark.createDataFrame([("b", 7)], "id string, v int")})
    assert sorted((r.id, r.v, r.project) for r in both.collect()) == [("a", 1, "p"), ("b", 7, "q")]
    assert store.lookup(old, "id", ["a", "z"]).count() == 1


def test_orders_labels_and_projects(spark):
    n = ents(spark, [("a", "class", ["p/x/a.py"], 1.0, 0.5), ("b", "class", ["p/x/b.py"], 0.0, 0.9), ("c", "concept", ["q/c.md"], 0.0, 1.0), ("d", "class", ["q/d.py"], 0.0, 1.0), ("e", "class", [], 0.0, 1.0)])
    e = edge_rows(spark, [("a", "b", "calls"), ("a", "c", "realizes"), ("a", "d", "calls"), ("b", "zz", "calls")])
    assert [(r.id, r.place) for r in store.scope_order(n).filter("scope = 'p/x'").orderBy("place").collect()] == [("a", 1), ("b", 2)]
    declared = spark.createDataFrame([("Pee", "p"), ("Ex", "p/x"), ("Queue", "qq")], "label string, prefix string")
    assert {r.id: r.project for r in store.labels(n, declared).collect()} == {"a": "Ex", "b": "Ex", "c": None, "d": None, "e": None}
    keep, inner = store.project_part(n, e, "p")
    assert sorted(r.id for r in keep.collect()) == ["a", "b", "c"] and sorted((r.source_id, r.target_id) for r in inner.collect()) == [("a", "b"), ("a", "c")]
    assert {(r.target, r.cross_repo) for r in store.export_edges(n, e).collect()} == {("b", False), ("c", True), ("d", True)}
    doc = store.export_document(n, e, graph.file_nodes(n), "c1").collect()
    head = json.loads(next(r.json for r in doc if r.part == "head"))
    assert head == {"schema_version": 3, "graph_commit": "c1", "projects": ["p", "q"]}
    assert {k: sum(r.part == k for r in doc) for k in ("node", "edge", "file")} == {"node": 5, "edge": 3, "file": 4}
    s = {(r.section, r.other): r.place for r in store.edge_sections(n, e).filter("scope = 'p/x'").collect()}
    assert s == {("depends-on", "q"): 1}
    live, stale = store.split_stale(spark.createDataFrame([("stale-claim",), ("calls",), (None,)], "kind string"))
    assert live.count() == 2 and stale.count() == 1


HEAD = "<!-- graph_commit: abc | source_tree_hash: def | materialized_at: 2025-01-01T00:00:00Z -->"


def test_pages(spark, tmp_path):
    body = "x" * 30 + "\n\n" + "y" * 30
    one = spark.createDataFrame([(HEAD + "\n\n" + body,), (body,), ("z" * 60,), ("",), (None,)], "t string")
    assert [r.p for r in one.select(store.overview(F.col("t"), 10).alias("p")).collect()] == ["x" * 30, "x" * 30, "z" * 40, "", None]
    pages = spark.createDataFrame([("a", HEAD + "\nq"), ("b", HEAD.replace("def", "eee")), ("c", HEAD.replace("abc", "bbb")), ("d", "no header")], "scope string, text string")
    trees = spark.createDataFrame([(s, "def") for s in "abcde"], "scope string, tree_hash string")
    got = {r.scope: (r.fresh, r.ingest, r.render) for r in store.freshness(pages, "abc", trees).collect()}
    assert got == {"a": (True, False, False), "b": (False, True, True), "c": (False, False, True), "d": (False, True, True), "e": (False, True, True)}
    r = spark.createDataFrame([("h", "m", None, "gap"), ("h", None, "ref", "gap"), ("h", "m", None, None)], "h string, m string, r string, g string")
    assert [x.p for x in r.select(store.agents_page(F.col("h"), F.col("m"), F.col("r"), F.col("g")).alias("p")).collect()] == ["h\n\nm\n\ngap\n", "h\n\n\n\nref\n", "h\n\nm\n"]
    m = spark.createDataFrame([("page \n\n", ["k", None], ["one", "two"]), ("page\n", [], [])], "p string, l array<string>, c array<string>")
    assert [x.p for x in m.select(store.merge_pinned(F.col("p"), F.col("l"), F.col("c")).alias("p")).collect()] == ["page\n\n<!-- pinned:k -->\none\n<!-- /pinned -->\n\n<!-- pinned -->\ntwo\n<!-- /pinned -->\n", "page\n"]
    w = spark.createDataFrame([("s/AGENTS.md", "text"), ("AGENTS.md", "é")], "path string, text string")
    assert {x.written for x in store.write_if_changed(w, str(tmp_path)).collect()} == {True}
    assert {x.written for x in store.write_if_changed(w, str(tmp_path)).collect()} == {False}
    assert (tmp_path / "AGENTS.md").read_text() == "é" and not list(tmp_path.rglob("*.part"))


# ---- evaluation
def test_measures(spark):
    kw = spark.createDataFrame([("q", "a"), ("q", "b")], "concept string, id string")
    st = spark.createDataFrame([("q", "b"), ("q", "c")], "concept string, id string")
    assert {(r.id, r.signal) for r in evaluate.recall_sets(kw, st, ["concept", "id"]).collect()} == {("b", "both"), ("c", "structural"), ("a", "keyword")}
    assert [r.id for r in evaluate.recall_sets(kw, st, ["concept", "id"], 2).orderBy("priority").collect()] == ["b", "c"]
    hits = spark.createDataFrame([("q", "off", 4, True), ("q", "off", 2, False), ("q", "on", 1, True), ("r", "on", 3, False)], "question string, arm string, rank int, gold boolean")
    assert {r.question: (r.off, r.on, r.delta) for r in evaluate.rank_delta(hits).collect()} == {"q": (4, 1, 3), "r": (None, None, None)}
    a = spark.createDataFrame([("q", ["x", "y"], ["x", "z"], ["x"]), ("r", [], [], [])], "question string, gold array<string>, cited array<string>, known array<string>")
    assert {r.question: (r.recall, r.precision, r.grounding) for r in evaluate.answer_scores(a).collect()} == {"q": (0.5, 0.5, 0.5), "r": (None, None, None)}
    calls = spark.createDataFrame([("m", 1000, 500, True), ("m", 1000, 500, False), ("o", 1, 1, False)], "model string, input_tokens long, output_tokens long, cached boolean")
    rates = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_rate double, output_rate double")
    assert {r.model: (r.cache_hit_rate, r.cost) for r in evaluate.cost(calls, rates).collect()} == {"m": (0.5, 0.008), "o": (0.0, None)}
    p = spark.createDataFrame([(k, 1.0 + k % 3, float(k % 3)) for k in range(60)], "q int, a double, b double")
    b = evaluate.paired_bootstrap(spark, p, 200).first()
    assert b.n == 60 and b.mean == b.low == b.high == 1.0
    p = spark.createDataFrame([(k, float(k % 2), 0.0) for k in range(100)], "q int, a double, b double")
    b = evaluate.paired_bootstrap(spark, p, 400).first()
    assert 0.3 < b.low < 0.47 and 0.53 < b.high < 0.7 and b.mean == 0.5


def test_texts_of_answers(spark):
    f = spark.createDataFrame([("p", "a\nthe Key\nb\nc\nd key\n")], "path string, text string")
    assert [(r.line_no, r.line) for r in evaluate.evidence(f, ["key"]).orderBy("line_no").collect()] == [(1, "a"), (2, "the Key"), (3, "b"), (4, "c"), (5, "d key"), (6, "")]
    t = spark.createDataFrame([(1, "intro\n## Q1. First thing\nbody a\n## Q2: Second\nbody b\n## Scorecard\n## Q3 no\n"), (2, None)], "id int, text string")
    assert sorted((r.question, r.title, r.body) for r in evaluate.answer_sections(t).collect()) == [("Q1", "First thing", "body a"), ("Q2", "Second", "body b")]
    x = spark.createDataFrame([("see src/a.py and b.md, src/a.py.",)], "t string").select(evaluate.paths_in(F.col("t")).alias("p")).first()
    assert x.p == ["src/a.py", "b.md"]
    lines = spark.createDataFrame([("It perhaps works",), ("It works",), (None,)], "line string")
    assert evaluate.unhedged(lines).count() == 2
    d = evaluate.relative_paths(spark.createDataFrame([("in /r/src/a.py here",)], "description string"), "/r").first()
    assert d.description == "in src/a.py here"
    v = spark.createDataFrame([("d", k, x) for k, x in enumerate(["# T", "- one: a", "**two** b", "- three: c"])], "doc string, pos int, line string")
    assert [r.line for r in evaluate.vocabulary_block(v, 20).orderBy("pos").collect()] == ["- one: a", "**two** b"]


# ---- settings
def test_settings():
    c = settings.read_config('root = "${HOME}/x"\nport = "${PORT:-80}"\n[[projects]]\nname = "a-1"\npath = "src"\n', {"HOME": "/h"})
    assert c["root"] == "/h/x" and c["port"] == "80"
    for bad in ([{"name": "a", "path": "/abs"}], [{"name": "", "path": "x"}], [{"name": "a", "path": "../x"}], [{"name": "a", "path": "x"}, {"name": "a", "path": "y"}]):
        with pytest.raises(ValueError):
            settings.checked_projects(bad)
    with pytest.raises(ValueError):
        settings.expand("${NONE}", {})
    k = settings.knobs({"authority_tiers": {"adr": 0.7}, "edge_weights": {"governed-by": 0.1}, "roles": {"docs/*": "adr"}, "expansion_max": 3}, {"CK_SCORING_EXPANSION_MAX": "9", "CK_SCORING_EDGE_WEIGHT_CALLS": "0.25", "CK_SCORING_AUTHORITY_DEFAULT": "0.4", "CK_SCORING_EXPANSION": "off", "OTHER": "1"})
    assert (k.tiers["ADR"], k.weights["governed-by"], k.weights["calls"], k.expansion_max, k.tier_default, k.expansion, k.roles) == (0.7, 0.1, 0.25, 9, 0.4, False, {"docs/*": "ADR"})
    with pytest.raises(ValueError):
        settings.knobs({"roles": {"x": "nope"}})
    kinds, warnings = settings.read_vocabulary(["nodes:\n- kind: risk\n  family: a\n", "nodes:\n- kind: risk\n  family: b\nedges:\n- kind: calls\n", ": [", "- just a list"])
    assert kinds["nodes:risk"]["family"] == "b" and "edges:calls" in kinds and len(warnings) == 2


def test_whole_rows_and_page_rank(spark):
    at = lambda k: datetime.datetime(2025, 1, k)
    rows = [("a", "late", "x", "z", [], ["b.md"], [], 1.0, 0.1, 0.1, 1, "g", at(9)), ("a", "soon", "y", "d", [], ["c.md"], [], 2.0, 0.2, 0.2, 2, "g", at(2)), ("sha256:A", "none", "w", "a", [], ["a.md"], [], 0.0, 0.0, 0.0, 0, "g", None)]
    r = graph.nodes(spark.createDataFrame(rows, ENT)).collect()
    assert len(r) == 1 and (r[0].name, r[0].kind, r[0].sources) == ("soon", "y", ["c.md"])
    n = ents(spark, [(x, "class", ["p.py"], 0.0, 1.0) for x in "abcd"])
    e = edge_rows(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "a", "calls")])
    rank = {x: 1.0 for x in "abcd"}
    for _ in range(200):
        rank = {"a": 0.15 + 0.85 * (rank["c"] + rank["d"]), "b": 0.15 + 0.85 * rank["a"], "c": 0.15 + 0.85 * rank["b"], "d": 0.15}
    got = {x.id: x.rank for x in graph.pagerank(n, e, tolerance=1e-2).collect()}
    assert all(abs(got[x] - rank[x] / max(rank.values())) < 0.03 for x in "abcd")
    with pytest.raises(ValueError):
        graph.pagerank(n, e, tolerance=1e-9, most=2)


def test_long_chains_have_depths(spark):
    n = ents(spark, [(f"n{k}", "class", [], 0.0, 1.0) for k in range(36)] + [("x", "class", [], 0.0, 1.0), ("y", "class", [], 0.0, 1.0)])
    e = edge_rows(spark, [(f"n{k}", f"n{k + 1}", "contains") for k in range(35)] + [("x", "y", "contains"), ("y", "x", "contains")])
    got = {r.id: r.depth for r in graph.depths(n, e).collect()}
    assert got == {f"n{k}": k for k in range(36)}


def test_scopes_as_callers_write_them():
    for scope in (None, "", ".", "/data/port", "/data/port/", "port", "./"):
        assert S.target_scope(scope, "/data/port") is None
    assert S.target_scope("/data/port/a/b", "/data/port") == S.target_scope("a/b/", "/data/port") == S.target_scope("./a/b", "/data/port") == "a/b"
    assert S.target_scope("/elsewhere/a", "/data/port") == "elsewhere/a"


def test_vocabularies_docstrings_and_plain_text(spark):
    f = spark.createDataFrame([("p/ontology.yaml", "a: 1\nb:\n  c: 2\n"), ("p/x.yaml", "b:\n  c: 2\n")], "path string, text string")
    assert {r.source_file for r in parsers.extract(f).collect()} == {"p/x.yaml"}
    code = 'def f():\n    """retry it\n    retry again\n    """\n    retry(1)\n    x = """retry"""\n    # retry\n    retry(2)\n'
    got = extract.evidence(spark.createDataFrame([("p.py", code)], "path string, text string"), ["retry"]).orderBy("line").collect()
    assert [r.line for r in got] == [5, 6, 8]
    d = spark.createDataFrame([(1, "one  \r\n\r\n\r\n\r\ntwo"), (2, None)], "doc_id long, text string")
    assert [r.chunk for r in chunkers.chunk(d, "doc_id", "text", "text").collect()] == ["one\n\ntwo"]


def test_density(spark):
    n = ents(spark, [("a", "class", ["p/a.py"], 0.0, 1.0), ("b", "class", ["p/b.py"], 0.0, 1.0), ("c", "class", ["q/c.py"], 0.0, 1.0)])
    r = graph.scope_density(n, edge_rows(spark, [("a", "b", "calls"), ("a", "c", "calls")])).first()
    assert (r.n_edges, r.n_cross, r.density) == (2, 1, 0.5)
    assert graph.scope_density(n, edge_rows(spark, [("a", "b", "calls")]).limit(0)).first().density is None
