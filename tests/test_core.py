"""Scalar functions, graph, retrieval, resolution, views, orphans, and the registered queries against their SQL."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.functions import scalars as S
from graphloom.operators import graph, orphans, resolve, retrieval, views
from graphloom.plans import catalog
from graphloom.runtime import salted_join

DATA = "/root/testdata/sf0.001"


def value(spark, column, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name,key", [("Turn Panel", "turnpanel"), ("turn_panel", "turnpanel"), ("The Panel", "panel"), ("Anthem", "anthem"), ("été", "t"), ("日本", ""), ("a.b", "b")])
def test_name_key(spark, name, key):
    assert value(spark, S.normalize_name(F.col("x")), x=name) == key


@pytest.mark.parametrize(
    "path,tier",
    [("a/THEORY.md", "THEORY"), ("x/architecture.md", "ARCHITECTURE"), ("docs/adr/x.py", "ADR"), ("p/0007-why.md", "ADR"), ("p/a.py", "CODE"), ("p/ontology.yaml", "CONTEXT"), ("p/x.tf", "OPS"), ("CONTEXT.md", "CONTEXT"), ("p/preferences.md", "REFERENCE"), ("p/plan.md", "SPEC"), ("README.md", "EPHEMERAL"), ("p/other.md", "")],
)
def test_tiers(spark, path, tier):
    assert value(spark, S.classify_source(F.col("x")), x=path) == tier


def test_scores(spark):
    assert value(spark, S.edge_drift(F.col("a"), F.col("b")), a=200, b=400) == 0.5
    assert value(spark, S.edge_drift(F.col("a"), F.col("b")), a=500, b=400) == 1
    assert value(spark, S.edge_drift(F.col("a"), F.col("b")), a=100, b=0) == 0
    assert value(spark, S.edge_weight(F.col("k")), k="realizes") == 0.9 and value(spark, S.edge_weight(F.col("k")), k="odd") == 0.5
    df = spark.createDataFrame([(["a.py", "docs/adr/1.md"],), ([],), (["HANDOFF.md"],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(S.authority(F.col("s"))).collect()] == [0.9, 0.3, 0.2, 0.3]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, 0, 0]


def test_text_functions(spark):
    assert value(spark, S.normalize_text(F.col("x")), x="a  \r\nb\n\n\n\nc") == "a\nb\n\nc"
    assert value(spark, S.first_sentence(F.col("x")), x="# One. Two.\nThree. ") == "One."
    assert value(spark, S.first_sentence(F.col("x")), x="x" * 300) == "x" * 200 + "..."
    assert value(spark, S.scope_of(F.col("x")), x="a/b/c.py") == "a/b" and value(spark, S.scope_of(F.col("x")), x="c.py") == "."
    assert value(spark, S.candidate_bare(F.col("x")), x="Name (class, a.py)") == "Name" and value(spark, S.candidate_bare(F.col("x")), x="a/b.py:Sym") == "Sym" and value(spark, S.candidate_bare(F.col("x")), x="a.py:12") == "a.py:12"
    h = S.freshness_header(F.lit("ab12"), F.lit("cd34"), F.lit("2025-01-02 03:04:05").cast("timestamp"))
    assert value(spark, S.parse_freshness(h)).graph_commit == "ab12" and value(spark, S.parse_freshness(F.lit("graph_commit: initial"))) is None


ENT = "id string, name string, kind string, description string, aliases array<string>, sources array<string>, kinds array<string>, source_tier double, centrality double, confidence double, def_line int, graph_commit string, seen_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
REL = "rel_id long, source_id string, target_id string, kind string, description string, weight double, drift double, source_line int, seen_at timestamp_ntz, extra string"


def ents(spark, rows):
    return spark.createDataFrame([(i, n, k, None, a or [], s or [], [k], None, None, c, None, "g", seen, gone, "x") for i, n, k, a, s, c, seen, gone in rows], ENT)


def rels(spark, rows):
    return spark.createDataFrame([(i, s, t, k, None, 0.5, d, None, at, "x") for i, s, t, k, d, at in rows], REL)


def day(k):
    import datetime

    return datetime.datetime(2025, 1, k)


def test_orphans_by_reason(spark):
    e = ents(spark, [("A", "alpha", "class", None, ["p/alpha.py"], 1.0, day(5), None), ("A", "alpha", "class", None, ["p/alpha.py"], 1.0, day(9), None), ("b", "The Beta", "class", ["b-two"], ["./p/b.py"], 1.0, day(1), day(8))])
    c = spark.createDataFrame([("hub", "x")], "node_id string, extra string")
    r = rels(spark, [(1, " sha256:a", "hub", "k", 0.1, day(6)), (2, "a", "B", "k", 0.1, day(4)), (3, "b", "nobody", "k", None, day(8)), (4, None, "", "k", None, None), (4, None, "", "k", None, None)])
    raw = spark.createDataFrame([(1, "alpha", day(2)), (2, " ./p/alpha.py:12-30 ", day(2)), (3, "x.y.beta", day(2)), (4, "pkg.b_two.other", day(2)), (5, "gamma", day(3)), (6, None, day(3)), (7, "", day(3)), (5, "gamma", day(3)), (8, "p/alpha.pyx", day(3))], "raw_id long, target_name string, seen_at timestamp_ntz")
    got = {(x.table_name, x.row_id, x.field): x.reason for x in orphans.graph_orphans(r, raw, e, c).collect()}
    assert got == {
        ("relationships", 2, "source_id"): "late", ("relationships", 3, "source_id"): "deleted", ("relationships", 3, "target_id"): "missing", ("relationships", 4, "target_id"): "missing",
        ("raw_relationships", 5, "target_name"): "missing", ("raw_relationships", 7, "target_name"): "missing", ("raw_relationships", 8, "target_name"): "missing",
    }
    report = orphans.orphan_report(orphans.graph_orphans(r, raw, e, c)).collect()
    assert sum(x.n_refs for x in report) == len(got)
    assert orphans.graph_orphans(r.limit(0), raw.limit(0), e, c).count() == 0
    assert orphans.graph_orphans(r, raw, e.limit(0), c.limit(0)).count() == 7 + 7


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 1), (None, 2)], "k string, i int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c")], "k string, v string")
    got = salted_join(left, right, "k", "left", hot_rows=10).collect()
    assert len(got) == 102 and sum(r.v == "h" for r in got) == 100 and sum(r.v is None for r in got) == 1


def test_graph_scores(spark):
    e = ents(spark, [(i, i, "class", None, s, 1.0, None, None) for i, s in (("t", ["a.py"]), ("u", ["u.py"]), ("d1", ["x.md"]), ("d2", ["y.md"]), ("d3", ["x.md"]), ("none", []))])
    r = rels(spark, [(1, "d1", "t", "realizes", 0.9, None), (2, "d2", "t", "implements", 0.3, None), (3, "d3", "t", "realizes", 0.0, None), (4, "d1", "u", "realizes", 0.5, None), (5, "d1", "d2", "imports", None, None), (6, "t", "t", "realizes", 1.0, None), (7, "d1", "t", "realizes", 0.1, None), (8, None, "t", "realizes", 0.1, None), (9, "none", "u", "realizes", 0.2, None)])
    n, ed = graph.nodes(e), graph.edges(r)
    assert ed.count() == 6
    c = {x.id: x.centrality for x in graph.centrality(n, ed).collect()}
    assert c["t"] == 1 and c["u"] == 0.5 and c["d2"] == 0
    f = {x.id: x for x in graph.confidence(n, ed).collect()}
    assert f["d1"].drift == pytest.approx((0.9 * 0.9 + 0.9 * 0.5) / 1.8) and f["d2"].confidence == pytest.approx(0.3 * 0.7) and f["none"].authority == 0.3
    assert graph.edges(r.limit(0)).count() == 0


def test_retrieval(spark):
    ch = spark.createDataFrame([("a", [1.0, 0.0], "s"), ("b", [0.9, 0.1], "s/x"), ("c", [0.0, 1.0], "t"), ("c", [0.0, 1.0], "t"), ("z", None, "s")], "id string, embedding array<float>, scope string")
    hits = retrieval.search(ch, [1.0, 0.0], 3)
    assert [r.id for r in hits.orderBy("rank").collect()] == ["a", "b", "c"]
    assert {r.id for r in retrieval.search(ch, [1.0, 0.0], 3, "s").collect()} == {"a", "b", "z"}
    both = retrieval.with_fallback(retrieval.search(ch, [1.0, 0.0], 3, "nowhere"), hits).collect()
    assert len(both) == 3 and all(r.fallback for r in both)
    n = ents(spark, [("a", "a", "class", None, [], 0.2, None, None), ("b", "b", "class", None, [], 0.9, None, None), ("n", "n", "class", None, [], 1.0, None, None)])
    adj = graph.adjacency(graph.edges(rels(spark, [(1, "a", "b", "realizes", None, None), (2, "b", "n", "governed-by", None, None)])))
    ranked = retrieval.rerank(hits, graph.nodes(n), adj)
    got = {r.id: r for r in ranked.collect()}
    assert got["a"].proximity == pytest.approx(1.9) and got["a"].find_score == pytest.approx(0.2 * 1.9) and got["c"].proximity == 1
    more = retrieval.expand(ranked, graph.nodes(n), adj).filter("NOT direct").collect()
    assert [r.id for r in more] == ["n"] and more[0].find_score == pytest.approx(got["b"].find_score * 0.95 * 0.6)
    t = spark.createDataFrame([(1, "x" * 50, "p"), (2, "y" * 50, "q")], "rank int, t string, p string")
    assert "y" not in retrieval.assemble(t, ["rank"], "t", "p", 20).first().answer


def test_resolution(spark):
    s = "ent_id long, name string, kind string, source_file string, description string, def_line int"
    code = spark.createDataFrame([(1, "Panel", "class", "a/x.py", "short", 3), (2, "x", "module", "a/x.py", None, 0), (3, "Twice", "class", "a/x.py", None, 9), (4, "Twice", "class", "b/y.py", None, 1), (5, "Panel.draw", "function", "a/x.py", None, 5), (6, "main", "function", "a/x.py", None, 7)], s)
    doc = spark.createDataFrame([(7, "the panel", "component", "R.md", "a much longer description", None), (8, "Twice", "component", "R.md", None, None), (9, "Only Doc", "risk", "R.md", None, None)], s)
    m = resolve.members(resolve.raw_entities(code, doc))
    found = resolve.canonical(m)
    nodes = {(r.key, r.is_code): r for r in found.collect()}
    assert nodes["panel", True].n_members == 2 and nodes["panel", True].description == "short" and nodes["twice", False].n_members == 1
    assert found.filter("key = 'twice'").count() == 3
    known = resolve.lookups(m, found)
    refs = spark.createDataFrame([(r, "c/z.py") for r in ("a/x.py:Panel", "x.py", "Panel", "twice", "draw", "Only Doc", "lib.Panel", "nothing", "a/x.py:12", "...", "a/x.py/", "main", None)], "ref string, source_file string")
    got = {r.ref: (r.step, r.id is not None) for r in resolve.resolve_endpoints(refs, known).collect()}
    assert got == {"a/x.py:Panel": ("symbol", True), "x.py": ("path", True), "Panel": ("code", True), "twice": ("ambiguous", False), "draw": ("leaf", True), "Only Doc": ("doc", True), "lib.Panel": ("dotted", True), "nothing": ("none", False), "a/x.py:12": ("file", True), "...": ("none", False), "a/x.py/": ("path", True), "main": ("none", False)}
    ph = spark.createDataFrame([(p,) for p in ("Twice", "src/tools", "asyncio.run_it", "some words about it", "a/x.py", "gone", "Panel (class, a/x.py)")], "phrase string")
    assert {r.phrase: r.bucket for r in resolve.drop_buckets(ph, m, found).collect()} == {"Twice": "ambiguous", "src/tools": "directory", "asyncio.run_it": "external", "some words about it": "prose", "a/x.py": "recoverable", "gone": "no_referent", "Panel (class, a/x.py)": "recoverable"}
    rel = "raw_id long, source_name string, target_name string, kind string, source_file string, description string, source_line int"
    rows = [(1, "x", "Panel", "contains", "a/x.py", "d", 3), (1, "x", "Panel", "contains", "a/x.py", "d", 3), (2, "x", "Panel", "contains", "a/x.py", "later", 9), (3, "Panel", "Panel", "calls", "a/x.py", None, None), (4, "Panel", "nothing", "calls", "a/x.py", None, None), (5, None, "Panel", "calls", "a/x.py", None, None), (6, "Only Doc", "Panel", "realizes", "R.md", None, None)]
    e, ends = resolve.resolve_edges(spark.createDataFrame(rows, rel), known)
    assert sorted((r.kind, r.source_line) for r in e.collect()) == [("contains", 3), ("realizes", None)]
    s1 = resolve.resolver_stats(found, m, e, ends).first()
    assert (s1.raw_relationships, s1.resolved_edges, s1.dropped_edges, s1.ambiguous_names, s1.code_and_doc_nodes) == (6, 2, 3, 1, 1)
    assert resolve.canonical(resolve.members(resolve.raw_entities(code.limit(0), doc.limit(0)))).count() == 0


def test_collision_guard(spark):
    s = "ent_id long, name string, kind string, source_file string, description string, def_line int, embedding array<double>"
    code = spark.createDataFrame([(1, "Root", "class", "a.py", "", 1, [1.0, 0.0]), (2, "root", "class", "b.py", "", 1, [0.0, 1.0]), (3, "root", "function", "b.py", "", 7, [0.5, 0.5])], s)
    doc = spark.createDataFrame([(4, "Root", "component", "R.md", "near", None, [0.9, 0.1]), (5, "the root", "component", "S.md", "between", None, [0.7, 0.7]), (6, "Root", "component", "T.md", "no vector", None, None), (7, "Root", "component", "U.md", "odd", None, [1.0])], s)
    m = resolve.members(resolve.raw_entities(code, doc))
    got = {r.id: r for r in resolve.canonical(m).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(got) == {sha("|code|Root|a.py"), sha("|code|root|b.py"), sha("|concept|root")}
    assert got[sha("|code|Root|a.py")].sources == ["R.md", "a.py"] and got[sha("|concept|root")].n_members == 3 and got[sha("|concept|root")].name == "the root"
    assert got[sha("|code|root|b.py")].kinds == ["class", "function"]
    local = spark.createDataFrame([(1, "main", "function", "a.py", "", 1, None), (2, "!", "risk", "x.md", "", None, None), (3, "run", "risk", "x.md", "", None, None)], s)
    ids = {r.id for r in resolve.canonical(resolve.members(resolve.raw_entities(local, local.limit(0)))).collect()}
    assert ids == {sha("|code|main|a.py"), sha("|concept|\0local\0x.md\0!"), sha("|concept|run")}


def test_views(spark):
    s = spark.createDataFrame([("p", "# P. More."), ("p/a", "A one. x"), ("p/a/b", "deep. x"), ("q/z", "Zed. x")], "scope string, markdown string")
    text = {r.project: r.text for r in views.index_view(s).collect()}
    assert text == {"p": "## p\nP.\n- **p/a** — A one.", "q": "## q\n- **q/z** — Zed."}
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, digest string")
    assert {r.path: r.change for r in views.changed(old, new).collect()} == {"b": "modified", "c": "removed", "d": "added"}
    d = spark.createDataFrame([(1, "<!-- pin: x -->one<!-- /pin --> <!-- pin -->two<!-- /pin --> <!-- pin: x -->three<!-- /pin -->"), (2, None)], "doc_id long, text string")
    assert sorted((r.label or "", r.content) for r in views.pinned_blocks(d, "doc_id", "text").collect()) == [("", "two"), ("x", "three")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalog.QUERIES[name](spark, DATA)
    r = con.execute(catalog.ORACLES[name])
    cols = sorted(c[0] for c in r.description)
    assert cols == sorted(df.columns)
    order = [[c[0] for c in r.description].index(c) for c in cols]
    flat = lambda row: tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in row)
    assert sorted(flat(x) for x in df.select(*cols).collect()) == sorted(flat([x[k] for k in order]) for x in r.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
