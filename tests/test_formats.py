"""Parsers, chunkers and the stream of snapshots."""

import datetime

from graphloom.sources import chunkers, parsers
from graphloom.streaming import ingest


def names(things):
    return {(n, k) for n, k, *_ in things}


def test_python():
    t, e = parsers.python("p/mod.py", "import os\nfrom .a import b\nclass A(B.C):\n    def f(self):\n        self.g(); os.walk(1)\n        g(2)\n\ndef h():\n    A()\n")
    assert names(t) == {("mod", "module"), ("A", "class"), ("A.f", "function"), ("h", "function")}
    kinds = {(a, b, k) for a, b, k, _ in e}
    assert {("mod", "os", "imports"), ("mod", "a.b", "imports"), ("A", "B.C", "inherits"), ("A.f", "g", "calls"), ("A.f", "os.walk", "calls"), ("h", "A", "calls"), ("mod", "A", "contains"), ("A", "A.f", "contains")} <= kinds
    assert parsers.python("x.py", "def (") == ([], [])


def test_other_languages():
    t, e = parsers.javascript("p/app.ts", "import { X } from './x';\nexport class A extends B implements C {\n}\nexport const f = async (a) => 1;\nfunction g() {}\ninterface I {}\n")
    assert names(t) == {("app", "module"), ("A", "class"), ("f", "function"), ("g", "function"), ("I", "class")}
    assert {("app", "./x", "imports"), ("A", "B", "inherits"), ("A", "C", "implements")} <= {(a, b, k) for a, b, k, _ in e}
    t, e = parsers.javascript("p/k.js", "class A {\n  constructor(x) {\n    super(x);\n    this.go(1);\n  }\n  async go(y) {\n    if (y) { helper(y); api.get('/x(') }\n    helper(2);\n  }\n}\nfunction top() {\n  function inner() { return new A(); }\n  return inner();\n}\n")
    assert names(t) == {("k", "module"), ("A", "class"), ("A.constructor", "function"), ("A.go", "function"), ("top", "function"), ("inner", "function")}
    assert {(a, b, k) for a, b, k, _ in e} == {("k", "A", "contains"), ("A", "A.constructor", "contains"), ("A", "A.go", "contains"), ("k", "top", "contains"), ("k", "inner", "contains"), ("A.constructor", "go", "calls"), ("A.go", "helper", "calls"), ("A.go", "api.get", "calls"), ("inner", "A", "calls"), ("top", "inner", "calls")}
    t, e = parsers.rust("p/lib.rs", "use a::b;\npub struct S {}\nimpl T for S {\n    fn m(&self) {\n    }\n}\nfn free() {}\ntrait T {}\n")
    assert names(t) == {("lib", "module"), ("S", "struct"), ("S::m", "function"), ("free", "function"), ("T", "trait")}
    assert ("S", "T", "implements", None) in e
    t, e = parsers.terraform("p/main.tf", 'resource "aws_x" "y" {\n  a = var.z\n}\nvariable "z" {}\nlocals {\n  q = aws_x.y\n}\nmodule "m" {\n}\n')
    assert names(t) == {("main", "module"), ("aws_x.y", "resource"), ("var.z", "variable"), ("local.q", "local"), ("module.m", "module_call")}
    assert {("aws_x.y", "var.z", "references"), ("local.q", "aws_x.y", "references")} <= {(a, b, k) for a, b, k, _ in e}
    t, e = parsers.graphql("p/s.graphql", "type User implements Node {\n  id: ID!\n  pal: Friend\n}\nenum E { A }\ntype Query {\n  me(f: Flt): User\n}\nunion U = User | E\n")
    assert names(t) == {("s", "module"), ("User", "type"), ("E", "enum"), ("Query.me", "query"), ("U", "union")}
    assert {("User", "Node", "implements"), ("User", "Friend", "references"), ("Query.me", "User", "references"), ("Query.me", "Flt", "references"), ("U", "E", "references")} <= {(a, b, k) for a, b, k, _ in e}
    t, e = parsers.bicep("p/m.bicep", "param loc string\nresource stg 'x@1' = {\n  location: loc\n}\noutput o string = stg.id\n")
    assert names(t) == {("m", "module"), ("loc", "param"), ("stg", "resource"), ("o", "output")} and ("stg", "loc", "references", 2) in e
    t, e = parsers.html("p/i.html", '<title>T</title><h1>Two Words</h1><div id="x"></div><script src="a.js"></script><a href="#">n</a><a href="/u">u</a><a href="/u">u</a>')
    assert names(t) == {("i", "module"), ("two-words", "heading"), ("#x", "element"), ("a.js", "script"), ("/u", "link")} and len(e) == 2
    t, e = parsers.yaml("p/w.yml", "on: push\njobs:\n  a: {}\n  b:\n    needs: a\n")
    assert names(t) == {("w", "document"), ("a", "job"), ("b", "job")} and ("b", "a", "depends_on", None) in e
    assert names(parsers.yaml("k.yaml", "apiVersion: v1\nkind: Service\nmetadata: {name: s}\n")[0]) == {("k", "document"), ("s", "service")}
    assert names(parsers.yaml("k.yaml", "a: 1\nb:\n  c: 2\n")[0]) == {("k", "document"), ("b", "key")}
    assert parsers.yaml("k.yaml", "a: [") == ([], []) and parsers.parse("x.bin", "y") == ([], []) and parsers.parse("x.rs", "") == ([], [])


def test_extract_table(spark):
    ch = spark.createDataFrame([("p/a.py", 1, "def g():\n    pass", "entity"), ("p/a.py", 0, "def f():\n    pass\n", " Entity"), ("p/a.py", 0, "def f():\n    pass\n", "entity"), ("p", 0, "summary", "summary"), (None, 0, "x", "entity"), ("p/b.py", 0, None, None)], "source_path string, chunk_no int, chunk_text string, kind string")
    got = parsers.extract(parsers.files_of_chunks(ch)).filter("row = 'entity'").collect()
    assert {(r.source_file, r.name, r.line) for r in got} == {("p/a.py", "a", 0), ("p/a.py", "f", 0), ("p/a.py", "g", 3)}
    assert parsers.extract(parsers.files_of_chunks(ch.limit(0))).count() == 0


def test_chunkers(spark):
    md = "intro\n\n# A\nbody a\n## B\nbody b\n# C\n"
    assert chunkers.markdown(md) == ["intro", "[heading: A]\n\nbody a", "[heading: A > B]\n\nbody b", "[heading: C]\n\nC"]
    assert all(len(c) <= chunkers.TARGET for c in chunkers.markdown("# H\n" + "word " * 2000))
    paras = "\n\n".join(f"{i} " + "x" * 398 for i in range(10))
    out = chunkers.prose(paras)
    assert len(out) > 2 and all(len(c) <= chunkers.CEILING for c in out)
    assert chunkers.prose(" \n ") == [] and chunkers.prose("one") == ["one"]
    long = chunkers.prose("A sentence here. " * 200)
    assert len(long) > 1 and all(len(c) <= chunkers.CEILING for c in long)
    assert chunkers.pages(["a", "b"]) == [] and chunkers.pages(["a hyphen-\nated word\nand more"]) == ["a hyphenated word and more"]
    d = spark.createDataFrame([(1, md), (2, None), (3, "  ")], "doc_id long, text string")
    assert chunkers.chunk(d, "doc_id", "text", "markdown").count() == 4


def test_incremental_stream(spark, tmp_path):
    at = lambda k: datetime.datetime(2025, 1, 1, k)
    src, state, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    schema = "path string, digest string, ts timestamp"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.run(spark, spark.readStream.schema(schema).parquet(src), state, ck).awaitTermination()
        return {(r.path, r.digest, r.batch) for r in spark.read.parquet(f"{state}/batch=*").select("path", "digest", "batch").collect()}

    assert {x[:2] for x in step([("a", "1", at(1)), ("b", "1", at(1)), ("a", "2", at(2))])} == {("a", "2"), ("b", "1")}
    second = step([("a", "2", at(3)), ("b", "5", at(3))])
    assert {x[:2] for x in second} == {("a", "2"), ("b", "1"), ("b", "5")}
    assert {x[:2] for x in step([("b", "5", at(4)), ("c", "9", at(4))])} == {("a", "2"), ("b", "1"), ("b", "5"), ("c", "9")}


def test_windows_on_a_table(spark):
    e = spark.createDataFrame([("x", datetime.datetime(2025, 1, 1, 1, 5), 1.0), ("x", datetime.datetime(2025, 1, 1, 1, 55), 2.0), ("x", datetime.datetime(2025, 1, 1, 2, 0), 4.0)], "event_type string, ts timestamp_ntz, value double")
    assert sorted((r.n, r.total) for r in ingest.windowed(e).collect()) == [(1, 4.0), (2, 3.0)]
