"""Table functions from files to entities, edges and chunks, one a format. None raises: a bad text gives no rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import is_vocabulary_file

#: A parsed thing: (name, kind, def_line) or (source, target, kind, source_line); lines count from 0.
Things = list[tuple[str, str, int | None]]
Links = list[tuple[str, str, str, int | None]]


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".", 1)[0]


def _unique(rows: list) -> list:
    return list(dict.fromkeys(rows))


def python(path: str, text: str) -> tuple[Things, Links]:
    """module, class, function (methods as Class.method); contains, inherits, imports and calls."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    mod = _stem(path)
    things: Things = [(mod, "module", 0)]
    links: Links = []

    def dotted(x: ast.AST) -> str | None:
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute):
            head = dotted(x.value)
            return f"{head}.{x.attr}" if head else x.attr
        return None

    def visit(body: list[ast.stmt], owner: str, prefix: str) -> None:
        for s in body:
            if isinstance(s, ast.ClassDef):
                things.append((s.name, "class", s.lineno - 1))
                links.append((owner, s.name, "contains", s.lineno - 1))
                links.extend((s.name, b, "inherits", s.lineno - 1) for x in s.bases if (b := dotted(x)))
                visit(s.body, s.name, s.name + ".")
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                name = prefix + s.name
                things.append((name, "function", s.lineno - 1))
                links.append((owner, name, "contains", s.lineno - 1))
                seen = {s.name}
                for c in ast.walk(s):
                    if isinstance(c, ast.Call) and (callee := dotted(c.func)):
                        callee = callee.removeprefix("self.")
                        if callee not in seen:
                            seen.add(callee)
                            links.append((name, callee, "calls", c.lineno - 1))

    visit(tree.body, mod, "")
    for s in ast.walk(tree):
        if isinstance(s, ast.Import):
            links.extend((mod, a.name, "imports", s.lineno - 1) for a in s.names)
        elif isinstance(s, ast.ImportFrom):
            links.extend((mod, f"{s.module}.{a.name}" if s.module else a.name, "imports", s.lineno - 1) for a in s.names)
    return _unique(things), _unique(links)


_JS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(class|interface|enum)\s+([A-Za-z_$][\w$]*)([^{]*)|(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>)")
_IMPORT = re.compile(r"^\s*(?:import|export)\b[^'\"]*?from\s+['\"]([^'\"]+)['\"]|^\s*import\s+['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)")


_JS_METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*\([^;]*$")
_JS_CALL = re.compile(r"(?<![\w$.])(new\s+)?((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*)\s*\(")
_JS_BLANK = re.compile(r"//.*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`")
_JS_WORDS = frozenset("if for while switch catch return function typeof await super import constructor do else with yield delete void in of new".split())


def javascript(path: str, text: str) -> tuple[Things, Links]:
    """module, class (interfaces and enums too), function and Class.method; contains, imports, inherits, implements, calls.

    Braces tell what stands in what: a stack of open declarations with the depth at which each began. Calls belong to the
    innermost function, each callee once; ``this.f`` is ``f``.
    """
    mod = _stem(path)
    things: Things = [(mod, "module", 0)] if text.strip() else []
    links: Links = []
    open_: list[tuple[str, str, int]] = []
    called: set[tuple[str, str]] = set()
    depth = 0
    for k, line in enumerate(text.split("\n")):
        bare = _JS_BLANK.sub('""', line)
        name, kind = None, None
        if m := _JS.match(line):
            name, kind = m.group(2) or m.group(4) or m.group(5), "class" if m.group(2) else "function"
            if rest := m.group(3):
                for word, link in (("extends", "inherits"), ("implements", "implements")):
                    if x := re.search(rf"\b{word}\s+([\w$.,\s]+?)(?=\bextends\b|\bimplements\b|\{{|$)", rest):
                        links.extend((name, b.strip(), link, k) for b in x.group(1).split(",") if b.strip())
        elif open_ and open_[-1][1] == "class" and depth == open_[-1][2] + 1 and (m := _JS_METHOD.match(bare)) and m.group(1) not in _JS_WORDS - {"constructor"}:
            name, kind = f"{open_[-1][0]}.{m.group(1)}", "function"
        if name:
            things.append((name, kind, k))
            owner = open_[-1][0] if open_ and open_[-1][1] == "class" else mod
            if name != mod:
                links.append((owner, name, "contains", k))
        if m := _IMPORT.search(line):
            links.append((mod, m.group(1) or m.group(2) or m.group(3), "imports", k))
        inner = name if kind == "function" else next((n for n, what, _ in reversed(open_) if what == "function"), None)
        for m in _JS_CALL.finditer(bare):
            callee = m.group(2).removeprefix("this.")
            own = inner and callee in (inner, inner.rsplit(".", 1)[-1]) and kind == "function"
            if inner and not own and callee.split(".")[0] not in _JS_WORDS and (inner, callee) not in called:
                called.add((inner, callee))
                links.append((inner, callee, "calls", k))
        after = depth + bare.count("{") - bare.count("}")
        if name and after > depth:
            open_.append((name, kind, depth))
        depth = after
        while open_ and depth <= open_[-1][2]:
            open_.pop()
    return _unique(things), _unique(links)


def rust(path: str, text: str) -> tuple[Things, Links]:
    """module, struct, enum, trait, function (Type::method); imports and implements; no lines."""
    mod = _stem(path)
    things: Things = [(mod, "module", None)] if text.strip() else []
    links: Links = []
    owner, depth, at = None, 0, 0
    for line in text.split("\n"):
        bare = re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"", "", line)
        if m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?(struct|enum|trait)\s+(\w+)", bare):
            things.append((m.group(2), m.group(1), None))
        elif m := re.match(r"\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?([\w:]+)", bare):
            owner, at = m.group(2).rsplit("::", 1)[-1], depth
            if m.group(1):
                links.append((owner, m.group(1).rsplit("::", 1)[-1], "implements", None))
        elif m := re.match(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)", bare):
            things.append((f"{owner}::{m.group(1)}" if owner else m.group(1), "function", None))
        elif m := re.match(r"\s*(?:pub\s+)?use\s+([\w:]+)", bare):
            links.append((mod, m.group(1), "imports", None))
        depth += bare.count("{") - bare.count("}")
        if owner and depth <= at and "}" in bare:
            owner = None
    return _unique(things), _unique(links)


_TF_BLOCK = re.compile(r"^\s*(resource|data|variable|output|module|provider|locals)\b\s*(?:\"([^\"]+)\"\s*)?(?:\"([^\"]+)\"\s*)?\{")
_TF_REF = re.compile(r"\b((?:var|local|module)\.[A-Za-z_][\w-]*|data\.[a-z]\w*\.[A-Za-z_][\w-]*|[a-z]\w*_\w+\.[A-Za-z_][\w-]*)")


def terraform(path: str, text: str) -> tuple[Things, Links]:
    """module, resource, data, variable, output, module_call, provider, local; contains and references."""
    mod = _stem(path)
    things: Things = [(mod, "module", 0)] if text.strip() else []
    links: Links = []
    depth, current, in_locals = 0, None, False
    for k, line in enumerate(text.split("\n")):
        bare = re.sub(r"(?:^|\s)(?:#|//).*", "", line)
        if depth == 0 and (m := _TF_BLOCK.match(bare)):
            kind, a, b = m.groups()
            in_locals = kind == "locals"
            name = {"resource": f"{a}.{b}", "data": f"data.{a}.{b}", "variable": f"var.{a}", "output": f"output.{a}", "module": f"module.{a}", "provider": f"provider.{a}"}.get(kind)
            current = name
            if name and "None" not in name:
                things.append((name, {"module": "module_call"}.get(kind, kind), k))
                links.append((mod, name, "contains", k))
        elif in_locals and depth == 1 and (m := re.match(r"\s*([A-Za-z_][\w-]*)\s*=", bare)):
            current = f"local.{m.group(1)}"
            things.append((current, "local", k))
            links.append((mod, current, "contains", k))
        if current:
            links.extend((current, r, "references", k) for r in _TF_REF.findall(bare) if r != current and r.split(".")[0] not in ("each", "count", "self", "terraform", "path"))
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"", "", bare)
        depth = max(0, depth + bare.count("{") - bare.count("}"))
        if depth == 0 and "}" in bare:
            current, in_locals = None, False
    return _unique(things), _unique([(a, b, c, d) for a, b, c, d in links])


def yaml(path: str, text: str) -> tuple[Things, Links]:
    """document, then by its shape the kind of a Kubernetes object, jobs, services, or keys with nested values; depends_on."""
    try:
        import yaml as y

        docs = [d for d in y.safe_load_all(text) if isinstance(d, dict)]
    except Exception:  # whatever the parser trips over
        return [], []
    doc = _stem(path)
    things: Things = [(doc, "document", 0)] if docs else []
    links: Links = []
    for d in docs:
        if "apiVersion" in d and "kind" in d:
            meta = d.get("metadata")
            things.append((str(meta.get("name", doc)) if isinstance(meta, dict) else doc, str(d["kind"]).lower(), None))
        elif isinstance(d.get("jobs"), dict) and ("on" in d or True in d):
            for j, v in d["jobs"].items():
                things.append((str(j), "job", None))
                need = v.get("needs", []) if isinstance(v, dict) else []
                links.extend((str(j), str(n), "depends_on", None) for n in ([need] if isinstance(need, str) else need or []))
        elif isinstance(d.get("services"), dict):
            for s, v in d["services"].items():
                things.append((str(s), "service", None))
                links.extend((str(s), str(n), "depends_on", None) for n in (v.get("depends_on") or [] if isinstance(v, dict) else []))
        else:
            things.extend((str(k), "key", None) for k, v in d.items() if isinstance(v, dict | list))
    return _unique(things), _unique(links)


def bicep(path: str, text: str) -> tuple[Things, Links]:
    """module, resource, param, var, output, module_call; references to names of the same file."""
    mod = _stem(path)
    things: Things = [(mod, "module", 0)] if text.strip() else []
    body: dict[str, list[tuple[int, str]]] = {}
    current = None
    for k, line in enumerate(re.sub(r"/\*.*?\*/", lambda m: "\n" * m.group().count("\n"), text, flags=re.S).split("\n")):
        bare = re.sub(r"//.*", "", line)
        if m := re.match(r"\s*(resource|param|var|output|module)\s+([A-Za-z_]\w*)", bare):
            current = m.group(2)
            things.append((current, {"module": "module_call"}.get(m.group(1), m.group(1)), k))
        if current:
            body.setdefault(current, []).append((k, bare))
    names = {n for n, kind, _ in things[1:]}
    links: Links = [(n, r, "references", k) for n, lines in body.items() for k, s in lines for r in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^'$]*'", "", s)) if r in names and r != n]
    return _unique(things), _unique(links)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.things: Things = []
        self.refs: list[tuple[str, int]] = []
        self.title, self.open, self.text = "", "", ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, k = dict(attrs), self.getpos()[0] - 1
        if tag == "title" or re.fullmatch(r"h[1-6]", tag):
            self.open, self.text = tag, ""
        if a.get("id"):
            self.things.append((f"#{a['id']}", "element", k))
        ref = a.get("src") if tag == "script" else a.get("href") if tag in ("a", "link") else None
        if ref and ref.strip() not in ("", "#"):
            self.things.append((ref, "script" if tag == "script" else "link", k))
            self.refs.append((ref, k))

    def handle_data(self, data: str) -> None:
        if self.open:
            self.text += data

    def handle_endtag(self, tag: str) -> None:
        if tag == self.open:
            text = " ".join(self.text.split())
            if tag == "title":
                self.title = text
            elif text:
                self.things.append((re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-"), "heading", self.getpos()[0] - 1))
            self.open = ""


def html(path: str, text: str) -> tuple[Things, Links]:
    """module, heading (slug), element (#id), script (src), link (href), at most 200 of them; references."""
    p = _Page()
    try:
        p.feed(text)
    except Exception:  # whatever the parser trips over
        return [], []
    mod = _stem(path)
    first = list({(n, k): (n, k, at) for n, k, at in reversed(p.things)}.values())[::-1]
    return [(mod, "module", 0), *first[:200]] if text.strip() else [], [(mod, r, "references", k) for r, k in {r: k for r, k in reversed(p.refs)}.items()]


_SCALARS = frozenset(("Int", "Float", "String", "Boolean", "ID"))


def graphql(path: str, text: str) -> tuple[Things, Links]:
    """module, type, input, enum, interface, union, scalar and Root.field of the root types; references and implements."""
    mod = _stem(path)
    things: Things = [(mod, "module", 0)] if text.strip() else []
    links: Links = []
    owner, depth = None, 0
    text = re.sub(r'"""(?:.|\n)*?"""', lambda m: "\n" * m.group().count("\n"), text)
    for k, line in enumerate(text.split("\n")):
        bare = re.sub(r"#.*|\"[^\"]*\"", "", line)
        if depth == 0 and (m := re.match(r"\s*(?:extend\s+)?(type|input|enum|interface|union|scalar)\s+(\w+)([^{=]*)(?:=(.*))?", bare)):
            kind, owner, rest, members = m.groups()
            root = kind == "type" and owner in ("Query", "Mutation", "Subscription")
            if not root:
                things.append((owner, kind, k))
            if bare.lstrip().startswith("extend"):
                links.append((owner, owner, "extends", k))
            links.extend((owner, i, "implements", k) for i in re.findall(r"\w+", rest.split("implements", 1)[1]) if "implements" in rest) if "implements" in rest else None
            links.extend((owner, u, "references", k) for u in re.findall(r"\w+", members or ""))
        elif depth == 1 and owner and (m := re.match(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*:\s*([\[\]!\w\s]+)", bare)):
            source = owner
            if owner in ("Query", "Mutation", "Subscription"):
                source = f"{owner}.{m.group(1)}"
                things.append((source, owner.lower(), k))
            types = re.findall(r":\s*[\[\s]*(\w+)", m.group(2) or "") + re.findall(r"\w+", m.group(3))[:1]
            links.extend((source, t, "references", k) for t in types if t not in _SCALARS and t != source)
        depth = max(0, depth + bare.count("{") - bare.count("}"))
        owner = owner if depth else None
    return _unique(things), _unique(links)


#: Which parser takes which suffix; the first that fits decides.
PARSERS: tuple[tuple[tuple[str, ...], Callable[[str, str], tuple[Things, Links]]], ...] = (
    ((".py",), python),
    ((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), javascript),
    ((".tf",), terraform),
    ((".yaml", ".yml"), yaml),
    ((".bicep",), bicep),
    ((".html", ".htm"), html),
    ((".graphql", ".gql"), graphql),
    ((".rs",), rust),
)


def parse(path: str, text: str) -> tuple[Things, Links]:
    low = path.lower()
    return next((f(path, text.replace("\r\n", "\n")) for s, f in PARSERS if low.endswith(s)), ([], []))


def extract(files: DataFrame) -> DataFrame:
    """(source_file, row, name, target, kind, line) of (path, text): rows of ``entity`` and of ``edge``; target is null in the former.

    Vocabulary files give none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, text in f.itertuples(index=False):
                if path and text:
                    things, links = parse(path, text)
                    out += [(path, "entity", n, None, k, at) for n, k, at in things]
                    out += [(path, "edge", a, b, k, at) for a, b, k, at in links]
            yield pd.DataFrame(out, columns=["source_file", "row", "name", "target", "kind", "line"]).astype({"line": "Int32"})

    return files.filter(~is_vocabulary_file(F.col("path"))).select("path", "text").mapInPandas(run, "source_file string, row string, name string, target string, kind string, line int")


def files_of_chunks(chunks: DataFrame) -> DataFrame:
    """(path, text): the files that chunks come from, put together again in order of chunk_no.

    Summaries are no files. Repeated rows count once. A file is gathered by its own path, so a task holds one file.
    """
    k = F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), r"\s+", ""))
    one = chunks.filter((k != "summary") & F.col("source_path").isNotNull()).groupBy("source_path", "chunk_no").agg(F.min("chunk_text").alias("t"))
    g = one.groupBy(F.col("source_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "t"))).alias("l"))
    return g.select("path", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))
