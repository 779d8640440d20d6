"""Telling generated, minified, vendored and data-only code files from hand-written ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import cut

#: Suffixes of code files (style sheets included); prose, configuration and summaries are none.
CODE = "py pyi ts tsx js jsx mjs cjs rs go java kt kts scala c h cc cpp hpp cs rb php swift sh sql css scss less tf graphql gql bicep vue lua r pl".split()
#: What tools write at the head of their output, in several languages.
GENERATED = (
    r"@generated\b|<auto-?generated|\bauto-?generated\b(?! (?:ids?|names?|keys?|values?|docs?) (?:for|of|in)\b)",
    r"\bcode generated by\b|\bgenerated (?:by|from|with|using|automatically)\b|\b(?:this|the) (?:file|code|module|source) (?:is|was|has been) (?:auto(?:matically)?[- ])?(?:generated|created automatically|produced|compiled|written by a)",
    r"\bdo not (?:edit|modify|change|touch)\b(?:[^\n]{0,40}\b(?:by hand|manually|directly|this file))?|\bdon't edit\b",
    r"\b(?:changes|edits|modifications) (?:to this file )?(?:will|may) be (?:overwritten|lost)|\bmanual (?:edits|changes) (?:are|will be|get) lost|\bsource of truth:",
    r"\b(?:created|written|produced|emitted) automatically by\b|\bproduced from (?:the )?(?:schema|template|spec|idl|model)\b|\bregenerate (?:it )?(?:with|by|using)\b",
    r"automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|ändern|von hand)|généré automatiquement|ne pas modifier|generado automáticamente|no (?:editar|modificar)\b|gerado automaticamente|自動生成|自动生成",
)
#: What stands at the head of a copy from another project.
VENDORED = (
    r"\bcopied (?:verbatim )?from \S+ (?:tag|version|release|v?\d)|\bcopied from \S+[^\n]*\bupstream\b|\bkeep in step with upstream",
    r"\boriginally (?:part of|from) the \S+ (?:project|library|package)|\bimported unchanged\b|\bvendored (?:from|copy)\b",
    r"\bbundled copy of \S+|\breport bugs upstream\b|\bupstream:\s*\S+",
    r"spdx-filecopyrighttext:(?![^\n]*\b(?:this repo|our)\b)",
    r"^\W*\S+ v?\d+(?:\.\d+)+\s*(?:\(c\)|©|copyright)|^\W*\S+ - https?://\S+\s*$|\bcopyright (?:\(c\) )?(?:\d{4}[-, ]*)*the \S+ (?:authors|team|contributors|project|developers)\b",
    r"^/\*!\s*\S+ (?:v?\d|build\b)",
)
_GENERATED = re.compile("|".join(GENERATED), re.I | re.M)
_VENDORED = re.compile("|".join(VENDORED), re.I | re.M)
#: What may stand before a mark on its line: nothing, the end of a clause, an address to the reader, or the file as the subject.
_BEFORE = re.compile(r"(?:^|[.;:,!?()\[\]<>=*|–—-])\W*(?:(?:please|note|warning|caution|attention|important|achtung|bitte|attention|aviso|atención)\W*)*$|\b(?:this|the|diese|dieser|ce|cet|le|este|el|o)\s+(?:file|code|module|source|script|datei|quelltext|fichier|archivo|fichero|arquivo)\s+(?:is|was|has|should|must|can|ist|wurde|wird|est|a|fue|es|foi)\b[^.;:]{0,30}$|(?:ファイル|文件)[^。]{0,12}$", re.I)
#: Directories right under the root of a project that hold other projects.
VENDOR_DIRS = frozenset("vendor vendors vendored _vendor third_party third-party thirdparty node_modules bower_components external externals deps pods carthage jspm_packages".split())
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"\"\"|'''|///|//!)")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Za-z_]\w*")
_LIBRARY = re.compile(r"\b(?:from|of|part of the|copy of|the)\s+([a-z][\w.-]{2,})|^\W*([a-z][\w.-]{2,}) (?:v?\d|- https?|build\b)|spdx-filecopyrighttext:\s*([a-z][\w.-]{2,})", re.I)


def head(text: str) -> Iterator[str]:
    """The comment lines before the first line of program text, however many; imports may stand between them."""
    until = ""
    for line in text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = line.strip()
        if until:
            yield line
            if until in s:
                until = ""
        elif not s or s.startswith(("import ", "from ", "use ", "package ", "'use strict'", "\"use strict\"")):
            continue
        elif _COMMENT.match(line):
            yield line
            for a, b in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
                if s.startswith(a) and b not in s[len(a) :]:
                    until = b
        else:
            return


def says(form: re.Pattern, line: str) -> bool:
    """Whether a comment states it of its own file: a mark in the middle of a sentence about something else does not."""
    bare = line.strip()
    return any(not m.start() or _BEFORE.search(bare[: m.start()]) for m in form.finditer(bare))


def head_marks(text: str) -> tuple[bool, bool, str | None]:
    """(generated, vendored, library): whether the comments at the head of a file say so, and which library they name."""
    gen = ven = False
    library = None
    for line in head(text):
        gen = gen or says(_GENERATED, line)
        if says(_VENDORED, line):
            ven = True
            m = _LIBRARY.search(line)
            library = library or (m and next(g for g in m.groups() if g).lower().rstrip(".-"))
    return gen, ven, library or None


def shape(text: str) -> tuple[int, int, int, int, int, int, int, int]:
    """(lines, chars, long, dense, data, serial, comments, blank): sizes of what a chunk consists of.

    ``long``: characters on lines over 300. ``dense``: those of them on lines of program text without the blanks that
    people write. ``data``: characters on lines of literals only. ``serial``: characters on lines that repeat one
    pattern with counted names. ``comments``: characters on comment lines. ``blank``: blanks.
    """
    lines = [x for x in re.split(r"\r\n|\n|\r", text) if x.strip()]
    n = long_ = dense = data = comments = 0
    forms: Counter[str] = Counter()
    form_of: list[tuple[str, int]] = []
    for x in lines:
        s = x.strip()
        n += len(s)
        if _COMMENT.match(x):
            comments += len(s)
            if len(s) > 300 and s.startswith("/*") and "*/" in s[:200]:
                pass
            else:
                continue
        bare = _STRING.sub("S", s)
        if len(s) > 300:
            long_ += len(s)
            # people's long lines are one string or words; packed code is marks and short names
            marks = sum(c in "{}();,=:.[]!&|<>?+-*/" for c in bare)
            if marks > 0.12 * len(bare) and bare.count(" ") < 0.12 * len(bare) and len(bare) > 0.3 * len(s):
                dense += len(s)
        names = _NAME.sub("", bare.replace("S", ""))
        if len(names) == len(bare.replace("S", "")) or re.fullmatch(r"[\[{(]*\s*(?:[A-Za-z_]\w*\s*[:=]+>?\s*)?(?:S|[-+.\dxXeE_]|0x[0-9a-fA-F]+|[\[\]{}(),:;&\s=>])+", bare):
            if re.search(r"\d|S", bare):
                data += len(s)
        elif _DIGITS.search(bare) or _DIGITS.search(s):
            f = _NAME.sub(lambda m: _DIGITS.sub("0", m.group()), _DIGITS.sub("0", s))
            forms[f] += 1
            form_of.append((f, len(s)))
    serial = sum(k for f, k in form_of if forms[f] >= 3)
    return len(lines), n, long_, dense, data, serial, comments, sum(map(text.count, (" ", "\t")))


def code_path(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1).isin(*CODE), F.lit(False))


def chunk_marks(chunks: DataFrame) -> DataFrame:
    """Per chunk of a code file: its marks, sizes and the hash of its text without indents and empty lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, no, text, h in f.itertuples(index=False):
                t = text or ""
                rows.append((path, no, h, *(head_marks(t) if no == 0 else (False, False, None)), *shape(t)))
            yield pd.DataFrame(rows, columns=["source_path", "chunk_no", "hash", "gen", "ven", "library", "lines", "chars", "long_", "dense", "data", "serial", "comments", "blanks"])

    own = chunks.filter(code_path(F.col("source_path")) & (F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), r"\s+", "")) != "summary"))
    plain = F.regexp_replace("chunk_text", r"(?m)\s+", " ")
    own = own.select("source_path", F.coalesce("chunk_no", F.lit(0)).cast("int").alias("chunk_no"), "chunk_text", F.xxhash64(plain).alias("hash"))
    return own.mapInPandas(run, "source_path string, chunk_no int, hash long, gen boolean, ven boolean, library string, lines int, chars int, long_ int, dense int, data int, serial int, comments int, blanks int")


def files(chunks: DataFrame) -> DataFrame:
    """One row a code file: summed sizes, marks and ``digest``, a hash of its chunks in whatever order they arrive.

    Repeated rows of a chunk count once. A file may have any number of chunks; they are summed, not gathered.
    """
    one = chunk_marks(chunks).dropDuplicates(["source_path", "chunk_no", "hash"])
    sums = [F.sum(c).alias(c) for c in ("lines", "chars", "long_", "dense", "data", "serial", "comments", "blanks")]
    return one.groupBy("source_path").agg(F.max("gen").alias("gen"), F.max("ven").alias("ven"), F.min("library").alias("library"), F.expr("bit_xor(xxhash64(chunk_no, hash))").alias("digest"), *sums)


def ancestors(own: DataFrame) -> DataFrame:
    """``own`` once a directory above each file and once for the file itself, as ``node``, with the ``rest`` of the path."""
    parts = F.split("source_path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("node"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))
    return own.withColumn("x", F.explode(each)).select(*own.columns, "x.*")


def shared_trees(own: DataFrame, least_chars: int = 400) -> DataFrame:
    """(source_path): files in subtrees that stand, name for name and text for text, in unrelated projects.

    The Merkle digest of a directory is made of the digests and relative names of all that is below it: the recursion
    from the bottom up, unrolled, so that one aggregation serves trees of any depth. Entries are combined by exclusive
    ors and sums, which partial aggregation does before the shuffle, so a directory may hold any number of files. Equal
    digests mean equal subtrees. The name of a directory itself does not matter. The topmost shared directory marks
    everything below it; a file alone counts from ``least_chars`` characters on, and so does a directory of one file.
    """
    up = ancestors(own.select("source_path", "digest", "chars")).filter("depth > 1")
    entry = lambda k: F.xxhash64(F.lit(k), "rest", "digest", "chars")
    nodes = up.select("node", entry(1).alias("h1"), entry(2).alias("h2"), "chars").groupBy("node")
    nodes = nodes.agg(F.expr("bit_xor(h1)").alias("d1"), F.expr("bit_xor(h2)").alias("d2"), F.count(F.lit(1)).alias("n_files"), F.sum("chars").alias("chars"))
    nodes = cut(nodes.filter((F.col("n_files") > 1) | (F.col("chars") >= least_chars)).withColumn("project", F.substring_index("node", "/", 1)))
    shared = nodes.groupBy("d1", "d2").agg(F.min("project").alias("a"), F.max("project").alias("b")).filter("a <> b").select("d1", "d2")
    roots = nodes.join(shared, ["d1", "d2"], "left_semi").select("node")
    return up.select("source_path", "node").join(roots, "node", "left_semi").select("source_path").distinct()


def library_stem(name: Column) -> Column:
    """The name of a directory without a version behind it: ``lib-1.2``, ``lib@1.2`` and ``lib`` are one library."""
    return F.regexp_replace(F.lower(name), r"[-_@]?v?\d+(?:\.\d+)*(?:[-.+][\w.]+)?$", "")


def known_libraries(own: DataFrame) -> DataFrame:
    """(stem): names that the corpus itself shows to be libraries' names.

    A name counts if heads of copied files give it as where they are from, or if directories of that name, apart from
    their versions, stand under a root directory for foreign code in unrelated projects.
    """
    told = own.filter("library IS NOT NULL").select(F.col("library").alias("stem"))
    parts = F.split("source_path", "/")
    below = own.filter(F.lower(F.element_at(parts, 2)).isin(*VENDOR_DIRS) & (F.size(parts) > 3)).select(library_stem(F.element_at(parts, 3)).alias("stem"), F.element_at(parts, 1).alias("p"))
    often = below.groupBy("stem").agg(F.min("p").alias("a"), F.max("p").alias("b")).filter("a <> b").select("stem")
    return told.unionByName(often).filter("stem <> ''").distinct()


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """(source_path, reason) of the code files that nobody in the project wrote by hand, once each.

    Reasons, the first that holds: ``shared`` (its subtree stands in an unrelated project, too), ``vendored`` (its head
    names the project it is from, or it stands under a directory for foreign code at the root of its project, in one
    that has a version or the name of a known library), ``generated`` (its head says so, or most of it repeats one
    pattern with counted names), ``minified`` (most of it is packed lines), ``data`` (nearly all lines are literals).
    Names of directories alone, wherever they stand, and sentences about generators are no evidence.
    Null paths and null or empty texts count as nothing; an empty table gives no row.
    """
    own = cut(files(chunks))
    parts = F.split("source_path", "/")
    lib = F.element_at(parts, 3)
    foreign = F.coalesce(F.lower(F.element_at(parts, 2)).isin(*VENDOR_DIRS) & (F.size(parts) > 3), F.lit(False))
    held = own.filter(foreign).select("source_path", library_stem(lib).alias("stem"), (library_stem(lib) != F.lower(lib)).alias("versioned"))
    copied = held.filter("versioned").select("source_path").unionByName(held.join(known_libraries(own), "stem", "left_semi").select("source_path"))
    copied = copied.unionByName(own.filter("ven").select("source_path"))
    size = F.greatest(F.col("chars"), F.lit(1))
    code = F.greatest(F.col("chars") - F.col("comments"), F.lit(1))
    shape_of = (
        F.when(F.col("gen") | ((F.col("serial") >= 0.7 * code) & (F.col("lines") >= 5)), 3)
        .when(F.col("dense") >= 0.4 * size, 4)
        .when((F.col("data") >= 0.85 * code) & (F.col("data") >= 200), 5)
    )
    found = shared_trees(own).select("source_path", F.lit(1).alias("r"))
    found = found.unionByName(copied.select("source_path", F.lit(2).alias("r"))).unionByName(own.select("source_path", shape_of.alias("r")).filter("r IS NOT NULL"))
    names = F.array(*(F.lit(x) for x in ("shared", "vendored", "generated", "minified", "data")))
    return found.groupBy("source_path").agg(F.min("r").alias("r")).select("source_path", F.element_at(names, F.col("r")).alias("reason"))
