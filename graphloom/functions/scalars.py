"""Scalar functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.operators.orphans import name_key

normalize_name = name_key

#: Suffixes of code and of infrastructure files.
CODE_EXT = (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".rs", ".graphql", ".gql", ".html", ".htm")
OPS_EXT = (".tf.json", ".tf", ".tfvars", ".hcl", ".bicep", ".yaml", ".yml")
ONTOLOGY_FILES = ("ontology.toml", "ontology.yaml", "ontology.yml", "ontology.base.yaml")
#: Authority of each tier of sources, and of none.
TIER_WEIGHT = {"THEORY": 1.0, "ARCHITECTURE": 0.95, "ADR": 0.9, "CODE": 0.85, "OVERVIEW": 0.85, "CONTEXT": 0.8, "REFERENCE": 0.8, "OPS": 0.6, "SPEC": 0.5, "EPHEMERAL": 0.2}
TIER_DEFAULT = 0.3
#: Weight of each kind of edge, and of any other.
EDGE_WEIGHT = {"governed-by": 0.95, "implements": 0.9, "inherits": 0.9, "realizes": 0.9, "implemented-by": 0.9, "supersedes": 0.85, "addresses": 0.7, "manifested-by": 0.7, "calls": 0.6, "motivates": 0.5, "imports": 0.3}
EDGE_DEFAULT = 0.5
#: Kinds of edges that make their target central.
CENTRAL_KINDS = ("implements", "inherits", "realizes", "governed-by", "implemented-by")
#: Names that stand for something else in every file.
STOPLIST = ("__init__", "__call__", "__main__", "main", "run", "setup", "conftest", "handler")


def _any_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.endswith(s) for s in suffixes))


def is_code_path(path: Column) -> Column:
    return F.coalesce(_any_suffix(F.lower(path), CODE_EXT), F.lit(False))


def is_ops_path(path: Column) -> Column:
    return F.coalesce(_any_suffix(F.lower(path), OPS_EXT), F.lit(False))


def classify_source(path: Column) -> Column:
    """Tier of a source path, '' for plain prose; null for null. The first rule that holds decides."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    base = F.substring_index(p, "/", -1)
    return (
        F.when(path.isNull(), None)
        .when(base == "theory.md", "THEORY")
        .when(base == "architecture.md", "ARCHITECTURE")
        .when(p.contains("docs/adr/") | p.contains("/adr/") | base.rlike(r"^\d{3,4}[-_].*\.md$"), "ADR")
        .when(is_code_path(p), "CODE")
        .when(base.isin(*ONTOLOGY_FILES), "CONTEXT")
        .when(is_ops_path(p), "OPS")
        .when(base == "context.md", "CONTEXT")
        .when(base.contains("reference") | p.contains("reference/"), "REFERENCE")
        .when((base == "plan.md") | p.contains("docs/features/") | p.contains("specs/"), "SPEC")
        .when(base.rlike("readme|handoff|notes|scratch|todo"), "EPHEMERAL")
        .otherwise("")
    )


def glob_regex(glob: Column) -> Column:
    """A file glob (``*``, ``?``) as an anchored regular expression."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def tier_weight(tier: Column) -> Column:
    return _lookup(TIER_WEIGHT, tier, TIER_DEFAULT)


def edge_weight(kind: Column) -> Column:
    return _lookup(EDGE_WEIGHT, kind, EDGE_DEFAULT)


def authority(sources: Column) -> Column:
    """The best weight of any source; the default for none."""
    return F.coalesce(F.array_max(F.transform(sources, lambda s: tier_weight(classify_source(s)))), F.lit(TIER_DEFAULT))


def edge_drift(changed: Column, size: Column) -> Column:
    return F.when((changed > 0) & (size > 0), F.least(F.lit(1.0), changed / size)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a vector is null, empty or zero, or the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def normalize_text(text: Column) -> Column:
    """Unix line ends, no blanks at line ends, at most one empty line in a row."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0b]+(?=\n|$)", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def first_sentence(markdown: Column) -> Column:
    """Up to the first ". ", else up to the first period at a line's end, else 200 characters."""
    t = F.regexp_replace(F.regexp_replace(markdown, r"^\s+", ""), r"^#", "")
    t = F.regexp_replace(t, r"^\s+", "")
    a, b = F.instr(t, ". "), F.instr(t, ".\n")
    cut = F.concat(F.rtrim(F.substring(t, 1, 200)), F.when(F.char_length(t) > 200, "...").otherwise(""))
    return F.when(a > 0, F.substring(t, F.lit(1), a)).when(b > 0, F.substring(t, F.lit(1), b)).otherwise(cut)


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def scope_of(path: Column) -> Column:
    """The directory of a path; ``.`` at the root."""
    d = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(d == "", ".").otherwise(d)


def in_scope(scope: Column, target: str | None) -> Column:
    """Whether a scope is the target or below it; no target, or the root, takes all."""
    if not target or target == ".":
        return F.lit(True)
    return (scope == target) | scope.startswith(target + "/")


def target_scope(scope: str | None, root: str) -> str | None:
    """A scope as callers write it, as the path below ``root`` by which chunks are filed; None for all of it.

    Absolute paths below the root become relative ones; nothing, ``.``, the root and its name mean everything. An absolute
    path elsewhere is kept without its slashes and so matches nothing.
    """
    if scope is None:
        return None
    base = root.rstrip("/")
    s = scope.replace("\\", "/")
    s = s[len(base) :] if s == base or s.startswith(base + "/") else s
    parts = [x for x in s.split("/") if x not in ("", ".")]
    return None if not parts or parts == [base.rsplit("/", 1)[-1]] else "/".join(parts)


def is_vocabulary_file(path: Column) -> Column:
    """Whether a path is that of a vocabulary, which is hashed but gives no entities."""
    return F.coalesce(F.lower(F.substring_index(path, "/", -1)).isin(*ONTOLOGY_FILES), F.lit(False))


def identifier_tokens(name: Column) -> Column:
    """Lower-case words of four letters or more of a camel or snake case identifier."""
    apart = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(apart), " "), lambda w: F.length(w) >= 4))


def freshness_header(commit: Column, tree_hash: Column, at: Column) -> Column:
    return F.format_string("<!-- graph_commit: %s | source_tree_hash: %s | materialized_at: %s -->", commit, tree_hash, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def parse_freshness(header: Column) -> Column:
    """struct(graph_commit, source_tree_hash) of a header, null where either is no hexadecimal hash."""
    c = F.regexp_extract(header, r"graph_commit: ([0-9a-f]+)", 1)
    h = F.regexp_extract(header, r"source_tree_hash: ([0-9a-f]+)", 1)
    return F.when((c != "") & (h != ""), F.struct(c.alias("graph_commit"), h.alias("source_tree_hash")))


def candidate_bare(phrase: Column) -> Column:
    """The name that a dropped phrase is trying to give: of ``Name (kind, file)`` and of ``path.py:Symbol``."""
    p = F.trim(phrase)
    echo = F.regexp_extract(p, r"^(.+?) \((?:module|class|function|interface), .+\)$", 1)
    head, tail = F.trim(F.substring_index(p, ":", 1)), F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1)
    symbol = p.contains(":") & _any_suffix(head, CODE_EXT) & (tail != "") & ~tail.rlike(r"^\d")
    return F.when(echo != "", F.trim(echo)).when(symbol, F.trim(tail)).otherwise(p)
