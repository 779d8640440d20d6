"""The snapshot of a graph: load, upsert and look up, unite projects, export, and keep rendered pages fresh."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S

#: Schema of a stored state, and what a missing score means.
STATE = (
    "commit string, entities array<struct<id:string,name:string,kind:string,description:string,aliases:array<string>,sources:array<string>,kinds:array<string>,source_tier:double,centrality:double,confidence:double,def_line:int>>, "
    "relationships array<struct<source_id:string,target_id:string,kind:string,description:string,weight:double,drift:double,source_line:int>>, summaries array<struct<scope:string,digest:string,markdown:string>>, scope_entities map<string,array<string>>"
)
NEUTRAL = {"source_tier": 0.0, "centrality": 0.0, "confidence": 1.0, "weight": 0.5, "drift": 0.0}
SCHEMA_VERSION = 3
#: Characters that a token stands for.
TOKEN_CHARS = 4


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a stored graph: ``commit``, ``entities``, ``relationships``, ``summaries``, ``scopes`` (scope, id).

    Missing lists are empty and missing scores neutral; of edges with the same ends and kind the first in the file stands,
    of repeated entities and summaries the last.
    """
    raw = spark.read.schema(STATE).json(path, multiLine=True)

    def rows(name: str, key: list[str], last: bool) -> DataFrame:
        x = raw.select(F.posexplode(name).alias("pos", "x")).select("pos", "x.*")
        pick = F.max_by if last else F.min_by
        x = x.groupBy(*key).agg(pick(F.struct(*[c for c in x.columns if c not in (*key, "pos")]), "pos").alias("f")).select(*key, "f.*")
        for c in x.columns:
            if c in NEUTRAL:
                x = x.withColumn(c, F.coalesce(c, F.lit(NEUTRAL[c])))
            elif c in ("aliases", "sources", "kinds"):
                x = x.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
        return x

    return {
        "commit": raw.select("commit"),
        "entities": rows("entities", ["id"], True),
        "relationships": rows("relationships", ["source_id", "target_id", "kind"], False),
        "summaries": rows("summaries", ["scope"], True),
        "scopes": raw.select(F.explode("scope_entities").alias("scope", "ids")).select("scope", F.explode("ids").alias("id")),
    }


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of new rows with one key the first by ``order``."""
    if order:
        cols = [c for c in new.columns if c not in key]
        new = new.groupBy(*key).agg(F.min_by(F.struct(*cols), order).alias("f")).select(*key, "f.*").select(*new.columns)
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def lookup(table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows by key: a filter that reaches the scan, for any number of keys that a statement can hold."""
    return table.filter(F.col(key).isin(*values))


def by_scope(n: DataFrame, scope: str | None = None) -> DataFrame:
    """(scope, id, name, kind): entities of each scope that one of their sources lies in, or of one scope only."""
    s = n.select("id", "name", "kind", F.explode(F.array_distinct(F.transform("sources", S.scope_of))).alias("scope"))
    return (s if scope is None else s.filter(F.col("scope") == scope)).select("scope", "id", "name", "kind")


def unite(snapshots: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Snapshots of several projects as one with ``project``; a key in several stands as in the last by name."""
    out = None
    for k, (name, df) in enumerate(sorted(snapshots.items())):
        one = df.withColumns({"project": F.lit(name), "__k": F.lit(k)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in (key, "__k")]
    return out.groupBy(key).agg(F.max_by(F.struct(*cols), "__k").alias("f")).select(key, "f.*")


def ranking_weight(confidence: Column, centrality: Column) -> Column:
    return confidence * (1 + centrality)


def scope_order(n: DataFrame, most: int | None = None) -> DataFrame:
    """(scope, id, place): entities of each scope by their weight, confidence x (1 + centrality), then by id."""
    s = n.select("id", ranking_weight(F.coalesce("confidence", F.lit(1.0)), F.coalesce("centrality", F.lit(0.0))).alias("w"), F.explode(F.array_distinct(F.transform("sources", S.scope_of))).alias("scope"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(F.round("w", 9).desc(), "id")))
    return (s if most is None else s.filter(F.col("place") <= most)).select("scope", "id", "place")


def split_stale(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, stale): rows of the kind ``stale-claim`` are reported and take no further part."""
    stale = F.coalesce(F.col("kind") == "stale-claim", F.lit(False))
    return claims.filter(~stale), claims.filter(stale)


# ---- export
def labels(n: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(id, project): the label of the declared prefix that the first source lies under, the longest if several do.

    ``declared`` has label and prefix, is a table of settings and broadcast; without it the first segment is the label.
    Concept hubs and nodes without a source have none.
    """
    own = n.select("id", F.array_min("sources").alias("src"))
    if declared is None:
        return own.select("id", F.substring_index("src", "/", 1).alias("project"))
    under = F.col("src").startswith(F.concat("prefix", F.lit("/"))) | (F.col("prefix") == "")
    j = own.join(F.broadcast(declared.limit(100_000)), under, "left")
    return j.groupBy("id").agg(F.max_by("label", F.struct(F.length("prefix"), "label")).alias("project"))


def project_part(n: DataFrame, e: DataFrame, project: str, hub_kinds: tuple[str, ...] = ("concept",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one project: its nodes, all concept hubs, and the edges between what is kept."""
    keep = n.join(labels(n), "id").filter((F.col("project") == project) | F.col("kind").isin(*hub_kinds)).drop("project")
    ids = keep.select("id")
    e = e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return keep, e


def export_edges(n: DataFrame, e: DataFrame) -> DataFrame:
    """(source, target, kind, weight, drift, cross_repo, sourceLine, targetLine): edges whose ends are both nodes."""
    p = labels(n).join(n.select("id", "def_line"), "id")
    j = e.join(p.select(F.col("id").alias("source_id"), F.col("project").alias("sp")), "source_id").join(p.select(F.col("id").alias("target_id"), F.col("project").alias("tp"), "def_line"), "target_id")
    cross = F.coalesce(F.col("sp") != F.col("tp"), F.lit(False))
    return j.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind", "weight", "drift", cross.alias("cross_repo"), F.col("source_line").alias("sourceLine"), F.col("def_line").alias("targetLine"))


def export_document(n: DataFrame, e: DataFrame, files: DataFrame, commit: str) -> DataFrame:
    """(part, json): the export as lines: one ``head`` and one a ``file``, ``node`` and ``edge``.

    A document of lines is written by all tasks at once and read back by its parts; nothing is gathered on the driver.
    """
    head = n.select(F.explode("sources").alias("s")).select(F.substring_index("s", "/", 1).alias("p")).agg(F.array_sort(F.collect_set("p")).alias("projects"))
    head = head.select(F.lit("head").alias("part"), F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(commit).alias("graph_commit"), "projects")).alias("json"))
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    spine = e.filter("kind = 'contains'").groupBy(F.col("target_id").alias("id")).agg(F.min_by("source_id", "rel_id").alias("parent"))
    node = n.join(labels(n), "id").join(spine, "id", "left").withColumn("scope", S.scope_of(F.array_min("sources")))
    node = node.select("id", "name", "kind", "project", "scope", "parent", "sources", (F.col("kind") == "concept").alias("is_concept"), "confidence", "centrality", "source_tier", "def_line", "description")
    return head.unionByName(line(files, "file")).unionByName(line(node, "node")).unionByName(line(export_edges(n, e), "edge"))


# ---- pages
def without_header(text: Column) -> Column:
    """A page without its freshness header and the empty lines behind it; a page without one as it is."""
    end = F.instr(text, "-->")
    rest = F.regexp_replace(F.substring(text, end + 3, F.char_length(text)), r"^\n+", "")
    return F.when(S.parse_freshness(text).isNotNull() & (end > 0), rest).otherwise(text)


def overview(text: Column, max_tokens: int) -> Column:
    """A page within ``max_tokens`` of four characters: cut at its last empty line, if that is in the latter half, else hard."""
    t, budget = without_header(text), max_tokens * TOKEN_CHARS
    cut = F.substring(t, 1, budget)
    para = F.char_length(cut) - F.char_length(F.substring_index(cut, "\n\n", -1)) - 2
    return F.when(F.char_length(t) <= budget, t).when(para > budget // 2, F.substring(cut, F.lit(1), para)).otherwise(cut)


def freshness(pages: DataFrame, commit: str, trees: DataFrame) -> DataFrame:
    """(scope, fresh, ingest, render): what each page needs. ``pages`` has scope and text, ``trees`` scope and tree_hash.

    A page is fresh if its header names both hashes as they are. A header that is missing or unreadable, or another tree
    hash, asks for ingest and rendering; another graph commit for rendering alone. A scope without a page needs both.
    """
    j = trees.select("scope", "tree_hash").join(pages.select("scope", "text"), "scope", "left").withColumn("h", S.parse_freshness(F.col("text")))
    tree = F.coalesce(F.col("h.source_tree_hash") == F.col("tree_hash"), F.lit(False))
    fresh = tree & F.coalesce(F.col("h.graph_commit") == F.lit(commit), F.lit(False))
    return j.select("scope", fresh.alias("fresh"), (~tree).alias("ingest"), (~fresh).alias("render"))


def agents_page(header: Column, markdown: Column, reference: Column, gap: Column) -> Column:
    """A rendered page: header, summary (empty if none), then the reference pointer or, without one, the gap."""
    return F.concat(F.concat_ws("\n\n", header, F.coalesce(markdown, F.lit("")), F.coalesce(reference, gap)), F.lit("\n"))


def merge_pinned(rendered: Column, labels_: Column, contents: Column) -> Column:
    """A freshly rendered page with its pinned blocks (arrays of labels, null for none, and contents) at its end."""
    block = F.zip_with(labels_, contents, lambda k, c: F.concat(F.when(k.isNull(), "<!-- pinned -->").otherwise(F.concat(F.lit("<!-- pinned:"), k, F.lit(" -->"))), F.lit("\n"), c, F.lit("\n<!-- /pinned -->")))
    return F.when(F.coalesce(F.size(contents), F.lit(0)) <= 0, rendered).otherwise(F.concat(F.rtrim(F.regexp_replace(rendered, r"\s+$", "")), F.lit("\n\n"), F.array_join(block, "\n\n"), F.lit("\n")))


def write_if_changed(pages: DataFrame, root: str) -> DataFrame:
    """(path, written): writes each ``text`` to ``path`` below ``root`` unless that file holds it already.

    Tasks write their own pages, to any file system that Arrow opens by its address; a page is replaced by a rename, so a
    reader or a repeated task sees the old or the new text. Evaluate the result once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for f in frames:
            done = []
            for path, text in f.itertuples(index=False):
                at, data = f"{base.rstrip('/')}/{path}", (text or "").encode()
                if files.get_file_info(at).type == fs.FileType.File:
                    with files.open_input_file(at) as fh:
                        if hashlib.sha256(fh.read()).digest() == hashlib.sha256(data).digest():
                            done.append((path, False))
                            continue
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(at + ".part") as fh:
                    fh.write(data)
                files.move(at + ".part", at)
                done.append((path, True))
            yield pd.DataFrame(done, columns=["path", "written"])

    return pages.select("path", "text").mapInPandas(run, "path string, written boolean")


def edge_sections(n: DataFrame, e: DataFrame, most: int = 8) -> DataFrame:
    """(scope, section, other, place): what each scope depends on and is used by, the strongest ``most`` of each.

    An edge between unlike scopes counts its weight times the confidence of its other end; sums decide, then the name.
    """
    s = n.select("id", S.scope_of(F.array_min("sources")).alias("scope"), F.coalesce("confidence", F.lit(1.0)).alias("c"))
    j = e.select("source_id", "target_id", S.edge_weight(F.col("kind")).alias("w")).join(s.select(F.col("id").alias("source_id"), F.col("scope").alias("a"), F.col("c").alias("ca")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("scope").alias("b"), F.col("c").alias("cb")), "target_id").filter("a <> b")
    out = j.select(F.col("a").alias("scope"), F.lit("depends-on").alias("section"), F.col("b").alias("other"), (F.col("w") * F.col("cb")).alias("v"))
    out = out.unionByName(j.select(F.col("b").alias("scope"), F.lit("used-by").alias("section"), F.col("a").alias("other"), (F.col("w") * F.col("ca")).alias("v")))
    out = out.groupBy("scope", "section", "other").agg(F.sum(F.col("v").cast("decimal(20,9)")).alias("v"))
    w = Window.partitionBy("scope", "section").orderBy(F.col("v").desc(), "other")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("scope", "section", "other", "place")
