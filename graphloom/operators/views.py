"""Grouped text views, topic matches, documentation gaps, freshness and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.runtime import small_enough


def summaries(chunks: DataFrame) -> DataFrame:
    """(scope, markdown): the summary of each scope."""
    k = F.lower(F.regexp_replace("kind", r"\s+", ""))
    return chunks.filter(k == "summary").groupBy(F.col("source_path").alias("scope")).agg(F.min("chunk_text").alias("markdown"))


def index_lines(s: DataFrame) -> DataFrame:
    """(project, scope, line): the lines of the index view.

    A project with a summary of its own lists its children at depth 1 only; one without lists all of its scopes.
    """
    parts = F.split("scope", "/")
    t = s.withColumn("project", F.element_at(parts, 1)).withColumn("depth", F.size(parts) - 1)
    root = t.filter("depth = 0").select("project", F.lit(True).alias("has_root"))
    t = t.join(root, "project", "left").filter("has_root IS NULL OR depth <= 1")
    line = F.when(F.col("depth") == 0, S.first_sentence(F.col("markdown"))).otherwise(F.concat(F.lit("- **"), "scope", F.lit("** — "), S.first_sentence(F.col("markdown"))))
    return t.select("project", "scope", line.alias("line"))


def index_view(s: DataFrame) -> DataFrame:
    """(project, text): the index of each project, its lines in order of the scopes."""
    lines = index_lines(s).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("scope", "line"))).alias("l"))
    return lines.select("project", F.concat(F.lit("## "), "project", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def scope_entities(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", "kind", "description", F.explode(F.array_distinct(F.transform("sources", S.scope_of))).alias("scope"))


def by_topic(nodes: DataFrame, s: DataFrame, tag: str) -> DataFrame:
    """(scope, n_entities, by_summary): scopes whose entities speak of a topic, else those whose summary does."""
    tag = tag.lower()
    e = scope_entities(nodes)
    has = lambda c: F.coalesce(F.lower(c).contains(tag), F.lit(False))
    m = e.groupBy("scope").agg(F.count_if(has("name") | has("description")).alias("n_entities"))
    j = m.join(s.select("scope", has("markdown").alias("told")), "scope", "full")
    j = j.select("scope", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("told", F.lit(False)).alias("told"))
    return j.filter("n_entities > 0 OR told").select("scope", "n_entities", (F.col("n_entities") == 0).alias("by_summary"))


def doc_gaps(nodes: DataFrame, least: int = 10) -> DataFrame:
    """(scope, n_code): scopes with at least ``least`` code entities and no reference document of their project."""
    code = nodes.filter(F.col("kind").isin("module", "class", "function")).select("id", F.explode("sources").alias("path")).filter(S.is_code_path(F.col("path")))
    n = code.groupBy(S.scope_of(F.col("path")).alias("scope")).agg(F.count_distinct("id").alias("n_code")).filter(F.col("n_code") >= least)
    refs = nodes.select(F.explode("sources").alias("path")).filter(S.classify_source(F.col("path")) == "REFERENCE").select(F.substring_index("path", "/", 1).alias("project")).distinct()
    return n.withColumn("project", F.substring_index("scope", "/", 1)).join(refs, "project", "left_anti").select("scope", "n_code")


def scope_summary(nodes: DataFrame, first: int = 5) -> DataFrame:
    """(scope, n_entities, n_classes, n_functions, names): counts and the first public names of each scope."""
    e = scope_entities(nodes)
    public = ~F.substring_index("name", ".", -1).startswith("_")
    w = Window.partitionBy("scope", "public").orderBy("name", "id")
    r = e.withColumn("public", public).withColumn("r", F.row_number().over(w))
    return r.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_if(F.col("kind") == "class").alias("n_classes"),
        F.count_if(F.col("kind") == "function").alias("n_functions"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("public") & (F.col("r") <= first), F.col("name")))), ", ").alias("names"),
    )


def blobs(docs: DataFrame) -> DataFrame:
    """(digest, n_copies, first_id): contents by their address."""
    return docs.filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("doc_id").alias("n_copies"), F.min("doc_id").alias("first_id"))


def tree_commit(docs: DataFrame) -> DataFrame:
    """(project, graph_commit): the ordered fold hash of each project's files, by the parts of their paths.

    Only paths and content hashes are gathered, one project a row.
    """
    f = docs.filter("text IS NOT NULL AND source_path IS NOT NULL").groupBy("source_path").agg(F.min(F.struct("doc_id", F.sha2("text", 256).alias("h"))).alias("x"))
    parts = F.split("source_path", "/")
    g = f.groupBy(F.element_at(parts, 1).alias("project")).agg(F.array_sort(F.collect_list(F.struct(parts.alias("p"), F.col("source_path").alias("s"), F.col("x.h").alias("h")))).alias("l"))
    return g.select("project", F.sha2(F.array_join(F.transform("l", lambda x: F.concat(x["s"], x["h"])), ""), 256).alias("graph_commit"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): paths that were added, removed or modified between two snapshots of (path, digest)."""
    j = new.select("path", F.col("digest").alias("n")).join(old.select("path", F.col("digest").alias("o")), "path", "full")
    c = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return j.select("path", c.alias("change")).filter("change IS NOT NULL")


def ground_concepts(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(node_id, id): entities whose normalised name or alias is a label of a concept."""
    labels = concepts.select("node_id", F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("l")).select("node_id", S.normalize_name(F.col("l")).alias("k")).filter("k <> ''").distinct()
    names = nodes.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("id", S.normalize_name(F.col("n")).alias("k")).filter("k <> ''").distinct()
    return names.join(labels, "k").select("node_id", "id").distinct()


def concept_mentions(docs: DataFrame, concepts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(node_id, doc_id): documents in which a label of a concept stands, word for word; case and marks do not matter.

    Texts become runs of as many words as labels have, which are looked up by an equal key; labels are broadcast if there are
    ``most`` or less of them. Blank labels and null texts name nothing.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    labels = concepts.select("node_id", F.explode(F.concat(F.array("pref_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))).alias("l")).select("node_id", words(F.col("l")).alias("w"))
    labels = labels.filter(F.size("w") > 0).select("node_id", F.array_join("w", " ").alias("k"), F.size("w").alias("n")).distinct()
    sizes = sorted(r.n for r in labels.select("n").distinct().collect())
    if not sizes:
        return docs.select("doc_id").limit(0).crossJoin(labels.select("node_id").limit(0)).select("node_id", "doc_id")
    few = F.broadcast(labels) if small_enough(labels, most) else labels
    t = docs.filter("text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.array_distinct(F.concat(*(F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in sizes)))
    return t.select("doc_id", F.explode(runs).alias("k")).join(few.drop("n"), "k").select("node_id", "doc_id").distinct()


def token_frequencies(nodes: DataFrame) -> DataFrame:
    """(token, n_entities): in how many entities' names each identifier word occurs."""
    return nodes.select("id", F.explode(S.identifier_tokens(F.col("name"))).alias("token")).groupBy("token").agg(F.count_distinct("id").alias("n_entities"))


def pinned_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, label, content) of blocks between ``<!-- pin: label -->`` and ``<!-- /pin -->``; of a label the last counts."""
    found = F.regexp_extract_all(text_col, F.lit(r"(?s)<!-- pin(?::\s*(\S+))?\s*-->(.*?)<!-- /pin -->"), 0)
    b = docs.select(id_col, F.posexplode(found).alias("pos", "b"))
    b = b.select(id_col, "pos", F.nullif(F.regexp_extract("b", r"<!-- pin:\s*(\S+)", 1), F.lit("")).alias("label"), F.trim(F.regexp_extract("b", r"(?s)-->(.*?)<!-- /pin", 1)).alias("content"))
    w = Window.partitionBy(id_col, "label").orderBy(F.col("pos").desc())
    return b.withColumn("r", F.when(F.col("label").isNull(), 1).otherwise(F.row_number().over(w))).filter("r = 1").drop("r")
