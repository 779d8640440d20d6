"""Nodes, edges and what is computed over them: adjacency, centrality, drift, confidence, containment, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.orphans import canonical_id
from graphloom.runtime import cut


#: After every time that a table may hold; where a row without a time stands.
LATE = "9999-01-01"


def nodes(entities: DataFrame) -> DataFrame:
    """One row an id, in one spelling: of repeated rows the one that was seen first, as a whole."""
    cols = ["name", "kind", "description", "aliases", "sources", "kinds", "source_tier", "centrality", "confidence", "def_line", "graph_commit"]
    first = F.min_by(F.struct(*cols), F.coalesce(F.col("seen_at").cast("timestamp_ntz"), F.lit(LATE).cast("timestamp_ntz"))).alias("f")
    return entities.withColumn("id", canonical_id(F.col("id"))).groupBy("id").agg(first).select("id", "f.*")


def edges(relationships: DataFrame) -> DataFrame:
    """Distinct (source_id, target_id, kind) without loops and dangling ends; the first row by rel_id gives the rest."""
    e = relationships.select(canonical_id(F.col("source_id")).alias("source_id"), canonical_id(F.col("target_id")).alias("target_id"), "kind", "rel_id", "weight", "drift", "description", "source_line")
    e = e.filter("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")
    first = F.min_by(F.struct("weight", "drift", "description", "source_line"), F.col("rel_id"))
    return e.groupBy("source_id", "target_id", "kind").agg(F.min("rel_id").alias("rel_id"), first.alias("f")).select("source_id", "target_id", "kind", "rel_id", "f.*")


def adjacency(e: DataFrame) -> DataFrame:
    """(a, b, kind, weight): every edge from both of its ends."""
    return e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "kind", "weight").unionByName(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "kind", "weight"))


def degrees(e: DataFrame) -> DataFrame:
    return adjacency(e).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("b").alias("n_neighbours"))


def centrality(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, n_docs, centrality): distinct source documents that point at a node by central edges, over the maximum."""
    into = e.filter(F.col("kind").isin(*S.CENTRAL_KINDS)).join(n.select(F.col("id").alias("source_id"), F.explode("sources").alias("doc")), "source_id")
    c = into.groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("doc").alias("n_docs"))
    top = c.agg(F.max("n_docs").alias("top"))
    return n.select("id").join(c, "id", "left").crossJoin(F.broadcast(top)).select("id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce(F.col("n_docs") / F.col("top"), F.lit(0.0)).alias("centrality"))


def weighted_drift(pairs: DataFrame, key: str) -> DataFrame:
    """(key, drift): the mean drift by weight of (key, w, drift). Sums are decimal, so their order does not matter."""
    exact = lambda c: F.col(c).cast("decimal(18,9)")
    d = pairs.filter("drift IS NOT NULL").groupBy(key).agg(F.sum((exact("w") * exact("drift")).cast("decimal(28,14)")).cast("double").alias("wd"), F.sum(exact("w")).cast("double").alias("w"))
    return d.select(key, F.when(F.col("w") > 0, F.col("wd") / F.col("w")).otherwise(0.0).alias("drift"))


def confidence(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, authority, drift, confidence): authority less the weighted mean drift of the edges that leave a node."""
    d = weighted_drift(e.select(F.col("source_id").alias("id"), S.edge_weight(F.col("kind")).alias("w"), "drift"), "id")
    j = n.select("id", S.authority(F.col("sources")).alias("authority")).join(d, "id", "left")
    drift = F.coalesce("drift", F.lit(0.0))
    return j.select("id", "authority", drift.alias("drift"), (F.col("authority") * (1 - drift)).alias("confidence"))


def places(c: Column, digits: int) -> Column:
    """``c`` rounded as a decimal of nine places, so that what lies on a border does so on every engine."""
    return F.round(c.cast("decimal(20,9)"), digits).cast("double")


def parents(e: DataFrame) -> DataFrame:
    """(id, parent): the first node that contains each."""
    return e.filter("kind = 'contains'").groupBy(F.col("target_id").alias("id")).agg(F.min_by("source_id", "rel_id").alias("parent"))


def depths(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, depth): steps of containment above each node; nodes on a cycle, which have no top, get none.

    Goes on until a level is empty, which it is at last, as every node has one parent and no level repeats another's.
    """
    p = cut(parents(e))
    level = cut(n.select("id").join(p, "id", "left_anti").withColumn("depth", F.lit(0)))
    done, k = [level], 0
    while done[-1].take(1):
        k += 1
        done.append(cut(p.join(done[-1].select(F.col("id").alias("parent")), "parent").select("id", F.lit(k).alias("depth"))))
    return reduce(DataFrame.unionByName, done)


def projects(n: DataFrame) -> DataFrame:
    """(id, project): the first segment of the first source in order."""
    return n.select("id", F.substring_index(F.array_min("sources"), "/", 1).alias("project"))


def cross_edges(n: DataFrame, e: DataFrame) -> DataFrame:
    """Edges with the projects of both ends and ``cross``: both known and unlike."""
    p = projects(n)
    j = e.join(p.select(F.col("id").alias("source_id"), F.col("project").alias("source_project")), "source_id").join(p.select(F.col("id").alias("target_id"), F.col("project").alias("target_project")), "target_id")
    return j.withColumn("cross", F.coalesce(F.col("source_project") != F.col("target_project"), F.lit(False)))


def file_nodes(n: DataFrame) -> DataFrame:
    """(path, scope, n_entities, anchor): every source file with the entities it gives; the anchor is its module, if any."""
    f = n.select("id", "kind", F.explode("sources").alias("path"))
    return f.groupBy("path").agg(F.count_distinct("id").alias("n_entities"), F.coalesce(F.min(F.when(F.col("kind") == "module", F.col("id"))), F.min("id")).alias("anchor")).withColumn("scope", S.scope_of(F.col("path")))


def export_nodes(n: DataFrame, slim: bool = False) -> DataFrame:
    """(id, json): nodes as JSON documents; slim ones without description and scores."""
    cols = ["id", "name", "kind", "sources", "kinds", "confidence"] + ([] if slim else ["description", "centrality", "source_tier"])
    return n.select("id", F.to_json(F.struct(*cols)).alias("json"))


def scope_pairs(n: DataFrame, e: DataFrame) -> DataFrame:
    """(scope_a, scope_b, n_edges): edges between unlike scopes of their ends' first sources, a < b."""
    s = n.select("id", S.scope_of(F.array_min("sources")).alias("scope"))
    j = e.join(s.select(F.col("id").alias("source_id"), F.col("scope").alias("x")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("scope").alias("y")), "target_id").filter("x <> y")
    return j.groupBy(F.least("x", "y").alias("scope_a"), F.greatest("x", "y").alias("scope_b")).agg(F.count(F.lit(1)).alias("n_edges"))


def scope_density(n: DataFrame, e: DataFrame) -> DataFrame:
    """(n_edges, n_cross, density): edges between nodes, those whose ends' scopes are more than one, and their share.

    All scopes of both ends count, so an edge inside a node that lies in two scopes is one of them. Null without edges.
    """
    s = n.select("id", F.coalesce(F.array_distinct(F.transform("sources", S.scope_of)), F.array().cast("array<string>")).alias("s"))
    j = e.join(s.select(F.col("id").alias("source_id"), F.col("s").alias("a")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("s").alias("b")), "target_id")
    d = j.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.size(F.array_union("a", "b")) > 1).alias("n_cross"))
    return d.withColumn("density", F.when(F.col("n_edges") > 0, F.col("n_cross") / F.col("n_edges")))


def name_degrees(raw: DataFrame) -> DataFrame:
    """(name, degree): how often a name is an end of an extracted edge; repeated rows count once."""
    r = raw.select("raw_id", "source_name", "target_name").distinct()
    ends = r.select(F.explode(F.array("source_name", "target_name")).alias("name")).filter("name IS NOT NULL")
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def pagerank(n: DataFrame, e: DataFrame, tolerance: float = 1e-3, most: int = 200, damping: float = 0.85) -> DataFrame:
    """(id, rank): importance over structural edges, normalised to 1; dangling mass is dropped.

    Rounds go on until no rank changes by more than ``tolerance``; ``most`` rounds without that are an error. Each round
    pre-aggregates the shares per target; lineage is cut by reliable checkpoints.
    """
    links = e.select("source_id", "target_id").distinct()
    out = links.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    links = cut(links.join(out, "source_id"))
    rank = n.select("id").distinct().withColumn("rank", F.lit(1.0))
    for _ in range(most):
        got = links.join(rank, F.col("source_id") == F.col("id")).groupBy(F.col("target_id").alias("t")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        now = F.lit(1 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        rank = cut(rank.join(got, F.col("id") == F.col("t"), "left").select("id", now.alias("rank"), F.abs(now - F.col("rank")).alias("change")))
        if (rank.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise ValueError(f"no rank within {tolerance} after {most} rounds")
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("id", (F.col("rank") / F.col("top")).alias("rank"))


def nearest_rank_quantiles(df: DataFrame, group: str, value: str, points: tuple[float, ...]) -> DataFrame:
    """(group, n, q...) where a quantile is the value at place min(n - 1, floor(p * n)) from 0; no interpolation.

    Equal values are counted first, so a group is as large as its distinct values.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    return c.groupBy(group).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > at(p), F.col(value))).alias(f"q{int(p * 100)}") for p in points))
