"""Similarity search over chunks, reranking by graph proximity, expansion along edges, and budgeted assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.runtime import cut

#: Hits, seeds, decay of a hop, most expanded rows, and their least score against the weakest hit.
K, SEEDS, DECAY, EXPANSION, RATIO = 10, 3, 0.6, 5, 0.5


def search(chunks: DataFrame, query: list[float], k: int = K, scope: str | None = None, repeats: int = 8) -> DataFrame:
    """The ``k`` most similar chunks, once an id: id, score, rank from 1. Ties go to the smaller id.

    The query is one vector, so it is a literal of the plan. Rows are scored where they lie, and each task keeps its best
    alone; vectors are not shuffled. An id counts by its best row. Equal rows of an id are one; of unlike ones there may be
    ``repeats`` for each id that a task keeps.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = chunks.filter(S.in_scope(F.col("scope"), scope) & F.col("id").isNotNull()).select("id", S.cosine(F.col("embedding"), q).alias("score"), F.spark_partition_id().alias("task"))
    best = Window.partitionBy("task").orderBy(F.col("score").desc(), "id")
    few = scored.withColumn("r", F.dense_rank().over(best)).filter(F.col("r") <= k * repeats)
    hits = few.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def with_fallback(scoped: DataFrame, everywhere: DataFrame) -> DataFrame:
    """The scoped result, or the unscoped one where that is empty."""
    n = scoped.agg(F.count(F.lit(1)).alias("n"))
    return scoped.withColumn("fallback", F.lit(False)).unionByName(everywhere.crossJoin(F.broadcast(n)).filter("n = 0").drop("n").withColumn("fallback", F.lit(True)))


def rerank(hits: DataFrame, nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(id, score, confidence, proximity, find_score): similarity times confidence times closeness to the first hits.

    Proximity is 1 plus the best weight of an edge to one of the first SEEDS hits that are entities. A hit without an
    entity has confidence 1 and proximity 1.
    """
    h = hits.join(nodes.select("id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(True).alias("is_entity")), "id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    seeds = h.filter((F.col("rank") <= SEEDS) & F.col("is_entity")).select(F.col("id").alias("seed"))
    near = adjacency.join(F.broadcast(seeds), F.col("a") == F.col("seed")).groupBy("b").agg(F.max(S.edge_weight(F.col("kind"))).alias("w"))
    j = h.join(near, h["id"] == near["b"], "left")
    prox = 1 + F.coalesce("w", F.lit(0.0))
    return j.select("id", "score", "confidence", prox.alias("proximity"), (F.col("score") * F.col("confidence") * prox).alias("find_score"), F.coalesce("is_entity", F.lit(False)).alias("is_entity"))


def expand(ranked: DataFrame, nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Direct hits and the neighbours of the best of them: id, find_score, direct; best first is (find_score, direct).

    A neighbour scores its seed's score times the edge's weight, the decay and its own confidence; it must reach RATIO
    of the weakest hit, is taken once by its best edge, and at most EXPANSION are taken.
    """
    ranked = cut(ranked)  # some ten rows, which are read four times
    best = ranked.filter("is_entity").orderBy(F.col("find_score").desc(), "id").limit(SEEDS).select(F.col("id").alias("seed"), F.col("find_score").alias("s"))
    weakest = ranked.agg(F.min("find_score").alias("weakest"))
    more = adjacency.join(F.broadcast(best), F.col("a") == F.col("seed")).join(F.broadcast(ranked.select(F.col("id").alias("b"))), "b", "left_anti")
    more = more.join(nodes.select(F.col("id").alias("b"), F.coalesce("confidence", F.lit(1.0)).alias("c")), "b")
    more = more.groupBy("b").agg(F.max(F.col("s") * S.edge_weight(F.col("kind")) * DECAY * F.col("c")).alias("x")).crossJoin(F.broadcast(weakest)).filter(F.col("x") >= RATIO * F.col("weakest"))
    more = more.orderBy(F.col("x").desc(), "b").limit(EXPANSION)
    return ranked.select("id", "find_score", F.lit(True).alias("direct")).unionByName(more.select(F.col("b").alias("id"), F.col("x").alias("find_score"), F.lit(False).alias("direct")))


def assemble(rows: DataFrame, order: list, text: str, path: str, max_tokens: int) -> DataFrame:
    """(answer): texts with their citations, in order, as long as the budget of four characters a token lasts.

    The first is always kept. ``rows`` is the result of a search, so it is small.
    """
    w = Window.orderBy(*order)
    entry = F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n> Source: `"), F.coalesce(path, F.lit("")), F.lit("`\n"))
    e = rows.withColumn("entry", entry).withColumn("n", F.row_number().over(w)).withColumn("used", F.sum(F.char_length("entry")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = e.filter((F.col("n") == 1) | (F.col("used") <= 4 * max_tokens))
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]), "\n").alias("answer"))
