"""Registered queries of the training-data operators, and the SQL that they are checked against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import handwritten, leakage, matching, neighbours, ranking, residue, secrets, split, tokenize
from graphloom.runtime import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Where the vocabularies of public tokenizers are; a parameter of the environment.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(spread(table(spark, d, "chunks"))).select("source_path")


@query("p1_reasons")
def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the files that are not hand-written, by reason."""
    return handwritten.not_handwritten(spread(table(spark, d, "chunks"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


@query(
    "p2_found",
    r"""SELECT DISTINCT c.id FROM chunks c JOIN chunk_limits l ON lower(regexp_replace(c.kind, '\s+', '', 'g')) = lower(regexp_replace(l.kind, '\s+', '', 'g'))
    WHERE length(c.chunk_text) > l.max_chars""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_ids(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


@query("p2_pieces")
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


@query(
    "p2_invariants",
    r"""SELECT c.id, max(length(c.chunk_text)) AS n_chars, TRUE AS within, TRUE AS covering, TRUE AS overlapping FROM chunks c JOIN chunk_limits l ON lower(regexp_replace(c.kind, '\s+', '', 'g')) = lower(regexp_replace(l.kind, '\s+', '', 'g'))
    WHERE length(c.chunk_text) > l.max_chars GROUP BY 1""",
)
def p2_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of every oversized chunk."""
    return split.piece_report(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = matching.matches(table(spark, d, "extracted_code"), table(spark, d, "extracted_doc"))
    return m.select(F.least("code_id", "doc_id").alias("id_a"), F.greatest("code_id", "doc_id").alias("id_b"))


@query("p3_matches")
def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their confidence."""
    return matching.matches(table(spark, d, "extracted_code"), table(spark, d, "extracted_doc"))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_lines(spread(table(spark, d, "chunks")))


@query("p5_redacted")
def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All chunks, once an id, without their secrets."""
    return secrets.redact_once(spread(table(spark, d, "chunks").select("id", "chunk_text")))


_ORDER = r"""
WITH e AS (SELECT graph_commit, regexp_replace(lower(trim(id)), '^sha256:\s*', '') AS id, max(source_tier) AS source_tier, max(CASE WHEN isnan(centrality) THEN NULL ELSE centrality END) AS centrality FROM entities GROUP BY 1, 2),
r AS (SELECT DISTINCT rel_id, regexp_replace(lower(trim(source_id)), '^sha256:\s*', '') AS s, regexp_replace(lower(trim(target_id)), '^sha256:\s*', '') AS t, weight, drift FROM relationships),
i AS (SELECT t AS id, round(avg(weight), 9) AS weight FROM r GROUP BY 1), o AS (SELECT s AS id, round(avg(drift), 9) AS drift FROM r GROUP BY 1),
s AS (SELECT e.*, weight, -drift AS still FROM e LEFT JOIN i USING (id) LEFT JOIN o USING (id)),
p AS (SELECT graph_commit, id, """ + ", ".join(
    f"((rank() OVER (PARTITION BY graph_commit ORDER BY {c} NULLS FIRST) - 1) + (count(*) OVER (PARTITION BY graph_commit, {c})) / 2.0) / count(*) OVER (PARTITION BY graph_commit) AS p_{c}" for c in ("source_tier", "centrality", "weight", "still")
) + r""" FROM s),
z AS (SELECT graph_commit, id, round(0.25 * (""" + ") + 0.25 * (".join(ranking.probit_sql(f"p_{c}") for c in ("source_tier", "centrality", "weight", "still")) + r"""), 9) AS score FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY graph_commit ORDER BY score DESC, id) AS position FROM z)
"""


@query("p6_found", _ORDER + "SELECT graph_commit, id FROM n WHERE position <= 3")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    order = ranking.entity_order(table(spark, d, "entities"), table(spark, d, "relationships"))
    return ranking.best(order, "graph_commit", "id", 3).select("graph_commit", "id")


@query("p6_order", _ORDER + "SELECT graph_commit, id, round(score, 6) AS score FROM n")
def p6_order(spark: SparkSession, d: str) -> DataFrame:
    """The whole order: every entity with its score."""
    order = ranking.entity_order(table(spark, d, "entities"), table(spark, d, "relationships"))
    return order.select("graph_commit", "id", F.round("score", 6).alias("score"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(spread(table(spark, d, "chunks").select("id", "embedding")))


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(spread(table(spark, d, "documents")), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_tasks")).select("doc_id", "task_id")


@query("p9_leaks")
def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with the words repeated and the answers held, texts in other words included."""
    return leakage.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_tasks"), answer_col="gold")


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(spread(table(spark, d, "documents"))).select("doc_id")


@query("p10_reasons")
def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(spread(table(spark, d, "documents"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"))
