"""What surrounds extraction: parsing replies, budgets of context, evidence spans, composed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_REPLY = "entities array<struct<name:string,kind:string,description:string>>, relationships array<struct<source:string,target:string,kind:string,description:string>>"


def parse_replies(replies: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of JSON replies, with or without a code fence; rows without a name, ends or kind are left out.

    Kinds are in lower case. A reply that is no JSON gives no rows.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(text_col), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    r = replies.select(id_col, F.from_json(bare, _REPLY).alias("r"))
    full = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    e = r.select(id_col, F.explode("r.entities").alias("x")).select(id_col, "x.*").filter(full("name") & full("kind")).withColumn("kind", F.lower("kind"))
    k = r.select(id_col, F.explode("r.relationships").alias("x")).select(id_col, "x.*").filter(full("source") & full("target") & full("kind")).withColumn("kind", F.lower("kind"))
    return e, k


def budgeted(rows: DataFrame, group: str, order: list, text_col: str, most_chars: int) -> DataFrame:
    """Rows of each group in order, up to the first that would overrun ``most_chars`` (a line end a row counts)."""
    w = Window.partitionBy(group).orderBy(*order)
    used = F.sum(F.char_length(text_col) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("used", used)
    over = F.min(F.when(F.col("used") > most_chars, F.col("used"))).over(Window.partitionBy(group))
    return r.withColumn("over", over).filter(F.col("over").isNull() | (F.col("used") < F.col("over"))).drop("over")


def evidence(files: DataFrame, patterns: list[str], most: int = 8) -> DataFrame:
    """(path, line, snippet): lines of code that match a pattern, without comments and docstrings; once a snippet of 120, first ``most``.

    A docstring goes from a line that opens triple quotes to the one that closes them: lines behind an odd number of them are in one.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "l")).withColumn("t", F.trim("l"))
    quotes = F.size(F.split("l", r"\"\"\"|'''")) - 1
    before = F.coalesce(F.sum(quotes).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("inside", before % 2 == 1).filter("NOT inside")
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("l").rlike(p)
    lines = lines.filter(hit & ~F.col("t").rlike(r"^(#|//|\*|/\*|\"\"\"|''')")).withColumn("snippet", F.substring("t", 1, 120))
    once = lines.groupBy("path", "snippet").agg(F.min("line").alias("line"))
    w = Window.partitionBy("path").orderBy("line")
    return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("path", (F.col("line") + 1).alias("line"), "snippet")


def compose_vocabulary(base: DataFrame, portfolio: DataFrame, project: DataFrame) -> DataFrame:
    """Kinds of three layers (kind, family, definition, weight): structural ones are locked to the base, others only added.

    Of a semantic kind the first layer that has it counts.
    """
    every = base.withColumn("layer", F.lit(0)).unionByName(portfolio.withColumn("layer", F.lit(1))).unionByName(project.withColumn("layer", F.lit(2)))
    ok = (F.col("layer") == 0) | (F.col("family") != "structural")
    w = Window.partitionBy("kind").orderBy("layer", "definition")
    return every.filter(ok).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def compose_concepts(layers: list[DataFrame]) -> DataFrame:
    """Concepts (namespace, key, ...) of several layers: the last layer that has one counts."""
    every = layers[0].withColumn("layer", F.lit(0))
    for k, layer in enumerate(layers[1:], 1):
        every = every.unionByName(layer.withColumn("layer", F.lit(k)))
    w = Window.partitionBy("namespace", "key").orderBy(F.col("layer").desc())
    return every.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r", "layer")


def rollup_ancestors(rows: DataFrame, scope_col: str) -> DataFrame:
    """(scope, n): rows at or below every ancestor of their scope (an extension)."""
    parts = F.split(scope_col, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.select(F.explode(up).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def hotspots(nodes: DataFrame, value_col: str, tenths: int = 1) -> DataFrame:
    """Nodes in the top ``tenths`` tenths of a value (an extension), by an exact cut at its nearest-rank quantile."""
    from graphloom.operators.graph import nearest_rank_quantiles

    one = nodes.withColumn("__all", F.lit(1))
    cut_at = nearest_rank_quantiles(one, "__all", value_col, (1 - tenths / 10,)).select(F.col(f"q{int((1 - tenths / 10) * 100)}").alias("__cut"))
    return nodes.crossJoin(F.broadcast(cut_at)).filter(F.col(value_col) >= F.col("__cut")).drop("__cut")
