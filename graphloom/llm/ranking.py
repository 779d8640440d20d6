"""One ranking from several scores of unlike scales: normal scores of empirical percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import cut, salted_join

#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Inverse of the normal distribution for 0 < p < 1, to about 1e-9."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    return (
        F.when(p < TAIL, _poly(low, C) / _poly(low, (*D, 1.0)))
        .when(p > 1 - TAIL, -_poly(high, C) / _poly(high, (*D, 1.0)))
        .otherwise(_poly(r, A) * q / _poly(r, (*B, 1.0)))
    )


def percentiles(long: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """``long`` (g, k, value and further columns) with ``p``: the share of its group below each value plus half of its ties.

    Null values are below every other and tie with each other. Equal values are counted first, so ties of any size are
    one row; the counts are split into ranges of equal size in the order of group, score and value, whatever the scale,
    summed by range and then within each, so a group of any size is spread over many tasks. The ranges are written to a
    checkpoint, as their borders come from a sample and would differ if a lost task drew them anew.
    """
    long = long.withColumn("void", F.col("value").isNull()).withColumn("value", F.coalesce("value", F.lit(0.0)))
    counts = long.groupBy("g", "k", "void", "value").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.repartitionByRange("g", "k", ~F.col("void"), "value").withColumn("band", F.spark_partition_id())
    counts = cut(counts)
    bands = counts.groupBy("g", "k", "band").agg(F.sum("c").alias("size"))
    every = Window.partitionBy("g", "k")
    before = every.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("g", "k", "band", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("under"), F.sum("size").over(every).alias("n"))
    same = Window.partitionBy("g", "k", "band").orderBy(~F.col("void"), "value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("c").over(same), F.lit(0)))
    p = (F.col("under") + F.col("inside") + F.col("c") / 2) / F.col("n")
    ranked = counts.join(bands, ["g", "k", "band"]).select("g", "k", "void", "value", p.alias("p"))
    return salted_join(long, ranked, ["g", "k", "void", "value"], "inner", hot_rows)


def fuse(items: DataFrame, grp: str, item: str, scores: Sequence[tuple[str, bool, float]], hot_rows: int = 200_000) -> DataFrame:
    """(grp, item, score): the weighted mean of the normal scores of each item within its group.

    ``scores`` names columns, whether high is good, and their weights. Each is turned into its percentile within the
    group, ties averaged, and through the inverse normal distribution, so neither range nor outliers of a score matter.
    A null or NaN score counts as the worst. ``items`` must have a row an item and group; extra columns are left out; an
    empty table gives no row. Between the first and last step groups and items travel as hashes of 64 and 128 bits.
    """
    total = sum(w for _, _, w in scores)
    cells = []
    for k, (name, high, _) in enumerate(scores):
        v = F.col(name).cast("double")
        v = F.when(F.isnan(v), None).otherwise((v if high else -v) + F.lit(0.0))
        cells.append(F.struct(F.lit(k).cast("byte").alias("k"), v.alias("value")))
    marks = (F.xxhash64(grp).alias("g"), F.xxhash64(grp, item).alias("i1"), F.xxhash64(F.lit(5), item, grp).alias("i2"))
    weights = F.element_at(F.array(*(F.lit(w / total) for _, _, w in scores)), F.col("k").cast("int") + 1)
    long = items.select(*marks, F.explode(F.array(*cells)).alias("s")).select("g", "i1", "i2", "s.k", "s.value")
    z = percentiles(long, hot_rows).select("i1", "i2", (probit(F.col("p")) * weights).alias("z"))
    z = z.groupBy("i1", "i2").agg(F.round(F.sum("z"), 9).alias("score"))
    return items.select(F.col(grp), F.col(item), *marks[1:]).join(z, ["i1", "i2"]).select(grp, item, "score")


def best(ranked: DataFrame, grp: str, item: str, k: int) -> DataFrame:
    """The ``k`` best items of each group with their ``position``; ties go to the smaller item."""
    w = Window.partitionBy(grp).orderBy(F.col("score").desc(), F.col(item))
    return ranked.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def entity_scores(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(graph_commit, id, source_tier, centrality, weight, drift): one row an entity and commit.

    weight is the mean over the edges that point at it, drift over those that leave it; repeated edges (rel_id) count
    once, ids are compared in one spelling. Means are partial sums before any shuffle, whatever share one entity has.
    """
    spelled = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^sha256:\s*", "")
    e = entities.groupBy("graph_commit", spelled(F.col("id")).alias("id")).agg(F.max(F.nanvl("source_tier", F.lit(None))).alias("source_tier"), F.max(F.nanvl("centrality", F.lit(None))).alias("centrality"))
    # edges need their ends for comparison only, so those travel as hashes of 128 bits
    end = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(spelled(F.col(c))).alias("h1"), F.xxhash64(F.lit(5), spelled(F.col(c))).alias("h2")))
    r = relationships.select("rel_id", end("source_id").alias("s"), end("target_id").alias("t"), "weight", "drift").distinct()
    ends = F.array(F.struct(F.col("t").alias("e"), F.col("weight").alias("w"), F.lit(None).cast("double").alias("d")), F.struct(F.col("s").alias("e"), F.lit(None).cast("double").alias("w"), F.col("drift").alias("d")))
    sums = r.select(F.explode(ends).alias("x")).filter("x.e IS NOT NULL").groupBy(F.col("x.e.h1").alias("h1"), F.col("x.e.h2").alias("h2"))
    sums = sums.agg(F.round(F.avg("x.w"), 9).alias("weight"), F.round(F.avg("x.d"), 9).alias("drift"))
    e = e.withColumns({"h1": F.xxhash64("id"), "h2": F.xxhash64(F.lit(5), "id")})
    return e.join(sums, ["h1", "h2"], "left").select("graph_commit", "id", "source_tier", "centrality", "weight", "drift")


def entity_order(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(graph_commit, id, score): the entities of each commit over four scores of equal say; low drift is good."""
    s = cut(entity_scores(entities, relationships))
    return fuse(s, "graph_commit", "id", [("source_tier", True, 1.0), ("centrality", True, 1.0), ("weight", True, 1.0), ("drift", False, 1.0)])


def probit_sql(p: str) -> str:
    """The same approximation as text, for the SQL check."""
    poly = lambda x, cs: "(" * len(cs) + f"{cs[0]!r}::DOUBLE)" + "".join(f"*{x}+({c!r}::DOUBLE))" for c in cs[1:])
    lo, hi, q = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-{p}))", f"({p}-0.5)"
    return (
        f"CASE WHEN {p} < {TAIL} THEN {poly(lo, C)}/{poly(lo, (*D, 1.0))} WHEN {p} > {1 - TAIL} THEN -{poly(hi, C)}/{poly(hi, (*D, 1.0))}"
        f" ELSE {poly(f'({q}*{q})', A)}*{q}/{poly(f'({q}*{q})', (*B, 1.0))} END"
    )
