"""Drift: how much of what a document speaks about has changed since the document did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators.graph import weighted_drift


def changed_after(log: DataFrame, path: str, at: str, lines: str) -> DataFrame:
    """(path, at, changed, n_later): for every row of a log what later rows of its path changed, and how many they are.

    An interval join by running sums over one sort: the sum of all that comes after is the path's total less what is up
    to a row, rows of equal time together. Pairs are never formed, so a path may hold any number of commits; rows without
    a later one are left out. Sums are decimal.
    """
    one = log.filter(F.col(path).isNotNull() & F.col(at).isNotNull()).groupBy(path, at).agg(F.sum(F.coalesce(lines, F.lit(0)).cast("decimal(20,6)")).alias("l"), F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy(path).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return one.select(path, at, F.sum("l").over(after).cast("double").alias("changed"), F.sum("n").over(after).alias("n_later")).filter("n_later IS NOT NULL")


def numstat(lines: DataFrame, text: str = "value") -> DataFrame:
    """(repo, path, commit, ord, added, removed) of the text of ``git log --numstat --format=commit %H %ct``, one row a line.

    ``lines`` has ``repo``, ``pos`` (the order within it) and the text; one repository's log is read by one task. A binary file (``-``) counts 0 lines. Newest commits come first in such
    a log, so ``ord`` is the time of the commit.
    """
    head = F.regexp_extract(text, r"^commit ([0-9a-f]+) (\d+)$", 1)
    time = F.regexp_extract(text, r"^commit ([0-9a-f]+) (\d+)$", 2)
    open_ = Window.partitionBy("repo").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = lines.select("repo", "pos", text, F.when(head != "", F.struct(head.alias("commit"), time.cast("long").alias("ord"))).alias("c"))
    t = t.withColumn("c", F.last("c", True).over(open_))
    part = F.split(text, "\t", 3)
    count = lambda k: F.when(part[k] == "-", 0).otherwise(part[k].cast("long"))
    return t.filter(F.col(text).rlike(r"^(\d+|-)\t(\d+|-)\t")).select("repo", part[2].alias("path"), "c.commit", "c.ord", count(0).alias("added"), count(1).alias("removed"))


def edge_drifts(n: DataFrame, e: DataFrame, log: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, claimant, drift, w) of the edges that join a code node and one that is none.

    ``log`` has path, ord and changed (added and removed lines), ``sizes`` path and size. The node that is no code is the
    claimant: its first source that is no code was last touched at ``since``; of the first code source of the other end all
    that changed after that, over its size and 1 at most, is the drift. An unknown file, log or size means no drift. The
    direction of an edge is of no matter. An edge without such sources has none and is left out.
    """
    code = _any_code
    ends = n.select("id", F.coalesce(F.exists("sources", code), F.lit(False)).alias("is_code"), F.try_element_at(F.filter("sources", code), F.lit(1)).alias("code_src"), F.try_element_at(F.filter("sources", lambda x: ~code(x)), F.lit(1)).alias("doc_src"))
    side = lambda k: ends.select(*(F.col(c).alias(f"{k}_{c}") for c in ends.columns))
    j = e.select("source_id", "target_id", "kind").join(side("s"), F.col("source_id") == F.col("s_id")).join(side("t"), F.col("target_id") == F.col("t_id")).filter("s_is_code <> t_is_code")
    pick = lambda c, other: F.when(F.col("t_is_code"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")) if not other else F.when(F.col("t_is_code"), F.col(f"t_{c}")).otherwise(F.col(f"s_{c}"))
    j = j.select("source_id", "target_id", "kind", pick("id", False).alias("claimant"), pick("doc_src", False).alias("doc_src"), pick("code_src", True).alias("code_src")).filter("doc_src IS NOT NULL AND code_src IS NOT NULL")
    last = log.groupBy(F.col("path").alias("doc_src")).agg(F.max("ord").alias("since"))
    asked = j.join(last, "doc_src", "left")
    # each distinct (file, moment) is asked once: it takes part in the log of the file as a commit of no lines
    ask = asked.filter("since IS NOT NULL").select(F.col("code_src").alias("path"), F.col("since").alias("ord"), F.lit(0).alias("changed")).distinct()
    churn = changed_after(log.select("path", "ord", "changed").unionByName(ask), "path", "ord", "changed").select(F.col("path").alias("code_src"), F.col("ord").alias("since"), "changed")
    j = asked.join(churn, ["code_src", "since"], "left").join(sizes.select(F.col("path").alias("code_src"), "size"), "code_src", "left")
    drift = S.edge_drift(F.coalesce("changed", F.lit(0.0)), F.coalesce("size", F.lit(0)))
    return j.select("source_id", "target_id", "kind", "claimant", drift.alias("drift"), S.edge_weight(F.col("kind")).alias("w"))


def _any_code(path: Column) -> Column:
    out = F.lit(False)
    for x in S.CODE_EXT:
        out = out | path.endswith(x)
    return out


def drift_pass(n: DataFrame, e: DataFrame, log: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, authority, drift, confidence) of every node: only claimants are charged with the drift of their edges."""
    d = weighted_drift(edge_drifts(n, e, log, sizes).select(F.col("claimant").alias("id"), "w", "drift"), "id")
    j = n.select("id", S.authority(F.col("sources")).alias("authority")).join(d, "id", "left")
    drift = F.coalesce("drift", F.lit(0.0))
    return j.select("id", "authority", drift.alias("drift"), (F.col("authority") * (1 - drift)).alias("confidence"))
