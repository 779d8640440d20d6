"""References to records that do not exist, told apart as missing, deleted or late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import salted_join

ARTICLES = ("the", "a", "an")


def canonical_id(c: Column) -> Column:
    """One spelling of an id: no surrounding blanks, lower case, without an optional ``sha256:`` in front."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), r"^sha256:\s*", "")


def name_key(c: Column) -> Column:
    """A name reduced to its a-z0-9 words, in lower case, without articles, written together."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES)), "")


def parent_intervals(parents: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """(key, born, died): when a parent id is valid. Of repeated parents the earliest birth and earliest death count.

    ``parents`` has id, seen_at and deleted_at; ids of ``always`` (column id) are valid at any time, also where
    the id is a parent as well. A null seen_at means born at no known time and counts as always there.
    """
    iv = (
        parents.select(canonical_id(F.col("id")).alias("key"), "seen_at", "deleted_at")
        .filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.min("seen_at").alias("born"),
            F.min("deleted_at").alias("died"),
        )
        .withColumn("ever", F.lit(False))
    )
    if always is not None:
        hubs = always.select(canonical_id(F.col("id")).alias("key")).filter("key IS NOT NULL").distinct()
        hubs = hubs.select("key", F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("died"), F.lit(True).alias("ever"))
        iv = (
            iv.withColumn("born", F.col("born").cast("timestamp_ntz"))
            .withColumn("died", F.col("died").cast("timestamp_ntz"))
            .unionByName(hubs)
            .groupBy("key")
            .agg(F.min("born").alias("born"), F.min("died").alias("died"), F.max("ever").alias("ever"))
        )
    return iv


def orphan_ids(refs: DataFrame, intervals: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """References by id that hold no valid parent at their time.

    ``refs`` has table_name, row_id, field, ref and seen_at, one row a reference. Both sides are partitioned and
    sorted by the canonical key and merged in one pass; a key with more than ``hot_rows`` references is salted.
    Result: table_name, row_id, field, seen_at and reason, which is ``missing`` (no such parent at any time),
    ``late`` (born after the reference) or ``deleted`` (died at or before it). A null reference is none; an empty
    one is missing. A null seen_at can be neither late nor deleted.
    """
    keyed = refs.filter("ref IS NOT NULL").select("table_name", "row_id", "field", "seen_at", canonical_id(F.col("ref")).alias("key"))
    j = salted_join(keyed, intervals, "key", "left", hot_rows)
    at = F.col("seen_at").cast("timestamp_ntz")
    reason = (
        F.when(F.col("ever").isNull(), "missing")
        .when(F.col("ever"), None)
        .when(F.col("born").cast("timestamp_ntz") > at, "late")
        .when(F.col("died").cast("timestamp_ntz") <= at, "deleted")
    )
    return j.withColumn("reason", reason).filter("reason IS NOT NULL").select("table_name", "row_id", "field", "seen_at", "reason")


def entity_name_keys(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, names): every source path and every normalised name or alias of the entities, once each."""
    src = entities.select(F.explode("sources").alias("s")).select(strip_path(F.col("s")).alias("key")).filter("key IS NOT NULL AND key <> ''").distinct()
    every = F.concat(F.array("name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    names = entities.select(F.explode(every).alias("n")).select(name_key(F.col("n")).alias("key")).filter("key IS NOT NULL AND key <> ''").distinct()
    return src, names


def strip_path(c: Column) -> Column:
    """A path without surrounding blanks and a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^(\./)+", "")


def orphan_names(refs: DataFrame, entities: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """References by name that name no entity at any time; columns as of :func:`orphan_ids`, reason ``missing``.

    A name is tried as a source path, alone or up to any of its colons, then as a normalised name or alias, then by
    its last and last but one dotted segment. Distinct names are resolved once, however many rows repeat them.
    """
    src, names = entity_name_keys(entities)
    ref = refs.filter("ref IS NOT NULL").select("table_name", "row_id", "field", "seen_at", strip_path(F.col("ref")).alias("key"))
    uniq = ref.select("key").distinct()
    # every prefix of the name that ends before a colon, and the name itself
    colon = F.split("key", ":")
    heads = F.transform(F.sequence(F.lit(1), F.size(colon)), lambda i: F.array_join(F.slice(colon, 1, i), ":"))
    by_path = uniq.select("key", F.explode(heads).alias("probe")).withColumn("probe", F.rtrim("probe"))
    hit_path = by_path.join(src.withColumnRenamed("key", "probe"), "probe", "left_semi").select("key")
    dots = F.filter(F.split("key", r"\."), lambda x: F.trim(x) != "")
    n = F.size(dots)
    segs = F.array(
        name_key(F.col("key")),
        F.when(n >= 1, name_key(F.element_at(dots, -1))),
        F.when(n >= 2, name_key(F.element_at(dots, -2))),
    )
    by_name = uniq.select("key", F.explode(F.array_distinct(segs)).alias("probe")).filter("probe IS NOT NULL AND probe <> ''")
    hit_name = by_name.join(names.withColumnRenamed("key", "probe"), "probe", "left_semi").select("key")
    known = hit_path.unionByName(hit_name).distinct().withColumn("ok", F.lit(True))
    return salted_join(ref, known, "key", "left", hot_rows).filter("ok IS NULL").select("table_name", "row_id", "field", "seen_at", F.lit("missing").alias("reason"))


def graph_orphans(relationships: DataFrame, raw_relationships: DataFrame, entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """All dangling references of the graph tables: table_name, row_id, field, seen_at, reason.

    Repeated rows count once. Empty tables give no row (no parents: every reference is missing). Extra columns of the
    inputs are ignored.
    """
    rel = relationships.select("rel_id", "source_id", "target_id", "seen_at").dropDuplicates(["rel_id", "source_id", "target_id", "seen_at"])
    both = F.array(
        F.struct(F.lit("source_id").alias("field"), F.col("source_id").alias("ref")),
        F.struct(F.lit("target_id").alias("field"), F.col("target_id").alias("ref")),
    )
    refs = rel.select(F.lit("relationships").alias("table_name"), F.col("rel_id").cast("long").alias("row_id"), "seen_at", F.explode(both).alias("r")).select("table_name", "row_id", "r.field", "seen_at", "r.ref")
    iv = parent_intervals(entities.select("id", "seen_at", "deleted_at"), concepts.select(F.col("node_id").alias("id")))
    raw = raw_relationships.select("raw_id", "target_name", "seen_at").dropDuplicates()
    nrefs = raw.select(F.lit("raw_relationships").alias("table_name"), F.col("raw_id").cast("long").alias("row_id"), F.lit("target_name").alias("field"), "seen_at", F.col("target_name").alias("ref"))
    return orphan_ids(refs, iv).unionByName(orphan_names(nrefs, entities))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts by table, field, reason and month of seen_at (``yyyy-MM``, null where the time is unknown)."""
    return orphans.groupBy("table_name", "field", "reason", F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).cast("long").alias("n_refs"))
