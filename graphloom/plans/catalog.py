"""Registered queries of the core operators, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import orphans
from graphloom.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers the decorated function under ``name``, with ``sql`` as the query that it must equal."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_ORPHANS = r"""
WITH canon AS (SELECT regexp_replace(lower(trim(id)), '^sha256:\s*', '') AS key, seen_at, deleted_at FROM entities),
iv AS (SELECT key, min(seen_at) AS born, min(deleted_at) AS died FROM canon GROUP BY key),
hubs AS (SELECT DISTINCT regexp_replace(lower(trim(node_id)), '^sha256:\s*', '') AS key FROM concepts),
rel AS (SELECT DISTINCT rel_id, source_id, target_id, seen_at FROM relationships),
ref AS (SELECT rel_id, 'source_id' AS field, source_id AS ref, seen_at FROM rel UNION ALL SELECT rel_id, 'target_id', target_id, seen_at FROM rel),
ids AS (
  SELECT 'relationships' AS table_name, rel_id AS row_id, field, seen_at,
    CASE WHEN hubs.key IS NOT NULL THEN NULL WHEN iv.key IS NULL THEN 'missing' WHEN born > seen_at THEN 'late' WHEN died <= seen_at THEN 'deleted' END AS reason
  FROM ref LEFT JOIN iv ON iv.key = regexp_replace(lower(trim(ref.ref)), '^sha256:\s*', '') LEFT JOIN hubs ON hubs.key = regexp_replace(lower(trim(ref.ref)), '^sha256:\s*', '')
  WHERE ref.ref IS NOT NULL),
src AS (SELECT DISTINCT regexp_replace(trim(unnest(sources)), '^(\./)+', '') AS key FROM entities),
nm0 AS (SELECT name AS n FROM entities UNION SELECT unnest(aliases) FROM entities),
nm AS (SELECT DISTINCT regexp_replace(regexp_replace(' ' || regexp_replace(lower(n), '[^a-z0-9]+', '  ', 'g') || ' ', ' (the|a|an) ', ' ', 'g'), ' ', '', 'g') AS key FROM nm0),
raw AS (SELECT DISTINCT raw_id, target_name, seen_at, regexp_replace(trim(target_name), '^(\./)+', '') AS k FROM raw_relationships WHERE target_name IS NOT NULL),
seg AS (SELECT DISTINCT k, list_filter(string_split(k, '.'), lambda x: trim(x) <> '') AS s FROM raw),
probe AS (SELECT k, k AS p FROM seg UNION SELECT k, s[-1] FROM seg UNION SELECT k, s[-2] FROM seg),
pk AS (SELECT DISTINCT k, regexp_replace(regexp_replace(' ' || regexp_replace(lower(p), '[^a-z0-9]+', '  ', 'g') || ' ', ' (the|a|an) ', ' ', 'g'), ' ', '', 'g') AS key FROM probe WHERE p IS NOT NULL),
hit AS (
  SELECT k FROM pk JOIN nm USING (key) WHERE key <> '' UNION
  SELECT k FROM (SELECT k, rtrim(array_to_string(list_slice(string_split(k, ':'), 1, i), ':')) AS p FROM (SELECT k, unnest(range(1, len(string_split(k, ':')) + 1)) AS i FROM seg)) JOIN src ON p = src.key WHERE src.key <> ''),
names AS (SELECT 'raw_relationships' AS table_name, raw_id AS row_id, 'target_name' AS field, seen_at, 'missing' AS reason FROM raw WHERE k NOT IN (SELECT k FROM hit)),
every AS (SELECT * FROM ids WHERE reason IS NOT NULL UNION ALL SELECT * FROM names)
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.graph_orphans(*(table(spark, d, t) for t in ("relationships", "raw_relationships", "entities", "concepts")))


@query("p4_found", _ORPHANS + "SELECT DISTINCT table_name, row_id, field FROM every")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "field").distinct()


@query("p4_report", _ORPHANS + "SELECT table_name, field, reason, strftime(seen_at, '%Y-%m') AS month, count(*) AS n_refs FROM every GROUP BY ALL")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


from graphloom.plans import core, formats, store  # noqa: E402, F401  (they register their queries here)
