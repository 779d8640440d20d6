"""Queries of the snapshot, export, page and evaluation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import evaluate as E
from graphloom.operators import graph as G
from graphloom.operators import store as T
from graphloom.operators import views as V
from graphloom.plans.catalog import query
from graphloom.plans.core import _FS0, _SCOPE, EDGES, GRAPH, NODES, W, _e, _first, _n, _SUM  # noqa: F401
from graphloom.runtime import table

_SCOPES = f"sc AS (SELECT id, unnest(list_distinct(list_transform(sources, lambda p: {_SCOPE.format(p='p')}))) AS scope FROM n)"


@query("scope_order", GRAPH + f", {_SCOPES} SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY round(coalesce(n.confidence, 1) * (1 + coalesce(n.centrality, 0)), 9) DESC, id) AS place FROM sc JOIN n USING (id)")
def scope_order(spark: SparkSession, d: str) -> DataFrame:
    return T.scope_order(_n(spark, d))


@query("list_by_scope", GRAPH + f", {_SCOPES} SELECT scope, count(*) AS n, min(id) AS first_id FROM sc GROUP BY 1")
def list_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return T.by_scope(_n(spark, d)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("scope_density", GRAPH + f", sl AS (SELECT id, coalesce(list_distinct(list_transform(sources, lambda p: {_SCOPE.format(p='p')})), []) AS s FROM n), j AS (SELECT len(list_distinct(list_concat(a.s, b.s))) > 1 AS x FROM e JOIN sl a ON a.id = source_id JOIN sl b ON b.id = target_id) SELECT count(*) AS n_edges, count(*) FILTER (WHERE x) AS n_cross, count(*) FILTER (WHERE x) / count(*) AS density FROM j")
def scope_density(spark: SparkSession, d: str) -> DataFrame:
    return G.scope_density(_n(spark, d), _e(spark, d))


@query("name_degrees", "WITH r AS (SELECT DISTINCT raw_id, source_name, target_name FROM raw_relationships), x AS (SELECT source_name AS name FROM r UNION ALL SELECT target_name FROM r) SELECT name, count(*) AS degree FROM x WHERE name IS NOT NULL GROUP BY 1")
def name_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.name_degrees(table(spark, d, "raw_relationships"))


_LABEL = "pl AS (SELECT id, split_part(list_min(sources), '/', 1) AS project, def_line, kind FROM n)"


@query("graph_export_edges", GRAPH + f""", {_LABEL} SELECT source_id AS source, target_id AS target, e.kind, e.f.w AS weight, e.f.d AS drift, coalesce(a.project <> b.project, FALSE) AS cross_repo, b.def_line AS "targetLine" FROM e JOIN pl a ON a.id = source_id JOIN pl b ON b.id = target_id""")
def graph_export_edges(spark: SparkSession, d: str) -> DataFrame:
    return T.export_edges(_n(spark, d), _e(spark, d)).drop("sourceLine")


@query("project_filter", GRAPH + f""", {_LABEL}, k AS (SELECT id FROM pl WHERE project = 'harborline' OR kind = 'concept') SELECT (SELECT count(*) FROM k) AS n_nodes, (SELECT count(*) FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)) AS n_edges""")
def project_filter(spark: SparkSession, d: str) -> DataFrame:
    n, e = T.project_part(_n(spark, d), _e(spark, d), "harborline")
    return n.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges")))


@query("graph_export_document", GRAPH + ", p AS (SELECT id FROM n WHERE len(sources) > 0) SELECT 'head' AS part, 1 AS n UNION ALL SELECT 'file', (SELECT count(DISTINCT s) FROM (SELECT unnest(sources) AS s FROM n)) UNION ALL SELECT 'node', (SELECT count(*) FROM n) UNION ALL SELECT 'edge', (SELECT count(*) FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n))")
def graph_export_document(spark: SparkSession, d: str) -> DataFrame:
    """The whole document as lines, read back: how many of each part."""
    n, e = _n(spark, d), _e(spark, d)
    doc = T.export_document(n, e, G.file_nodes(n), "c").filter(F.get_json_object("json", "$").isNotNull())
    return doc.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("upsert_snapshot", f"WITH {EDGES} SELECT source_id, target_id, kind, CASE WHEN kind = 'calls' THEN 1.0 ELSE f.w END AS weight FROM e")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of edges into which a newer one of a single kind goes."""
    e = _e(spark, d).select("source_id", "target_id", "kind", "weight")
    return T.upsert(e, e.filter("kind = 'calls'").withColumn("weight", F.lit(1.0)), ["source_id", "target_id", "kind"])


@query("point_lookup", GRAPH + ", q AS (SELECT id FROM n ORDER BY id LIMIT 3) SELECT id, name, kind FROM n WHERE id IN (SELECT id FROM q)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = _n(spark, d)
    return T.lookup(n, "id", [r.id for r in n.select("id").orderBy("id").limit(3).collect()]).select("id", "name", "kind")


@query("overview_pages", f"""WITH {_SUM}, c AS (SELECT scope, markdown AS t, substr(markdown, 1, 400) AS h FROM sm), p AS (SELECT *, CASE WHEN contains(h, chr(10) || chr(10)) THEN length(h) - strpos(reverse(h), chr(10) || chr(10)) - 1 ELSE -1 END AS para FROM c)
    SELECT scope, CASE WHEN length(t) <= 400 THEN t WHEN para > 200 THEN substr(h, 1, para) ELSE h END AS page FROM p""")
def overview_pages(spark: SparkSession, d: str) -> DataFrame:
    return V.summaries(table(spark, d, "chunks")).select("scope", T.overview(F.col("markdown"), 100).alias("page"))


@query("agents_pages", f"""WITH {_SUM} SELECT scope, '<!-- graph_commit: abc | source_tree_hash: ' || sha256(scope) || ' | materialized_at: 2025-01-01T00:00:00Z -->' || chr(10) || chr(10) || coalesce(markdown, '') || CASE WHEN length(markdown) < 300 THEN chr(10) || chr(10) || 'gap' ELSE '' END || chr(10) AS page FROM sm""")
def agents_pages(spark: SparkSession, d: str) -> DataFrame:
    s = V.summaries(table(spark, d, "chunks"))
    head = S.freshness_header(F.lit("abc"), F.sha2("scope", 256), F.lit("2025-01-01").cast("timestamp"))
    return s.select("scope", T.agents_page(head, F.col("markdown"), F.lit(None).cast("string"), F.when(F.char_length("markdown") < 300, "gap")).alias("page"))


@query("freshness_decision", f"""WITH {_SUM}, t AS (SELECT scope, sha256(markdown) AS h, length(scope) % 3 AS m FROM sm) SELECT scope, m = 0 AS fresh, m = 2 AS ingest, m <> 0 AS render FROM t""")
def freshness_decision(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every scope: a third as they should be, a third of another graph commit, a third of another tree."""
    s = V.summaries(table(spark, d, "chunks"))
    m, h = F.length("scope") % 3, F.sha2("markdown", 256)
    head = S.freshness_header(F.when(m == 1, "dead").otherwise("beef"), F.when(m == 2, F.sha2("scope", 256)).otherwise(h), F.lit("2025-01-01").cast("timestamp"))
    return T.freshness(s.select("scope", F.concat(head, F.lit("\n\n"), "markdown").alias("text")), "beef", s.select("scope", h.alias("tree_hash")))


@query(
    "edge_sections",
    GRAPH
    + f""", s AS (SELECT id, {_SCOPE.format(p='list_min(sources)')} AS scope, coalesce(confidence, 1) AS c FROM n), j AS (SELECT a.scope AS a, b.scope AS b, {W.replace('CASE kind', 'CASE e.kind')} AS w, a.c AS ca, b.c AS cb FROM e JOIN s a ON a.id = source_id JOIN s b ON b.id = target_id WHERE a.scope <> b.scope),
    u AS (SELECT a AS scope, 'depends-on' AS section, b AS other, w * cb AS v FROM j UNION ALL SELECT b, 'used-by', a, w * ca FROM j), g AS (SELECT scope, section, other, sum(v::DECIMAL(20,9)) AS v FROM u GROUP BY ALL)
    SELECT scope, section, other, row_number() OVER (PARTITION BY scope, section ORDER BY v DESC, other) AS place FROM g QUALIFY place <= 8""",
)
def edge_sections(spark: SparkSession, d: str) -> DataFrame:
    return T.edge_sections(_n(spark, d), _e(spark, d))


@query("stale_claims", "SELECT kind = 'calls' AS stale, count(*) AS n FROM (SELECT DISTINCT raw_id, kind FROM raw_relationships WHERE kind IS NOT NULL) GROUP BY 1")
def stale_claims(spark: SparkSession, d: str) -> DataFrame:
    """One kind of edge taken as stale claims, which are set apart."""
    r = table(spark, d, "raw_relationships").filter("kind IS NOT NULL").select("raw_id", F.when(F.col("kind") == "calls", "stale-claim").otherwise(F.col("kind")).alias("kind")).distinct()
    live, stale = T.split_stale(r)
    count = lambda df, flag: df.agg(F.lit(flag).alias("stale"), F.count(F.lit(1)).alias("n"))
    return count(live, False).unionByName(count(stale, True)).filter("n > 0")


@query("kind_frequencies", "SELECT kind, count(*) AS n, count(DISTINCT source_file) AS n_files FROM (SELECT DISTINCT ent_id, kind, source_file FROM extracted_doc WHERE kind IS NOT NULL) GROUP BY 1")
def kind_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that documents propose, by frequency."""
    k = table(spark, d, "extracted_doc").filter("kind IS NOT NULL").select("ent_id", "kind", "source_file").distinct()
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_file").alias("n_files"))


@query(
    "recall_sets",
    GRAPH
    + """, k AS (SELECT DISTINCT kind, id FROM n WHERE contains(lower(description), 'retries')), s AS (SELECT DISTINCT kind, id FROM n WHERE contains(lower(name), 'a') AND contains(name, '_'))
    SELECT coalesce(k.kind, s.kind) AS kind, coalesce(k.id, s.id) AS id, CASE WHEN k.id IS NOT NULL AND s.id IS NOT NULL THEN 'both' WHEN s.id IS NOT NULL THEN 'structural' ELSE 'keyword' END AS signal FROM k FULL JOIN s ON s.kind = k.kind AND s.id = k.id WHERE coalesce(k.kind, s.kind) IS NOT NULL""",
)
def recall_sets(spark: SparkSession, d: str) -> DataFrame:
    n = _n(spark, d).filter("kind IS NOT NULL")
    return E.recall_sets(n.filter(F.lower("description").contains("retries")), n.filter(F.lower("name").contains("a") & F.col("name").contains("_")), ["kind", "id"]).drop("priority")


@query(
    "evidence_lines",
    """WITH f AS (SELECT source_path AS path, min(chunk_text) AS t FROM chunks WHERE chunk_no = 0 AND source_path IS NOT NULL GROUP BY 1), l AS (SELECT path, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM f),
    h AS (SELECT *, contains(lower(line), 'return') AS hit FROM l), k AS (SELECT *, max(hit) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT path, line_no, line FROM k WHERE near QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no) <= 12""",
)
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "chunks").filter("chunk_no = 0 AND source_path IS NOT NULL").groupBy(F.col("source_path").alias("path")).agg(F.min("chunk_text").alias("text"))
    return E.evidence(f, ["return"])


@query("named_paths", r"""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '([A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)*\.[A-Za-z]{1,8})\b', 1)) AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(p) AS n_paths FROM d WHERE len(p) > 0""")
def named_paths(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(E.paths_in(F.col("text"))).alias("n_paths"))
    return t.filter("n_paths > 0")


@query("answer_scores", """WITH a AS (SELECT task_id, gold, list_distinct(regexp_extract_all(passage || ' ' || array_to_string(gold[1:1], ' '), '([A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)*\\.[A-Za-z]{1,8})\\b', 1)) AS cited FROM eval_tasks)
    SELECT task_id AS question, round(CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, cited))::DOUBLE / len(list_distinct(gold)) END, 6) AS recall, round(CASE WHEN len(cited) > 0 THEN len(list_intersect(gold, cited))::DOUBLE / len(cited) END, 6) AS precision FROM a""")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of answers that hold the passage and the first right path of each task."""
    a = table(spark, d, "eval_tasks").select(F.col("task_id").alias("question"), "gold", E.paths_in(F.concat_ws(" ", "passage", F.slice("gold", 1, 1))).alias("cited")).withColumn("known", F.col("gold"))
    return E.answer_scores(a).select("question", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))
