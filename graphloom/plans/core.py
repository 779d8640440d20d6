"""Queries of the graph, retrieval, resolution and view operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import drift as D
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.operators import retrieval as T
from graphloom.operators import views as V
from graphloom.plans.catalog import query
from graphloom.runtime import cut, table


def _n(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(table(spark, d, "entities"))


def _e(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(table(spark, d, "relationships"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return R.raw_entities(table(spark, d, "extracted_code"), table(spark, d, "extracted_doc"))


# ---- SQL building blocks
def _canon(c: str) -> str:
    return rf"regexp_replace(lower(trim({c})), '^sha256:\s*', '')"


def _key(c: str) -> str:
    return f"regexp_replace(regexp_replace(' ' || regexp_replace(lower({c}), '[^a-z0-9]+', '  ', 'g') || ' ', ' (the|a|an) ', ' ', 'g'), ' ', '', 'g')"


def _case(values: dict[str, float], c: str, default: float) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


def _code(p: str) -> str:
    return "(" + " OR ".join(f"ends_with(lower({p}), '{s}')" for s in S.CODE_EXT) + ")"


def _tier(p: str) -> str:
    base = f"regexp_extract({p}, '[^/]*$')"
    ops = "(" + " OR ".join(f"ends_with({p}, '{s}')" for s in S.OPS_EXT) + ")"
    return f"""CASE WHEN {base} = 'theory.md' THEN 'THEORY' WHEN {base} = 'architecture.md' THEN 'ARCHITECTURE'
    WHEN contains({p}, 'docs/adr/') OR contains({p}, '/adr/') OR regexp_matches({base}, '^\\d{{3,4}}[-_].*\\.md$') THEN 'ADR' WHEN {_code(p)} THEN 'CODE'
    WHEN {base} IN ('ontology.toml', 'ontology.yaml', 'ontology.yml', 'ontology.base.yaml') THEN 'CONTEXT' WHEN {ops} THEN 'OPS' WHEN {base} = 'context.md' THEN 'CONTEXT'
    WHEN contains({base}, 'reference') OR contains({p}, 'reference/') THEN 'REFERENCE' WHEN {base} = 'plan.md' OR contains({p}, 'docs/features/') OR contains({p}, 'specs/') THEN 'SPEC'
    WHEN regexp_matches({base}, 'readme|handoff|notes|scratch|todo') THEN 'EPHEMERAL' ELSE '' END"""


_SCOPE = "CASE WHEN regexp_replace({p}, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace({p}, '/?[^/]*$', '') END"
NODES = f"n0 AS (SELECT {_canon('id')} AS id, arg_min({{'name': name, 'kind': kind, 'description': description, 'aliases': aliases, 'sources': sources, 'kinds': kinds, 'source_tier': source_tier, 'centrality': centrality, 'confidence': confidence, 'def_line': def_line}}, coalesce(seen_at, TIMESTAMP '{G.LATE}')) AS f FROM entities GROUP BY 1), n AS (SELECT id, f.name, f.kind, f.description, f.aliases, f.sources, f.kinds, f.source_tier, f.centrality, f.confidence, f.def_line FROM n0)"
EDGES = f"""e AS (SELECT source_id, target_id, kind, min(rel_id) AS rel_id, arg_min({{'w': weight, 'd': drift}}, rel_id) AS f FROM (SELECT {_canon('source_id')} AS source_id, {_canon('target_id')} AS target_id, kind, rel_id, weight, drift FROM relationships)
  WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id GROUP BY 1, 2, 3)"""
ADJ = "adj AS (SELECT source_id AS a, target_id AS b, kind FROM e UNION ALL SELECT target_id, source_id, kind FROM e)"
W = _case(S.EDGE_WEIGHT, "kind", S.EDGE_DEFAULT)
GRAPH = f"WITH {NODES}, {EDGES}, {ADJ} "


@query("edge_dedup", f"WITH {EDGES} SELECT source_id, target_id, kind, rel_id FROM e")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("source_id", "target_id", "kind", "rel_id")


@query("edge_weight_lookup", f"WITH {EDGES} SELECT kind, {W} AS edge_weight, count(*) AS n_edges FROM e GROUP BY ALL")
def edge_weight_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).groupBy("kind", S.edge_weight(F.col("kind")).alias("edge_weight")).agg(F.count(F.lit(1)).alias("n_edges"))


@query("neighbors_undirected", GRAPH + "SELECT a AS id, count(*) AS degree, count(DISTINCT b) AS n_neighbours FROM adj GROUP BY 1")
def neighbors_undirected(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_e(spark, d))


@query("degree_rank", GRAPH + f", g AS (SELECT a AS id, count(*) AS degree FROM adj GROUP BY 1) SELECT id, name, 2 * degree + CASE kind WHEN 'module' THEN 3 WHEN 'class' THEN 2 WHEN 'function' THEN 1 ELSE 0 END AS points FROM n JOIN g USING (id) ORDER BY points DESC, id LIMIT 50")
def degree_rank(spark: SparkSession, d: str) -> DataFrame:
    n, g = _n(spark, d), G.degrees(_e(spark, d))
    kind = F.when(F.col("kind") == "module", 3).when(F.col("kind") == "class", 2).when(F.col("kind") == "function", 1).otherwise(0)
    return n.join(g, "id").select("id", "name", (2 * F.col("degree") + kind).alias("points")).orderBy(F.col("points").desc(), "id").limit(50)


_CENT = f"""c AS (SELECT target_id AS id, count(DISTINCT doc) AS n_docs FROM e JOIN (SELECT id AS source_id, unnest(sources) AS doc FROM n) USING (source_id) WHERE kind IN {S.CENTRAL_KINDS!r} GROUP BY 1)"""


@query("centrality_distinct_sources", GRAPH + f", {_CENT} SELECT n.id, coalesce(n_docs, 0) AS n_docs, round(coalesce(n_docs / (SELECT max(n_docs) FROM c), 0), 6) AS centrality FROM n LEFT JOIN c USING (id)")
def centrality_distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    return G.centrality(_n(spark, d), _e(spark, d)).select("id", "n_docs", F.round("centrality", 6).alias("centrality"))


_AUTH = f"au AS (SELECT id, max({_case(S.TIER_WEIGHT, 'tier', S.TIER_DEFAULT)}) AS authority FROM (SELECT id, {_tier('p')} AS tier FROM (SELECT id, lower(unnest(sources)) AS p FROM n)) GROUP BY 1)"


@query("authority_tier", GRAPH + f", {_AUTH} SELECT n.id, coalesce(authority, {S.TIER_DEFAULT}) AS authority FROM n LEFT JOIN au USING (id)")
def authority_tier(spark: SparkSession, d: str) -> DataFrame:
    return _n(spark, d).select("id", S.authority(F.col("sources")).alias("authority"))


@query("source_tier_histogram", f"SELECT {_tier('p')} AS tier, count(*) AS n_files FROM (SELECT DISTINCT lower(source_path) AS p FROM chunks WHERE source_path IS NOT NULL) GROUP BY 1")
def source_tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").select(F.lower("source_path").alias("p")).filter("p IS NOT NULL").distinct()
    return p.groupBy(S.classify_source(F.col("p")).alias("tier")).agg(F.count(F.lit(1)).alias("n_files"))


_ROLES = [("docs/features/*", "THEORY"), ("*/docs/*", "OVERVIEW"), ("*.tf", "ADR")]


@query(
    "role_override",
    f"""WITH p AS (SELECT DISTINCT lower(source_path) AS p FROM chunks WHERE source_path IS NOT NULL),
    r AS (SELECT * FROM (VALUES ('docs/features/*', '^docs/features/.*$', 'THEORY', 1, 15), ('*/docs/*', '^.*/docs/.*$', 'OVERVIEW', 2, 8), ('*.tf', '^.*\\.tf$', 'ADR', 1, 4)) t(g, rx, tier, stars, size)),
    h AS (SELECT p, arg_max(tier, 100 * size - 10000 * stars) AS role FROM p JOIN r ON regexp_matches(p, rx) OR regexp_matches(regexp_extract(p, '[^/]*$'), rx) GROUP BY 1)
    SELECT coalesce(role, {_tier('p.p')}) AS tier, count(*) AS n_files FROM p LEFT JOIN h ON h.p = p.p GROUP BY 1""",
)
def role_override(spark: SparkSession, d: str) -> DataFrame:
    """Role globs, a short list of settings, override the ladder: the fewest stars, then the longest glob."""
    p = table(spark, d, "chunks").select(F.lower("source_path").alias("p")).filter("p IS NOT NULL").distinct()
    best = F.lit(None).cast("string")
    for glob, tier in sorted(_ROLES, key=lambda r: (r[0].count("*"), -len(r[0])), reverse=True):
        rx = S.glob_regex(F.lit(glob))
        best = F.when(F.regexp_like("p", rx) | F.regexp_like(F.substring_index("p", "/", -1), rx), tier).otherwise(best)
    return p.groupBy(F.coalesce(best, S.classify_source(F.col("p"))).alias("tier")).agg(F.count(F.lit(1)).alias("n_files"))


_CONF = GRAPH + f""", {_AUTH}, dr AS (SELECT source_id AS id, sum(({W}::DECIMAL(18,9) * f.d::DECIMAL(18,9))::DECIMAL(28,14))::DOUBLE / nullif(sum({W}::DECIMAL(18,9))::DOUBLE, 0) AS drift FROM e WHERE f.d IS NOT NULL GROUP BY 1),
cf AS (SELECT n.id, coalesce(authority, {S.TIER_DEFAULT}) AS authority, coalesce(drift, 0) AS drift FROM n LEFT JOIN au USING (id) LEFT JOIN dr USING (id)) """


@query("node_drift", _CONF + "SELECT id, round(drift::DECIMAL(20,9), 6)::DOUBLE AS drift FROM cf WHERE drift > 0")
def node_drift(spark: SparkSession, d: str) -> DataFrame:
    return G.confidence(_n(spark, d), _e(spark, d)).filter("drift > 0").select("id", G.places(F.col("drift"), 6).alias("drift"))


@query("confidence_with_drift", _CONF + "SELECT id, authority, round((authority * (1 - drift))::DECIMAL(20,9), 6)::DOUBLE AS confidence FROM cf")
def confidence_with_drift(spark: SparkSession, d: str) -> DataFrame:
    return G.confidence(_n(spark, d), _e(spark, d)).select("id", "authority", G.places(F.col("confidence"), 6).alias("confidence"))


@query(
    "churn_interval",
    """SELECT k.o_custkey, k.o_orderkey AS since, round(sum(o.o_totalprice)::DECIMAL(28,6), 2)::DOUBLE AS churn, count(*) AS n_later
    FROM orders k JOIN orders o ON o.o_custkey = k.o_custkey AND o.o_orderkey > k.o_orderkey GROUP BY 1, 2""",
)
def churn_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval join of every order with the later ones of its customer, as running sums over one sort instead of pairs."""
    return D.changed_after(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", F.col("o_orderkey").alias("since"), F.round(F.col("changed").cast("decimal(28,6)"), 2).cast("double").alias("churn"), "n_later")


_LOG = "lg AS (SELECT source_path AS path, committed_at AS ord, sum(len(string_split(chunk_text, chr(10)))) AS changed FROM (SELECT DISTINCT source_path, chunk_no, committed_at, chunk_text FROM chunks WHERE source_path IS NOT NULL AND committed_at IS NOT NULL AND chunk_text IS NOT NULL) GROUP BY 1, 2), sz AS (SELECT path, sum(changed) AS size FROM lg GROUP BY 1)"
_ENDS_WITH = "(" + " OR ".join(f"ends_with(x, '{s}')" for s in S.CODE_EXT) + ")"


@query(
    "drift_pass",
    GRAPH
    + f""", {_AUTH}, {_LOG}, k AS (SELECT id, list_filter(sources, lambda x: {_ENDS_WITH}) AS cs, list_filter(sources, lambda x: NOT {_ENDS_WITH}) AS ds FROM n),
    j AS (SELECT kind, CASE WHEN len(t.cs) > 0 THEN s.id ELSE t.id END AS claimant, CASE WHEN len(t.cs) > 0 THEN s.ds[1] ELSE t.ds[1] END AS doc, CASE WHEN len(t.cs) > 0 THEN t.cs[1] ELSE s.cs[1] END AS code FROM e JOIN k s ON s.id = source_id JOIN k t ON t.id = target_id WHERE (coalesce(len(s.cs), 0) > 0) <> (coalesce(len(t.cs), 0) > 0)),
    c AS (SELECT j.*, (SELECT sum(changed) FROM lg WHERE lg.path = j.code AND lg.ord > (SELECT max(ord) FROM lg l2 WHERE l2.path = j.doc)) AS churn, sz.size FROM j LEFT JOIN sz ON sz.path = j.code WHERE doc IS NOT NULL AND code IS NOT NULL),
    f AS (SELECT claimant AS id, {W} AS w, CASE WHEN churn > 0 AND size > 0 THEN least(1.0, churn::DOUBLE / size) ELSE 0 END AS drift FROM c), g AS (SELECT id, sum((w::DECIMAL(18,9) * drift::DECIMAL(18,9))::DECIMAL(28,14))::DOUBLE / nullif(sum(w::DECIMAL(18,9))::DOUBLE, 0) AS drift FROM f GROUP BY 1)
    SELECT n.id, coalesce(authority, {S.TIER_DEFAULT}) AS authority, round(coalesce(drift, 0)::DECIMAL(20,9), 5)::DOUBLE AS drift FROM n LEFT JOIN au USING (id) LEFT JOIN g USING (id)""",
)
def drift_pass(spark: SparkSession, d: str) -> DataFrame:
    """Drift of documents behind the code that they speak about, from the commits of the chunks as a log."""
    c = table(spark, d, "chunks").select("source_path", "chunk_no", "committed_at", "chunk_text").filter("source_path IS NOT NULL AND committed_at IS NOT NULL AND chunk_text IS NOT NULL").distinct()
    log = c.groupBy(F.col("source_path").alias("path"), F.col("committed_at").alias("ord")).agg(F.sum(F.size(F.split("chunk_text", "\n"))).alias("changed"))
    sizes = log.groupBy("path").agg(F.sum("changed").alias("size"))
    return D.drift_pass(_n(spark, d), _e(spark, d), log, sizes).select("id", "authority", G.places(F.col("drift"), 5).alias("drift"))


@query("containment_spine", GRAPH + ", p AS (SELECT target_id AS id, arg_min(source_id, rel_id) AS parent FROM e WHERE kind = 'contains' GROUP BY 1) SELECT id, parent FROM p")
def containment_spine(spark: SparkSession, d: str) -> DataFrame:
    return G.parents(_e(spark, d))


@query(
    "containment_depth",
    "WITH RECURSIVE " + f"{NODES}, {EDGES}" + """, p AS (SELECT target_id AS id, arg_min(source_id, rel_id) AS parent FROM e WHERE kind = 'contains' GROUP BY 1),
    t AS (SELECT id, 0 AS depth FROM n WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, t.depth + 1 FROM p JOIN t ON p.parent = t.id)
    SELECT depth, count(*) AS n_nodes FROM t GROUP BY 1""",
)
def containment_depth(spark: SparkSession, d: str) -> DataFrame:
    return G.depths(_n(spark, d), _e(spark, d)).groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


_CROSS = GRAPH + ", pr AS (SELECT id, split_part(list_min(sources), '/', 1) AS project FROM n), x AS (SELECT e.kind, a.project AS pa, b.project AS pb FROM e JOIN pr a ON a.id = source_id JOIN pr b ON b.id = target_id) "


@query("cross_repo_edges", _CROSS + "SELECT kind, count(*) AS n_edges, count(*) FILTER (WHERE pa <> pb) AS n_cross FROM x GROUP BY 1")
def cross_repo_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.cross_edges(_n(spark, d), _e(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("cross").alias("n_cross"))


_SC = _SCOPE.format(p="list_min(sources)")


@query("cross_scope_density", GRAPH + f", s AS (SELECT id, {_SC} AS scope FROM n), x AS (SELECT a.scope AS p, b.scope AS q FROM e JOIN s a ON a.id = source_id JOIN s b ON b.id = target_id) SELECT least(p, q) AS scope_a, greatest(p, q) AS scope_b, count(*) AS n_edges FROM x WHERE p <> q GROUP BY 1, 2 ORDER BY n_edges DESC, scope_a, scope_b LIMIT 10")
def cross_scope_density(spark: SparkSession, d: str) -> DataFrame:
    return G.scope_pairs(_n(spark, d), _e(spark, d)).orderBy(F.col("n_edges").desc(), "scope_a", "scope_b").limit(10)


@query("graph_export_nodes", f"WITH {NODES} SELECT id, name, kind, len(sources) AS n_sources FROM n")
def graph_export_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as JSON documents and read back."""
    j = G.export_nodes(_n(spark, d), slim=True)
    back = F.from_json("json", "id string, name string, kind string, sources array<string>")
    return j.select(back.alias("x")).select("x.id", "x.name", "x.kind", F.size("x.sources").alias("n_sources"))


@query("file_nodes", f"WITH {NODES}, f AS (SELECT id, kind, unnest(sources) AS path FROM n) SELECT path, {_SCOPE.format(p='path')} AS scope, count(DISTINCT id) AS n_entities, coalesce(min(CASE WHEN kind = 'module' THEN id END), min(id)) AS anchor FROM f GROUP BY 1, 2")
def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.file_nodes(_n(spark, d))


@query(
    "graph_counters",
    GRAPH + "SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM e WHERE source_id NOT IN (SELECT id FROM n)) AS n_dangling, (SELECT count(*) FROM n WHERE len(sources) > 1) AS n_multi",
)
def graph_counters(spark: SparkSession, d: str) -> DataFrame:
    n, e = _n(spark, d), _e(spark, d)
    lost = e.join(n.select(F.col("id").alias("source_id")), "source_id", "left_anti").agg(F.count(F.lit(1)).alias("n_dangling"))
    return n.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.size("sources") > 1).alias("n_multi")).crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(lost)


@query(
    "edge_quantiles_nearest_rank",
    f"""WITH {EDGES}, s AS (SELECT kind, f.d AS v, row_number() OVER (PARTITION BY kind ORDER BY f.d) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM e WHERE f.d IS NOT NULL)
    SELECT kind, n, min(v) FILTER (WHERE i = least(n - 1, floor(0.5 * n))) AS q50, min(v) FILTER (WHERE i = least(n - 1, floor(0.9 * n))) AS q90 FROM s GROUP BY 1, 2""",
)
def edge_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return G.nearest_rank_quantiles(_e(spark, d), "kind", "drift", (0.5, 0.9))


# ---- retrieval
_Q = "(SELECT embedding FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 ORDER BY id LIMIT 1)"
_COS = "CASE WHEN embedding IS NULL OR len(embedding) <> len(q) THEN 0 ELSE coalesce(CASE WHEN isnan(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])) THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) END, 0) END"


def _hits(where: str = "TRUE") -> str:
    return f"h AS (SELECT id, max({_COS}) AS score FROM (SELECT id, embedding FROM chunks WHERE ({where}) AND id IS NOT NULL), (SELECT {_Q} AS q) GROUP BY 1 ORDER BY score DESC, id LIMIT 10), hr AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM h)"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "chunks").filter("size(embedding) = 64").select("id", "embedding").orderBy("id").limit(1).first()["embedding"]


@query("find_topk_cosine", f"WITH {_hits()} SELECT id, rank, round(score, 6) AS score FROM hr")
def find_topk(spark: SparkSession, d: str) -> DataFrame:
    return T.search(table(spark, d, "chunks"), _query_vector(spark, d)).select("id", "rank", F.round("score", 6).alias("score"))


_IN = "(scope = 'harborline/core/api' OR starts_with(scope, 'harborline/core/api/'))"


@query("find_scoped", f"WITH {_hits(_IN)} SELECT id, rank, round(score, 6) AS score FROM hr")
def find_scoped(spark: SparkSession, d: str) -> DataFrame:
    return T.search(table(spark, d, "chunks"), _query_vector(spark, d), scope="harborline/core/api").select("id", "rank", F.round("score", 6).alias("score"))


@query("find_scope_fallback", f"WITH {_hits()} SELECT id, rank, TRUE AS fallback FROM hr")
def find_fallback(spark: SparkSession, d: str) -> DataFrame:
    c, q = table(spark, d, "chunks"), _query_vector(spark, d)
    return T.with_fallback(T.search(c, q, scope="no/such/scope"), T.search(c, q)).select("id", "rank", "fallback")


_RANK = f"""WITH {NODES}, {EDGES}, {ADJ}, {_hits()}, c AS (SELECT hr.*, coalesce(n.confidence, 1) AS confidence, n.id IS NOT NULL AS is_entity FROM hr LEFT JOIN n USING (id)),
px AS (SELECT b, max({W}) AS w FROM adj WHERE a IN (SELECT id FROM c WHERE rank <= 3 AND is_entity) GROUP BY 1),
rk AS (SELECT c.*, 1 + coalesce(w, 0) AS proximity, score * confidence * (1 + coalesce(w, 0)) AS find_score FROM c LEFT JOIN px ON px.b = c.id) """


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, adj = _n(spark, d), G.adjacency(_e(spark, d))
    return T.rerank(T.search(table(spark, d, "chunks"), _query_vector(spark, d)), n, adj), n, adj


@query("find_rank_proximity", _RANK + "SELECT id, round(proximity, 6) AS proximity, round(find_score, 6) AS find_score FROM rk")
def find_rank(spark: SparkSession, d: str) -> DataFrame:
    r, _, _ = _ranked(spark, d)
    return r.select("id", F.round("proximity", 6).alias("proximity"), F.round("find_score", 6).alias("find_score"))


@query(
    "find_expand_neighbors",
    _RANK
    + f""", sd AS (SELECT id, find_score AS s FROM rk WHERE is_entity ORDER BY find_score DESC, id LIMIT 3),
    ex AS (SELECT b AS id, max(s * {W.replace("CASE kind", "CASE adj.kind")} * 0.6 * coalesce(n.confidence, 1)) AS x FROM adj JOIN sd ON sd.id = a JOIN n ON n.id = b WHERE b NOT IN (SELECT id FROM rk) GROUP BY 1)
    SELECT id, round(find_score, 6) AS find_score, TRUE AS direct FROM rk UNION ALL (SELECT id, round(x, 6), FALSE FROM ex WHERE x >= 0.5 * (SELECT min(find_score) FROM rk) ORDER BY x DESC, id LIMIT 5)""",
)
def find_expand(spark: SparkSession, d: str) -> DataFrame:
    r, n, adj = _ranked(spark, d)
    return T.expand(r, n, adj).select("id", F.round("find_score", 6).alias("find_score"), "direct")


@query(
    "find_assemble",
    f"""WITH {_hits()}, t AS (SELECT hr.rank, x.t || chr(10) || chr(10) || '> Source: `' || coalesce(x.p, '') || '`' || chr(10) AS entry FROM hr JOIN (SELECT id, min(chunk_text) AS t, min(source_path) AS p FROM chunks GROUP BY 1) x USING (id)),
    u AS (SELECT *, sum(length(entry)) OVER (ORDER BY rank) AS used FROM t) SELECT string_agg(entry, chr(10) ORDER BY rank) AS answer FROM u WHERE rank = 1 OR used <= 8000""",
)
def find_assemble(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    hits = T.search(c, _query_vector(spark, d))
    text = c.join(F.broadcast(hits.select("id")), "id", "left_semi").groupBy("id").agg(F.min("chunk_text").alias("t"), F.min("source_path").alias("p"))
    return T.assemble(hits.join(text, "id"), ["rank"], "t", "p", 2000)


_PAIR = "SELECT a.vec_id AS x, b.vec_id AS y, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"


def _query_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set, ids divisible by 20, against all rows; the set is checked to be small before it is broadcast."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("x"), F.col("embedding").alias("q"))
    if q.limit(100_001).count() > 100_000:
        raise ValueError("too many queries to be broadcast; search them in blocks")
    return e.join(F.broadcast(q), F.col("vec_id") != F.col("x")).select("x", F.col("vec_id").alias("y"), S.cosine(F.col("q"), F.col("embedding")).alias("s"))


@query("pairs_topn_per_item", f"WITH p AS ({_PAIR}) SELECT x, y, r FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(s, 9) DESC, y) AS r FROM p) WHERE r <= 3")
def pairs_topn(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("x").orderBy(F.round("s", 9).desc(), "y")
    return _query_pairs(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("x", "y", "r")


@query("similarity_cdf", f"WITH p AS ({_PAIR}) SELECT count(*) FILTER (WHERE s >= 0.2) AS n20, count(*) FILTER (WHERE s >= 0.5) AS n50, count(*) FILTER (WHERE s >= 0.8) AS n80 FROM p")
def similarity_cdf(spark: SparkSession, d: str) -> DataFrame:
    return _query_pairs(spark, d).agg(*(F.count_if(F.col("s") >= t).alias(f"n{int(t * 100)}") for t in (0.2, 0.5, 0.8)))


# ---- resolution
RAW = f"""u AS (SELECT DISTINCT * FROM (SELECT ent_id AS seq, name, kind, source_file, description, def_line FROM extracted_code UNION ALL SELECT ent_id, name, kind, source_file, description, def_line FROM extracted_doc) WHERE name IS NOT NULL AND source_file IS NOT NULL),
raw AS (SELECT *, NULL::DOUBLE[] AS embedding, {_code('source_file')} AS is_code, {_key('name')} AS base, (base = '' OR name IN {S.STOPLIST!r} OR base IN {S.STOPLIST!r}) AS is_local, CASE WHEN is_local THEN 'local|' || source_file || '|' || CASE WHEN base = '' THEN name ELSE base END ELSE base END AS key FROM u)"""
CL = "cl AS (SELECT key, count(*) AS n_members, count(DISTINCT CASE WHEN is_code THEN name || chr(1) || source_file END) AS n_defs FROM raw GROUP BY 1)"


@query("name_normalize", f"SELECT DISTINCT name, {_key('name')} AS key FROM entities")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("name", S.normalize_name(F.col("name")).alias("key")).distinct()


@query("resolve_clusters", f"WITH {RAW}, {CL} SELECT key, n_members, n_defs, n_defs >= 2 AS ambiguous FROM cl")
def resolve_clusters(spark: SparkSession, d: str) -> DataFrame:
    return R.clusters(_raw(spark, d))


_CID = "sha256('|code|' || name || '|' || source_file)"
_DOT = "list_dot_product(q.embedding, d.v) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(d.v, d.v)))"
# mentions of an ambiguous name join the nearest definition; the rest of the cluster is one concept
_CANON = CL + f""", m0 AS (SELECT raw.*, n_defs, CASE WHEN n_defs >= 2 AND is_code THEN {_CID} ELSE '' END AS part0 FROM raw JOIN cl USING (key)),
df AS (SELECT key, part0, arg_min(embedding, seq) AS v, min(seq) AS first FROM m0 WHERE part0 <> '' GROUP BY 1, 2),
nr AS (SELECT seq, name, source_file, part0 AS near FROM (SELECT q.seq, q.name, q.source_file, d.part0, row_number() OVER (PARTITION BY q.seq, q.name, q.source_file ORDER BY {_DOT} DESC, d.first) AS r
  FROM m0 q JOIN df d ON d.key = q.key WHERE q.n_defs >= 2 AND NOT q.is_code AND len(q.embedding) = len(d.v) AND {_DOT} >= {R.SIMILAR}) WHERE r = 1),
m AS (SELECT m0.* EXCLUDE (part0), coalesce(near, part0) AS part FROM m0 LEFT JOIN nr USING (seq, name, source_file)),
rk AS (SELECT *, row_number() OVER (PARTITION BY key, part ORDER BY is_code DESC, CASE WHEN is_code OR n_defs >= 2 THEN 0 ELSE coalesce(length(description), 0) END DESC, seq) AS rank FROM m),
an AS (SELECT *, CASE WHEN is_code THEN {_CID} WHEN base = '' THEN sha256('|concept|' || chr(0) || 'local' || chr(0) || source_file || chr(0) || name) ELSE sha256('|concept|' || base) END AS id FROM rk WHERE rank = 1),
gr AS (SELECT key, part, count(*) AS n_members, list_sort(list(DISTINCT name)) AS aliases, list_sort(list(DISTINCT source_file)) AS sources, coalesce(list_sort(list(DISTINCT kind) FILTER (WHERE kind <> '')), []) AS kinds, min(seq) AS first FROM m GROUP BY 1, 2),
gs AS (SELECT *, min(first) OVER (PARTITION BY key) AS start FROM gr),
cx0 AS (SELECT an.id, key, part, an.name, an.kind, an.is_code, an.base, n_members, aliases, sources, kinds, row_number() OVER (ORDER BY start, NOT an.is_code, first) AS ord FROM gs JOIN an USING (key, part)),
cx AS (SELECT * FROM cx0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)"""


@query("resolve_canonical", f"WITH {RAW}, {_CANON} SELECT id, key, name, is_code, n_members, len(aliases) AS n_aliases, len(sources) AS n_sources, len(kinds) AS n_kinds FROM cx")
def resolve_canonical(spark: SparkSession, d: str) -> DataFrame:
    n = R.canonical(R.members(_raw(spark, d)))
    return n.select("id", "key", "name", "is_code", "n_members", F.size("aliases").alias("n_aliases"), F.size("sources").alias("n_sources"), F.size("kinds").alias("n_kinds"))


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the graph once a source, with the vector of their chunk, as if just extracted."""
    n = _n(spark, d).select("id", "name", "kind", "description", "def_line", F.explode("sources").alias("source_file"))
    v = table(spark, d, "chunks").groupBy(G.canonical_id(F.col("id")).alias("id")).agg(F.min("embedding").alias("embedding"))
    e = n.join(v, "id", "left").select("*", F.xxhash64("id", "source_file").alias("ent_id"))
    return R.raw_entities(e, e.limit(0))


@query(
    "resolve_ambiguous",
    f"""WITH {NODES}, v AS (SELECT {_canon('id')} AS id, min(embedding) AS embedding FROM chunks GROUP BY 1),
    e AS (SELECT id, name, kind, unnest(sources) AS source_file FROM n), s AS (SELECT e.*, embedding, {_code('source_file')} AS is_code, {_key('name')} AS key FROM e LEFT JOIN v USING (id)),
    t AS (SELECT key FROM s WHERE is_code AND key NOT IN ('', 'a') GROUP BY 1 HAVING count(DISTINCT name || chr(1) || source_file) >= 2),
    q AS (SELECT s.* FROM s JOIN t USING (key) WHERE NOT is_code AND len(embedding) > 0), df AS (SELECT key, name, source_file, embedding FROM s JOIN t USING (key) WHERE is_code),
    c AS (SELECT q.id, q.source_file, q.name, max(CASE WHEN list_cosine_similarity(q.embedding::DOUBLE[], df.embedding::DOUBLE[]) >= {R.SIMILAR} THEN 1 ELSE 0 END) AS near FROM q JOIN df ON df.key = q.key AND len(df.embedding) = len(q.embedding) AND list_sum(list_transform(df.embedding, lambda x: abs(x))) > 0 AND list_sum(list_transform(q.embedding, lambda x: abs(x))) > 0 GROUP BY 1, 2, 3)
    SELECT q.name, count(*) AS n_mentions, count(*) FILTER (WHERE near = 1) AS n_joined FROM q LEFT JOIN c USING (id, source_file, name) GROUP BY 1""",
)
def resolve_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """How many mentions of names with several definitions join one of them by their vectors."""
    m = _first_vectors(R.members(_with_vectors(spark, d).filter("key NOT IN ('', 'a') AND NOT is_local")))
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_if(F.col("part") != "").alias("n_joined"))


def _first_vectors(m: DataFrame) -> DataFrame:
    return m.filter("n_defs >= 2 AND NOT is_code AND size(embedding) > 0")


_RES = f"""WITH {RAW}, {_CANON}, ids AS (SELECT m.*, cx.id FROM m JOIN cx USING (key, part)),
l_exact AS (SELECT name, source_file, arg_max(coalesce(cx.id, CASE WHEN m.part <> '' THEN m.part WHEN m.is_code THEN sha256('|code|' || m.name || '|' || m.source_file) WHEN m.base = '' THEN sha256('|concept|' || chr(0) || 'local' || chr(0) || m.source_file || chr(0) || m.name) ELSE sha256('|concept|' || m.base) END), seq) AS id FROM m LEFT JOIN (SELECT id, key, part FROM cx) cx USING (key, part) GROUP BY 1, 2),
mo0 AS (SELECT id, ord, unnest(sources) AS path FROM cx WHERE list_contains(kinds, 'module')), l_mod AS (SELECT path, arg_max(id, ord) AS id FROM mo0 WHERE {_code('path')} GROUP BY 1),
l_base AS (SELECT regexp_extract(path, '[^/]*$') AS base, min(id) AS id FROM mo0 WHERE {_code('path')} GROUP BY 1 HAVING count(DISTINCT id) = 1),
l_amb AS (SELECT DISTINCT base AS key FROM m WHERE n_defs >= 2), l_name AS (SELECT DISTINCT key, cx.id, cx.is_code AS code FROM (SELECT DISTINCT key FROM m WHERE n_defs < 2 AND NOT is_local) JOIN cx USING (key)),
le0 AS (SELECT id, regexp_extract(s, '[^.]*$') AS lf FROM (SELECT id, unnest(list_distinct(list_append(aliases, name))) AS s FROM cx WHERE is_code) WHERE contains(s, '.')),
l_leaf AS (SELECT {_key('lf')} AS leaf, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM le0 WHERE {_key('lf')} NOT IN {('', *S.STOPLIST)!r} AND lf NOT IN {S.STOPLIST!r} GROUP BY 1),
rr AS (SELECT DISTINCT raw_id, source_name, target_name, kind, source_file, description, source_line FROM raw_relationships),
r0 AS (SELECT DISTINCT ref, source_file FROM (SELECT target_name AS ref, source_file FROM rr UNION ALL SELECT source_name, source_file FROM rr) WHERE ref IS NOT NULL),
r1 AS (SELECT *, trim(ref) AS t, split_part(trim(ref), ':', 1) AS f0, regexp_replace(f0, '^[./]+', '') AS fp, contains(trim(ref), ':') AND ({" OR ".join(f"ends_with(split_part(trim(ref), ':', 1), '{x}')" for x in S.CODE_EXT)}) AS colon, contains(ref, '/') OR {" OR ".join(f"ends_with(ref, '{x}')" for x in S.CODE_EXT)} AS pathy,
  trim(CASE WHEN contains(trim(ref), ':') THEN substr(trim(ref), strpos(trim(ref), ':') + 1) ELSE '' END) AS tl, regexp_replace(regexp_replace(trim(ref), '^[./]+', ''), '/+$', '') AS p, list_filter(string_split(ref, '.'), lambda x: x <> '') AS ds, {_key('ref')} AS k FROM r0),
r2 AS (SELECT *, CASE WHEN contains(ref, '.') THEN {_key('ds[-1]')} END AS k1, CASE WHEN contains(ref, '.') AND len(ds) > 1 THEN {_key('ds[-2]')} END AS k2 FROM r1),
r3 AS (SELECT r2.ref, r2.source_file, sy.id AS sym_id, coalesce(m1.id, b1.id) AS file_id, coalesce(m2.id, b2.id) AS path_id, ex.id AS exa_id, am.key IS NOT NULL AS amb, na.id AS nam_id, coalesce(na.code, FALSE) AS nam_code, le.leaf IS NOT NULL AS has_leaf, le.id AS leaf_id, coalesce(n1.id, n2.id) AS dot_id FROM r2
  LEFT JOIN l_exact sy ON colon AND tl <> '' AND NOT regexp_matches(tl, '^\\d') AND sy.name = tl AND sy.source_file = fp LEFT JOIN l_mod m1 ON colon AND m1.path = fp LEFT JOIN l_base b1 ON colon AND b1.base = regexp_extract(fp, '[^/]*$')
  LEFT JOIN l_mod m2 ON pathy AND m2.path = p LEFT JOIN l_base b2 ON pathy AND b2.base = regexp_extract(p, '[^/]*$') LEFT JOIN l_exact ex ON ex.name = ref AND ex.source_file = r2.source_file
  LEFT JOIN l_amb am ON am.key = k LEFT JOIN l_name na ON na.key = k AND k <> '' LEFT JOIN l_leaf le ON le.leaf = k LEFT JOIN l_name n1 ON n1.key = k1 AND k1 <> '' LEFT JOIN l_name n2 ON n2.key = k2 AND k2 <> ''),
rs AS (SELECT ref, source_file, CASE WHEN sym_id IS NOT NULL THEN 'symbol' WHEN file_id IS NOT NULL THEN 'file' WHEN path_id IS NOT NULL THEN 'path' WHEN exa_id IS NOT NULL THEN 'exact' WHEN amb THEN 'ambiguous' WHEN nam_code THEN 'code' WHEN has_leaf THEN 'leaf' WHEN nam_id IS NOT NULL THEN 'doc' WHEN dot_id IS NOT NULL THEN 'dotted' ELSE 'none' END AS step,
  CASE step WHEN 'symbol' THEN sym_id WHEN 'file' THEN file_id WHEN 'path' THEN path_id WHEN 'exact' THEN exa_id WHEN 'code' THEN nam_id WHEN 'doc' THEN nam_id WHEN 'leaf' THEN leaf_id WHEN 'dotted' THEN dot_id END AS id FROM r3),
en AS (SELECT rr.*, a.id AS sid, b.id AS tid, a.id IS NULL OR b.id IS NULL OR a.id = b.id AS lost FROM rr LEFT JOIN rs a ON a.ref = source_name AND a.source_file = rr.source_file LEFT JOIN rs b ON b.ref = target_name AND b.source_file = rr.source_file),
ed AS (SELECT sid AS source_id, tid AS target_id, kind, min(raw_id) AS raw_id, arg_min(source_line, raw_id) AS source_line FROM en WHERE NOT lost GROUP BY 1, 2, 3)
"""


def _resolver(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = cut(R.members(_raw(spark, d)))
    n = cut(R.canonical(m))
    return m, n, R.lookups(m, n)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_relationships")
    return r.select(F.col("target_name").alias("ref"), "source_file").unionByName(r.select(F.col("source_name").alias("ref"), "source_file"))


@query("endpoint_resolution", _RES + "SELECT ref, source_file, step, id FROM rs")
def endpoint_resolution(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_endpoints(_ends(spark, d), _resolver(spark, d)[2])


@query("resolved_edges", _RES + "SELECT source_id, target_id, kind, count(*) AS n FROM ed GROUP BY ALL")
def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    e, _ = R.resolve_edges(table(spark, d, "raw_relationships"), _resolver(spark, d)[2])
    return e.groupBy("source_id", "target_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("resolver_steps", _RES + "SELECT step, count(*) AS n_refs FROM rs GROUP BY 1")
def resolver_steps(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_endpoints(_ends(spark, d), _resolver(spark, d)[2]).groupBy("step").agg(F.count(F.lit(1)).alias("n_refs"))


_MD = "len(list_filter(sources, lambda x: ends_with(x, '.md'))) > 0"


@query(
    "resolver_stats",
    _RES
    + f""", fl AS (SELECT id, is_code, {_MD} AS md FROM cx) SELECT (SELECT count(*) FROM m) AS raw_entities, (SELECT count(*) FROM cx) AS canonical_nodes, (SELECT count(*) FROM cx WHERE len(sources) >= 2) AS multi_source_nodes, (SELECT count(*) FROM cx WHERE is_code AND {_MD}) AS code_and_doc_nodes,
    (SELECT count(*) FROM en) AS raw_relationships, (SELECT count(*) FROM ed) AS resolved_edges, (SELECT count(*) FROM en WHERE lost) AS dropped_edges, (SELECT count(*) FROM l_amb) AS ambiguous_names,
    (SELECT count(*) FROM ed JOIN fl a ON a.id = source_id JOIN fl b ON b.id = target_id WHERE (a.is_code AND b.md) OR (b.is_code AND a.md)) AS cross_altitude_edges""",
)
def resolver_stats(spark: SparkSession, d: str) -> DataFrame:
    m, n, t = _resolver(spark, d)
    e, ends = R.resolve_edges(table(spark, d, "raw_relationships"), t)
    return R.resolver_stats(n, m, e, ends)


_BARE = r"""CASE WHEN regexp_extract(t, '^(.+?) \((?:module|class|function|interface), .+\)$', 1) <> '' THEN trim(regexp_extract(t, '^(.+?) \((?:module|class|function|interface), .+\)$', 1))
  WHEN contains(t, ':') AND (@ends@) AND substr(t, strpos(t, ':') + 1) <> '' AND NOT regexp_matches(substr(t, strpos(t, ':') + 1), '^\d') THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END""".replace("@ends@", " OR ".join(f"ends_with(trim(split_part(t, ':', 1)), '{x}')" for x in S.CODE_EXT))


def _ends_code(c: str) -> str:
    return "(" + " OR ".join(f"ends_with({c}, '{x}')" for x in S.CODE_EXT) + ")"


@query(
    "drop_buckets",
    _RES
    + f""", ph AS (SELECT phrase, t, split_part(t, ':', 1) AS head, {_BARE} AS cand FROM (SELECT DISTINCT ref AS phrase, trim(ref) AS t FROM rs WHERE id IS NULL)),
    cn AS (SELECT s AS name, count(DISTINCT id) AS n FROM (SELECT id, unnest(list_distinct(list_append(aliases, name))) AS s FROM cx WHERE is_code) GROUP BY 1),
    bk AS (SELECT phrase, CASE WHEN {_ends_code('head')} AND regexp_replace(head, '^[./]+', '') IN (SELECT path FROM l_mod) THEN 'recoverable' WHEN cand = t AND contains(t, '/') AND NOT contains(t, ':') AND NOT {_ends_code('t')} THEN 'directory'
      WHEN cand IN {S.STOPLIST!r} OR {_key('cand')} IN {S.STOPLIST!r} OR {_key('cand')} IN (SELECT key FROM l_amb) THEN 'ambiguous' WHEN c.n = 1 THEN 'recoverable' WHEN c.n > 1 THEN 'ambiguous' WHEN contains(cand, '.') AND d.n IS NULL THEN 'external'
      WHEN len(regexp_split_to_array(t, '\\s+')) >= 3 THEN 'prose' ELSE 'no_referent' END AS bucket FROM ph LEFT JOIN cn c ON c.name = cand LEFT JOIN cn d ON d.name = regexp_extract(cand, '[^.]*$'))
    SELECT bucket, count(*) AS n_phrases, array_to_string(list_slice(list_sort(list(phrase)), 1, 5), ', ') AS sample FROM bk GROUP BY 1""",
)
def drop_buckets(spark: SparkSession, d: str) -> DataFrame:
    m, n, t = _resolver(spark, d)
    lost = R.resolve_endpoints(_ends(spark, d), t).filter("id IS NULL").select(F.col("ref").alias("phrase"))
    return R.drop_report(R.drop_buckets(lost, m, n))


# ---- views and text
_SE = f"se AS (SELECT id, name, kind, description, unnest(list_distinct(list_transform(sources, lambda p: {_SCOPE.format(p='p')}))) AS scope FROM n)"
_SUM = r"sm AS (SELECT source_path AS scope, min(chunk_text) AS markdown FROM chunks WHERE lower(regexp_replace(kind, '\s+', '', 'g')) = 'summary' GROUP BY 1)"
_FS0 = r"regexp_replace(regexp_replace(regexp_replace({c}, '^\s+', ''), '^#', ''), '^\s+', '')"


def _first(c: str) -> str:
    t = _FS0.format(c=c)
    return f"CASE WHEN strpos({t}, '. ') > 0 THEN substr({t}, 1, strpos({t}, '. ')) WHEN strpos({t}, '.' || chr(10)) > 0 THEN substr({t}, 1, strpos({t}, '.' || chr(10))) ELSE rtrim(substr({t}, 1, 200)) || CASE WHEN length({t}) > 200 THEN '...' ELSE '' END END"


@query("scope_summary", GRAPH + f", {_SE} SELECT scope, count(*) AS n_entities, count(*) FILTER (WHERE kind = 'class') AS n_classes, count(*) FILTER (WHERE kind = 'function') AS n_functions FROM se GROUP BY 1")
def scope_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.scope_summary(_n(spark, d)).drop("names")


@query("scope_public_names", GRAPH + f", {_SE}, r AS (SELECT scope, name, row_number() OVER (PARTITION BY scope ORDER BY name, id) AS r FROM se WHERE NOT starts_with(regexp_extract(name, '[^.]*$'), '_')) SELECT s.scope, coalesce(string_agg(name, ', ' ORDER BY name), '') AS names FROM (SELECT DISTINCT scope FROM se) s LEFT JOIN r ON r.scope = s.scope AND r <= 5 GROUP BY 1")
def scope_public_names(spark: SparkSession, d: str) -> DataFrame:
    return V.scope_summary(_n(spark, d)).select("scope", "names")


@query("first_sentence", f"WITH {_SUM} SELECT scope, {_first('markdown')} AS line FROM sm")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return V.summaries(table(spark, d, "chunks")).select("scope", S.first_sentence(F.col("markdown")).alias("line"))


@query(
    "view_index",
    f"""WITH {_SUM}, t AS (SELECT split_part(scope, '/', 1) AS project, scope, markdown, len(string_split(scope, '/')) - 1 AS depth FROM sm), rt AS (SELECT project FROM t WHERE depth = 0),
    l AS (SELECT project, scope, CASE WHEN depth = 0 THEN {_first('markdown')} ELSE '- **' || scope || '** — ' || {_first('markdown')} END AS line FROM t WHERE project NOT IN (SELECT project FROM rt) OR depth <= 1)
    SELECT project, '## ' || project || chr(10) || string_agg(line, chr(10) ORDER BY scope) AS text FROM l GROUP BY 1""",
)
def view_index(spark: SparkSession, d: str) -> DataFrame:
    return V.index_view(V.summaries(table(spark, d, "chunks")))


@query(
    "view_by_topic",
    GRAPH + f""", {_SE}, {_SUM}, m AS (SELECT scope, count(*) FILTER (WHERE coalesce(contains(lower(name), 'harbor'), FALSE) OR coalesce(contains(lower(description), 'harbor'), FALSE)) AS n_entities FROM se GROUP BY 1),
    j AS (SELECT scope, coalesce(n_entities, 0) AS n_entities, coalesce(contains(lower(markdown), 'harbor'), FALSE) AS told FROM m FULL JOIN sm USING (scope)) SELECT scope, n_entities, n_entities = 0 AS by_summary FROM j WHERE n_entities > 0 OR told""",
)
def view_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return V.by_topic(_n(spark, d), V.summaries(table(spark, d, "chunks")), "Harbor")


@query(
    "doc_gap",
    GRAPH + f""", f AS (SELECT id, kind, unnest(sources) AS path FROM n), c AS (SELECT {_SCOPE.format(p='path')} AS scope, count(DISTINCT id) AS n_code FROM f WHERE kind IN ('module', 'class', 'function') AND {_code('path')} GROUP BY 1),
    rf AS (SELECT DISTINCT split_part(path, '/', 1) AS project FROM (SELECT path, lower(path) AS p FROM f) WHERE {_tier('p')} = 'REFERENCE') SELECT scope, n_code FROM c WHERE n_code >= 10 AND split_part(scope, '/', 1) NOT IN (SELECT project FROM rf)""",
)
def doc_gap(spark: SparkSession, d: str) -> DataFrame:
    return V.doc_gaps(_n(spark, d))


@query("text_normalize", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0b]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(S.normalize_text(F.col("text")), 256).alias("digest"))


@query("content_dedup", "SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS n_copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return V.blobs(table(spark, d, "documents"))


@query(
    "graph_commit",
    """WITH f AS (SELECT source_path, arg_min(sha256(text), doc_id) AS h FROM documents WHERE text IS NOT NULL AND source_path IS NOT NULL GROUP BY 1)
    SELECT split_part(source_path, '/', 1) AS project, sha256(string_agg(source_path || h, '' ORDER BY string_split(source_path, '/'))) AS graph_commit FROM f GROUP BY 1""",
)
def graph_commit(spark: SparkSession, d: str) -> DataFrame:
    return V.tree_commit(table(spark, d, "documents"))


_SNAP = "SELECT source_path AS path, min(sha256(text)) AS digest FROM documents WHERE text IS NOT NULL AND source_path IS NOT NULL AND {w} GROUP BY 1"


@query(
    "incremental_changed",
    f"WITH o AS ({_SNAP.format(w='created_at < TIMESTAMP 2025-05-01'.replace('2025-05-01', chr(39) + '2025-05-01' + chr(39)))}), n AS ({_SNAP.format(w='created_at >= TIMESTAMP ' + chr(39) + '2025-02-01' + chr(39))}) "
    "SELECT path, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n USING (path) WHERE o.digest IS DISTINCT FROM n.digest",
)
def incremental_changed(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of one corpus, one of before May and one of what was made from February on, and what changed between them."""
    t = table(spark, d, "documents").filter("text IS NOT NULL AND source_path IS NOT NULL")
    snap = lambda x: x.groupBy(F.col("source_path").alias("path")).agg(F.min(F.sha2("text", 256)).alias("digest"))
    return V.changed(snap(t.filter("created_at < TIMESTAMP_NTZ '2025-05-01'")), snap(t.filter("created_at >= TIMESTAMP_NTZ '2025-02-01'")))


_WORDS = "' ' || trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) || ' '"


@query(
    "concept_mentions",
    f"""WITH lb AS (SELECT DISTINCT node_id, {_WORDS.format(c='l')} AS k FROM (SELECT node_id, unnest(list_concat([pref_label], alt_labels)) AS l FROM concepts)), tx AS (SELECT doc_id, {_WORDS.format(c='text')} AS t FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT node_id, doc_id FROM lb JOIN tx ON contains(t, k) WHERE trim(k) <> ''""",
)
def concept_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name a concept by any of its labels."""
    return V.concept_mentions(table(spark, d, "documents"), table(spark, d, "concepts"))


@query("aspect_recall", f"WITH {NODES} SELECT id, coalesce(contains(lower(description), 'retries'), FALSE) OR coalesce(contains(lower(name), 'queue'), FALSE) AS by_word, coalesce(regexp_matches(description, 'after \\d+ failed'), FALSE) AS by_shape FROM n WHERE coalesce(contains(lower(description), 'retries'), FALSE) OR coalesce(contains(lower(name), 'queue'), FALSE) OR coalesce(regexp_matches(description, 'after \\d+ failed'), FALSE)")
def aspect_recall(spark: SparkSession, d: str) -> DataFrame:
    word = F.coalesce(F.lower("description").contains("retries"), F.lit(False)) | F.coalesce(F.lower("name").contains("queue"), F.lit(False))
    shape = F.coalesce(F.col("description").rlike(r"after \d+ failed"), F.lit(False))
    return _n(spark, d).select("id", word.alias("by_word"), shape.alias("by_shape")).filter("by_word OR by_shape")


@query("token_docfreq", f"WITH {NODES}, t AS (SELECT DISTINCT id, unnest(string_split(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z]+', ' ', 'g')), ' ')) AS token FROM n) SELECT token, count(DISTINCT id) AS n_entities FROM t WHERE length(token) >= 4 GROUP BY 1")
def token_docfreq(spark: SparkSession, d: str) -> DataFrame:
    return V.token_frequencies(_n(spark, d))


@query(
    "gold_recall",
    "WITH g AS (SELECT task_id, unnest(gold) AS path FROM eval_tasks), f AS (SELECT DISTINCT regexp_replace(source_path, '^[^/]*/', '') AS path FROM chunks) SELECT task_id, count(*) AS n_gold, count(f.path) AS n_known FROM g LEFT JOIN f USING (path) GROUP BY 1",
)
def gold_recall(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "eval_tasks").select("task_id", F.explode("gold").alias("path"))
    f = table(spark, d, "chunks").select(F.regexp_replace("source_path", r"^[^/]*/", "").alias("path")).distinct().withColumn("known", F.lit(1))
    return g.join(f, "path", "left").groupBy("task_id").agg(F.count(F.lit(1)).alias("n_gold"), F.count("known").alias("n_known"))


@query("pagerank_importance")
def pagerank_importance(spark: SparkSession, d: str) -> DataFrame:
    """Extension: importance by links."""
    return G.pagerank(_n(spark, d), _e(spark, d))


# ---- concepts, budgets and extensions
@query("path_kinds", f"WITH p AS (SELECT DISTINCT source_path AS p FROM chunks WHERE source_path IS NOT NULL) SELECT CASE WHEN {_code('p')} THEN 'code' WHEN {' OR '.join(f'''ends_with(lower(p), '{s}')''' for s in S.OPS_EXT)} THEN 'ops' ELSE 'prose' END AS path_kind, count(*) AS n_files FROM p GROUP BY 1")
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "chunks").select(F.col("source_path").alias("p")).filter("p IS NOT NULL").distinct()
    return p.groupBy(F.when(S.is_code_path(F.col("p")), "code").when(S.is_ops_path(F.col("p")), "ops").otherwise("prose").alias("path_kind")).agg(F.count(F.lit(1)).alias("n_files"))


@query("slug_labels", "SELECT node_id, regexp_replace(regexp_replace(lower(trim(pref_label)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM concepts")
def slug_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").select("node_id", S.slug(F.col("pref_label")).alias("slug"))


_HUB = f"hub AS (SELECT DISTINCT {_canon('node_id')} AS node_id FROM concepts)"


def _concept_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges that point at a concept. The hubs are curated, and are broadcast after a check of their number."""
    from graphloom.operators.orphans import canonical_id
    from graphloom.runtime import small_enough

    hubs = table(spark, d, "concepts").select(canonical_id(F.col("node_id")).alias("target_id")).distinct()
    return _e(spark, d).join(F.broadcast(hubs) if small_enough(hubs, 100_000) else hubs, "target_id", "left_semi")


@query("concept_topology", GRAPH + f", {_HUB}, c AS (SELECT source_id, count(DISTINCT target_id) AS n_concepts FROM e WHERE target_id IN (SELECT node_id FROM hub) GROUP BY 1) SELECT n_concepts, count(*) AS n_entities FROM c GROUP BY 1")
def concept_topology(spark: SparkSession, d: str) -> DataFrame:
    c = _concept_links(spark, d).groupBy("source_id").agg(F.count_distinct("target_id").alias("n_concepts"))
    return c.groupBy("n_concepts").agg(F.count(F.lit(1)).alias("n_entities"))


@query("concept_governing_docs", GRAPH + f", {_HUB}, s AS (SELECT id AS source_id, unnest(sources) AS doc FROM n) SELECT target_id AS node_id, count(DISTINCT doc) FILTER (WHERE NOT {_code('doc')}) AS n_docs, count(DISTINCT source_id) AS n_entities FROM e JOIN s USING (source_id) WHERE target_id IN (SELECT node_id FROM hub) GROUP BY 1")
def concept_governing_docs(spark: SparkSession, d: str) -> DataFrame:
    s = _n(spark, d).select(F.col("id").alias("source_id"), F.explode("sources").alias("doc"))
    j = _concept_links(spark, d).join(s, "source_id")
    return j.groupBy(F.col("target_id").alias("node_id")).agg(F.count_distinct(F.when(~S.is_code_path(F.col("doc")), F.col("doc"))).alias("n_docs"), F.count_distinct("source_id").alias("n_entities"))


_CTX = GRAPH + """, g AS (SELECT a AS id, count(*) AS degree FROM adj GROUP BY 1),
c AS (SELECT n.id, split_part(list_min(sources), '/', 1) AS project, n.name || ' (' || n.kind || ')' AS line, 2 * coalesce(degree, 0) + CASE n.kind WHEN 'module' THEN 3 WHEN 'class' THEN 2 WHEN 'function' THEN 1 ELSE 0 END AS points FROM n LEFT JOIN g USING (id) WHERE n.kind IS NOT NULL AND len(sources) > 0),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY project ORDER BY points DESC, id) AS used FROM c), o AS (SELECT project, min(used) FILTER (WHERE used > 400) AS over FROM u GROUP BY 1)
SELECT project, count(*) AS n_lines, max(used) AS n_chars FROM u JOIN o USING (project) WHERE over IS NULL OR used < over GROUP BY 1"""


@query("code_context_budget", _CTX)
def code_context_budget(spark: SparkSession, d: str) -> DataFrame:
    """The context block of each project: its best connected definitions, up to the first that overruns the budget."""
    from graphloom.operators.extract import budgeted

    n = _n(spark, d).filter("kind IS NOT NULL AND size(sources) > 0").join(G.degrees(_e(spark, d)), "id", "left")
    kind = F.when(F.col("kind") == "module", 3).when(F.col("kind") == "class", 2).when(F.col("kind") == "function", 1).otherwise(0)
    c = n.select("id", F.substring_index(F.array_min("sources"), "/", 1).alias("project"), F.concat("name", F.lit(" ("), "kind", F.lit(")")).alias("line"), (2 * F.coalesce("degree", F.lit(0)) + kind).alias("points"))
    kept = budgeted(c, "project", [F.col("points").desc(), "id"], "line", 400)
    return kept.groupBy("project").agg(F.count(F.lit(1)).alias("n_lines"), F.max("used").alias("n_chars"))


@query("scope_rollup", "WITH p AS (SELECT DISTINCT source_path AS p FROM chunks WHERE source_path IS NOT NULL), a AS (SELECT array_to_string(list_slice(string_split(p, '/'), 1, i), '/') AS scope FROM (SELECT p, unnest(range(1, len(string_split(p, '/')) + 1)) AS i FROM p)) SELECT scope, count(*) AS n FROM a GROUP BY 1")
def scope_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: files at or below every ancestor of their scope."""
    from graphloom.operators.extract import rollup_ancestors

    return rollup_ancestors(table(spark, d, "chunks").filter("source_path IS NOT NULL").select("source_path").distinct(), "source_path")


@query(
    "degree_hotspots",
    GRAPH + ", g AS (SELECT a AS id, count(*) AS degree FROM adj GROUP BY 1), o AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM g), q AS (SELECT min(degree) AS cut FROM o WHERE i = least(n - 1, floor(0.9 * n))) SELECT id, degree FROM g, q WHERE degree >= cut",
)
def degree_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """Extension: nodes in the top tenth by degree."""
    from graphloom.operators.extract import hotspots

    return hotspots(G.degrees(_e(spark, d)).select("id", "degree"), "degree")


@query("evidence_spans")
def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators.extract import evidence
    from graphloom.sources.parsers import files_of_chunks

    f = files_of_chunks(table(spark, d, "chunks")).filter(S.is_code_path(F.col("path")))
    return evidence(f, [r"\braise\b|\bthrow\b", r"\.open\("])
