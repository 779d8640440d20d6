"""Entity resolution: clusters of names, canonical nodes, endpoints of edges, and what was dropped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.runtime import cut, salted_join

#: Cosine from which a mention joins one of several definitions of its name.
SIMILAR = 0.82


def raw_entities(code: DataFrame, doc: DataFrame) -> DataFrame:
    """One row a distinct extracted entity, with its cluster key and ``base``, the normalised name.

    Columns: seq (the order of input, ent_id), name, kind, source_file, description, def_line, embedding (null where the
    tables have none), is_code, is_local, base, key. The key is the base; a name that is empty or stands for something else
    in every file keys to its file. Rows without a name or file are left out.
    """
    cols = ["name", "kind", "source_file", "description", "def_line"]

    def own(df: DataFrame) -> DataFrame:
        vec = F.col("embedding") if "embedding" in df.columns else F.lit(None)
        return df.select(F.col("ent_id").cast("long").alias("seq"), *cols, vec.cast("array<double>").alias("embedding"))

    u = own(code).unionByName(own(doc)).filter("name IS NOT NULL AND source_file IS NOT NULL").distinct()
    k = S.normalize_name(F.col("name"))
    local = (k == "") | F.col("name").isin(*S.STOPLIST) | k.isin(*S.STOPLIST)
    u = u.withColumns({"is_code": S.is_code_path(F.col("source_file")), "is_local": local, "base": k})
    return u.withColumn("key", F.when(local, F.concat_ws("|", F.lit("local"), "source_file", F.when(k == "", F.col("name")).otherwise(k))).otherwise(k))


def clusters(raw: DataFrame) -> DataFrame:
    """(key, n_members, n_defs, ambiguous): a cluster with two or more code definitions is ambiguous."""
    d = F.when(F.col("is_code"), F.struct("name", "source_file"))
    return raw.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), F.count_distinct(d).alias("n_defs")).withColumn("ambiguous", F.col("n_defs") >= 2)


def code_id(name: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.lit("|code|"), name, F.lit("|"), path), 256)


def concept_id(base: Column, path: Column, name: Column) -> Column:
    """Of the base; of a name without one, of the name in its file (the separator is the zero character)."""
    local = F.concat(F.lit("\0local\0"), path, F.lit("\0"), name)
    return F.sha2(F.concat(F.lit("|concept|"), F.when(base == "", local).otherwise(base)), 256)


def members(raw: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``raw`` with n_defs and ``part``: the id of the definition that a row of an ambiguous cluster belongs to, '' for the rest.

    The collision guard: a mention joins the definition of its name with the greatest cosine, the first of equal ones, if
    that is ``similar`` or more and greater than 0. A row without a vector joins none. Mentions are dealt to several
    tasks where one name has many.
    """
    m = raw.join(clusters(raw).select("key", "n_defs"), "key")
    twice = F.col("n_defs") >= 2
    m = cut(m.withColumn("part", F.when(twice & F.col("is_code"), code_id(F.col("name"), F.col("source_file"))).otherwise("")))
    asking = m.filter(twice & ~F.col("is_code") & (F.size("embedding") > 0)).select("seq", "name", "source_file", "key", F.col("embedding").alias("q"))
    defs = m.filter(twice & F.col("is_code")).groupBy("key", "part").agg(F.min_by("embedding", "seq").alias("v"), F.min("seq").alias("first"))
    pairs = salted_join(asking, defs, "key", "inner", hot_rows=20_000).withColumn("sim", S.cosine(F.col("q"), F.col("v")))
    best = F.max_by("part", F.struct("sim", -F.col("first"))).alias("near")
    near = pairs.filter((F.col("sim") >= similar) & (F.col("sim") > 0)).groupBy("seq", "name", "source_file").agg(best)
    return m.join(near, ["seq", "name", "source_file"], "left").withColumn("part", F.coalesce("near", "part")).drop("near")


def canonical(m: DataFrame) -> DataFrame:
    """(id, key, part, ord, name, kind, is_code, n_members, aliases, sources, kinds, description, def_line): the merged nodes of :func:`members`.

    A cluster with one code definition at most is one node, anchored at that definition, else at its longest
    description. In an ambiguous one every definition is a node with the mentions that joined it, and all other mentions
    together are one concept, named by the first. Ids depend on the anchor alone; where two clusters have one id, as
    names that are local to their file may, the later one stands. ``ord`` is the order of first appearance.
    """
    long = F.when(F.col("is_code") | (F.col("n_defs") >= 2), 0).otherwise(F.coalesce(F.char_length("description"), F.lit(0)))
    anchor = F.max_by(F.struct("name", "source_file", "kind", "description", "is_code", "base"), F.struct(F.col("is_code"), long, -F.col("seq")))
    g = m.groupBy("key", "part").agg(
        anchor.alias("a"),
        F.count(F.lit(1)).alias("n_members"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
        F.array_sort(F.collect_set("source_file")).alias("sources"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "", F.col("kind")))).alias("kinds"),
        F.min_by("def_line", F.when(F.col("def_line").isNotNull(), F.struct(~F.col("is_code"), F.col("seq")))).alias("def_line"),
        F.min("seq").alias("first"),
    )
    start = F.min("first").over(Window.partitionBy("key"))
    i = F.when(F.col("a.is_code"), code_id(F.col("a.name"), F.col("a.source_file"))).otherwise(concept_id(F.col("a.base"), F.col("a.source_file"), F.col("a.name")))
    g = g.withColumn("ord", F.struct(start, ~F.col("a.is_code"), "first"))
    nodes = g.select(i.alias("id"), "key", "part", "ord", F.col("a.name").alias("name"), F.col("a.kind").alias("kind"), F.col("a.is_code").alias("is_code"), "n_members", "aliases", "sources", "kinds", F.col("a.description").alias("description"), "def_line")
    return nodes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord").desc()))).filter("r = 1").drop("r")


def _probe(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind), *(x for p in parts for x in (F.lit("\t"), p)))


def lookups(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """(probe, id, code): every key by which an endpoint may be found; a null id stops the search.

    Kinds of keys: ``x`` name and file, ``m`` the path of a module, ``b`` its name alone if no other has it, ``a`` a name
    with several definitions, ``n`` any other name, ``l`` the last part of a method's name, null if several share it.
    """
    ids = m.join(nodes.select("key", "part", "id"), ["key", "part"], "left")
    lost = F.when(F.col("part") != "", F.col("part")).when(F.col("is_code"), code_id(F.col("name"), F.col("source_file"))).otherwise(concept_id(F.col("base"), F.col("source_file"), F.col("name")))
    exact = ids.groupBy(_probe("x", F.col("name"), F.col("source_file")).alias("probe")).agg(F.max_by(F.coalesce("id", lost), "seq").alias("id"))
    mod = nodes.filter(F.array_contains("kinds", "module")).select("id", "ord", F.explode("sources").alias("path")).filter(S.is_code_path(F.col("path")))
    path = mod.groupBy(_probe("m", F.col("path")).alias("probe")).agg(F.max_by("id", "ord").alias("id"))
    only = F.when(F.count_distinct("id") == 1, F.min("id")).alias("id")
    base = mod.groupBy(_probe("b", F.substring_index("path", "/", -1)).alias("probe")).agg(only).filter("id IS NOT NULL")
    amb = m.filter("n_defs >= 2").select(_probe("a", F.col("base")).alias("probe")).distinct()
    named = m.filter("n_defs < 2 AND NOT is_local").select("key").distinct().join(nodes.select("key", "id", "is_code"), "key")
    leaf = nodes.filter("is_code").select("id", F.explode(F.array_union(F.array("name"), "aliases")).alias("s")).filter("instr(s, '.') > 0").withColumn("leaf", F.substring_index("s", ".", -1))
    leaf = leaf.withColumn("k", S.normalize_name(F.col("leaf"))).filter((F.col("k") != "") & ~F.col("leaf").isin(*S.STOPLIST) & ~F.col("k").isin(*S.STOPLIST))
    none = F.lit(None).cast("string").alias("id")
    no = F.lit(False).alias("code")
    out = exact.select("probe", "id", no).unionByName(path.select("probe", "id", no)).unionByName(base.select("probe", "id", no)).unionByName(amb.select("probe", none, no))
    out = out.unionByName(named.select(_probe("n", F.col("key")).alias("probe"), "id", F.col("is_code").alias("code")))
    return out.unionByName(leaf.groupBy(_probe("l", F.col("k")).alias("probe")).agg(only).select("probe", "id", no))


#: Steps of the resolution, in the order in which the first that decides counts.
STEPS = ("symbol", "file", "file", "path", "path", "exact", "ambiguous", "code", "leaf", "doc", "dotted", "dotted")


def resolve_endpoints(refs: DataFrame, table: DataFrame) -> DataFrame:
    """(ref, source_file, id, step): where each distinct (ref, source_file) leads by :func:`lookups`, and the step that decided.

    Steps: ``symbol`` (path:Symbol), ``file`` (that path, or its file name alone), ``path`` (a bare path), ``exact`` (name in
    its own file), ``ambiguous`` (stops without an id), ``code`` (a name of code), ``leaf`` (of a method; shared ones stop),
    ``doc`` (any other name), ``dotted`` (last, then last but one segment), ``none``. All keys of a reference are looked up
    by one join and the first that is known decides, so there is one shuffle for all steps.
    """
    r = refs.filter("ref IS NOT NULL").select("ref", "source_file").distinct()
    t = F.trim("ref")
    code_end = lambda c: F.expr(" OR ".join(f"endswith({c}, '{x}')" for x in S.CODE_EXT))
    r = r.withColumns({"t": t, "fp": F.substring_index(t, ":", 1)})
    r = r.withColumns({"colon": F.col("t").contains(":") & code_end("fp"), "pathy": F.col("ref").contains("/") | code_end("ref"), "tail": F.trim(F.regexp_extract("t", r"(?s)^[^:]*:(.*)$", 1)), "k": S.normalize_name(F.col("ref"))})
    r = r.withColumns({"fp": F.regexp_replace("fp", r"^[./]+", ""), "p": F.regexp_replace(F.regexp_replace("t", r"^[./]+", ""), r"/+$", "")})
    dots = F.filter(F.split("ref", r"\."), lambda x: x != "")
    dotted = F.col("ref").contains(".")
    last = F.when(dotted & (F.size(dots) >= 1), S.normalize_name(F.element_at(dots, -1)))
    before = F.when(dotted & (F.size(dots) >= 2), S.normalize_name(F.element_at(dots, -2)))
    name = lambda c: F.when(c != "", _probe("n", c))
    probes = (
        F.when(F.col("colon") & (F.col("tail") != "") & ~F.col("tail").rlike(r"^\d"), _probe("x", F.col("tail"), F.col("fp"))),
        F.when(F.col("colon"), _probe("m", F.col("fp"))),
        F.when(F.col("colon"), _probe("b", F.substring_index("fp", "/", -1))),
        F.when(F.col("pathy"), _probe("m", F.col("p"))),
        F.when(F.col("pathy"), _probe("b", F.substring_index("p", "/", -1))),
        _probe("x", F.col("ref"), F.col("source_file")),
        _probe("a", F.col("k")),
        name(F.col("k")),
        _probe("l", F.col("k")),
        name(F.col("k")),
        name(last),
        name(before),
    )
    each = r.select("ref", "source_file", F.posexplode(F.array(*probes)).alias("at", "probe")).filter("probe IS NOT NULL")
    hits = salted_join(each, table, "probe", "inner").filter("at <> 7 OR code")
    best = hits.groupBy("ref", "source_file").agg(F.min(F.struct("at", "id")).alias("b"))
    step = F.when(F.col("s.b").isNull(), "none").otherwise(F.element_at(F.array(*(F.lit(x) for x in STEPS)), F.col("s.b.at") + 1))
    same = (F.col("r.ref") == F.col("s.ref")) & F.col("r.source_file").eqNullSafe(F.col("s.source_file"))
    return r.alias("r").join(best.alias("s"), same, "left").select(F.col("r.ref").alias("ref"), F.col("r.source_file").alias("source_file"), F.col("s.b.id").alias("id"), step.alias("step"))


def resolve_edges(rels: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ends): the resolved edges (source_id, target_id, kind, description, source_line), and every row with both ends.

    ``ends`` has a row a raw edge (raw_id): sid, tid and ``lost`` where an end is unknown or both are one. Of edges with
    the same ends and kind the first by raw_id stands. Repeated raw rows count once.
    """
    r = rels.select("raw_id", "source_name", "target_name", "kind", "source_file", "description", "source_line").distinct()
    both = r.select(F.col("source_name").alias("ref"), "source_file").unionByName(r.select(F.col("target_name").alias("ref"), "source_file"))
    known = cut(resolve_endpoints(both, table).filter("id IS NOT NULL").select("ref", "source_file", "id"))
    for name, out in (("source_name", "sid"), ("target_name", "tid")):
        r = salted_join(r, known.select(F.col("ref").alias(name), "source_file", F.col("id").alias(out)), [name, "source_file"], "left")
    ends = r.withColumn("lost", F.col("sid").isNull() | F.col("tid").isNull() | (F.col("sid") == F.col("tid")))
    first = F.min_by(F.struct("description", "source_line"), "raw_id").alias("f")
    e = ends.filter("NOT lost").groupBy(F.col("sid").alias("source_id"), F.col("tid").alias("target_id"), "kind").agg(first)
    return e.select("source_id", "target_id", "kind", "f.description", "f.source_line"), ends


def resolver_stats(nodes: DataFrame, m: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """One row of counters: what came in, what became of it, and what was dropped (self edges included, repeats not)."""
    doc = F.exists("sources", lambda x: x.endswith(".md"))
    n = nodes.agg(F.count(F.lit(1)).alias("canonical_nodes"), F.count_if(F.size("sources") >= 2).alias("multi_source_nodes"), F.count_if(F.col("is_code") & doc).alias("code_and_doc_nodes"))
    flags = nodes.select("id", F.col("is_code").alias("c"), doc.alias("d"))
    x = edges.join(flags.select(F.col("id").alias("source_id"), F.col("c").alias("sc"), F.col("d").alias("sd")), "source_id").join(flags.select(F.col("id").alias("target_id"), F.col("c").alias("tc"), F.col("d").alias("td")), "target_id")
    x = x.agg(F.count(F.lit(1)).alias("resolved_edges"), F.count_if((F.col("sc") & F.col("td")) | (F.col("tc") & F.col("sd"))).alias("cross_altitude_edges"))
    e = ends.agg(F.count(F.lit(1)).alias("raw_relationships"), F.count_if("lost").alias("dropped_edges"))
    a = m.agg(F.count(F.lit(1)).alias("raw_entities"), F.count_distinct(F.when(F.col("n_defs") >= 2, F.col("base"))).alias("ambiguous_names"))
    return n.crossJoin(x).crossJoin(e).crossJoin(a)


def drop_buckets(phrases: DataFrame, m: DataFrame, nodes: DataFrame) -> DataFrame:
    """(phrase, bucket) of distinct dropped phrases: why each has no node, ``recoverable`` where it should have one."""
    counts = nodes.filter("is_code").select("id", F.explode(F.array_union(F.array("name"), "aliases")).alias("name")).groupBy("name").agg(F.count_distinct("id").alias("n"))
    files = nodes.filter(F.array_contains("kinds", "module")).select(F.explode("sources").alias("path")).filter(S.is_code_path(F.col("path"))).distinct()
    amb = m.filter("n_defs >= 2").select(F.col("base").alias("key")).distinct()
    p = phrases.select("phrase").distinct().withColumn("cand", S.candidate_bare(F.col("phrase")))
    t = F.trim("phrase")
    head = F.substring_index(t, ":", 1)
    p = p.withColumns({"t": t, "head": head, "nb": S.normalize_name(F.col("cand")), "path": F.regexp_replace(head, r"^[./]+", ""), "last": F.substring_index("cand", ".", -1)})
    p = p.join(files.withColumn("known", F.lit(True)), "path", "left").join(amb.select(F.col("key").alias("nb"), F.lit(True).alias("amb")), "nb", "left")
    p = p.join(counts.select(F.col("name").alias("cand"), "n"), "cand", "left").join(counts.select(F.col("name").alias("last"), F.col("n").alias("n_last")), "last", "left")
    bucket = (
        F.when(F.expr(" OR ".join(f"endswith(head, '{s}')" for s in S.CODE_EXT)) & F.col("known"), "recoverable")
        .when((F.col("cand") == F.col("t")) & F.col("t").contains("/") & ~F.col("t").contains(":") & ~F.expr(" OR ".join(f"endswith(t, '{s}')" for s in S.CODE_EXT)), "directory")
        .when(F.col("cand").isin(*S.STOPLIST) | F.col("nb").isin(*S.STOPLIST) | F.col("amb"), "ambiguous")
        .when(F.col("n") == 1, "recoverable")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("cand").contains(".") & F.col("n_last").isNull(), "external")
        .when(F.size(F.split(t, r"\s+")) >= 3, "prose")
        .otherwise("no_referent")
    )
    return p.select("phrase", bucket.alias("bucket"))


def drop_report(buckets: DataFrame, samples: int = 5) -> DataFrame:
    """(bucket, n_phrases, sample): how many phrases were dropped for each reason, and the first few of each."""
    w = Window.partitionBy("bucket").orderBy("phrase")
    few = buckets.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples).groupBy("bucket").agg(F.concat_ws(", ", F.array_sort(F.collect_list("phrase"))).alias("sample"))
    return buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_phrases")).join(few, "bucket")
