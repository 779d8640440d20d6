"""Source trees: walking, scopes, tree hashes, snapshots of a graph, logs and caches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as S

#: Parts of paths that are no sources, and files that are written by the views.
SKIPPED = frozenset((".git", "node_modules", "__pycache__", "dist", "build", "out", "coverage"))
GENERATED = frozenset(("AGENTS.md", "CLAUDE.md"))


def walk(spark: SparkSession, root: str, also_skip: tuple[str, ...] = ()) -> DataFrame:
    """(path): files below ``root`` by their relative paths, without hidden and skipped parts and written views.

    The driver lists the root alone; each of its directories is walked by a task. ``root`` is local or of any file system
    that Arrow opens by its address. Names that begin with ``_`` are kept. Rows are in no order.
    """
    skip = SKIPPED | set(also_skip)

    def opened() -> tuple[fs.FileSystem, str]:
        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        return files, base.rstrip("/")

    def listed(files: fs.FileSystem, base: str, rel: str) -> tuple[list[str], list[str]]:
        dirs, names = [], []
        for x in files.get_file_info(fs.FileSelector(f"{base}/{rel}".rstrip("/"))):
            n = x.base_name
            if n.startswith("."):
                continue
            at = f"{rel}/{n}" if rel else n
            if x.type == fs.FileType.Directory and n not in skip:
                dirs.append(at)
            elif x.type == fs.FileType.File and n not in GENERATED:
                names.append(at)
        return dirs, names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = opened()
        for f in frames:
            left = list(f["path"])
            while left:
                dirs, names = listed(files, base, left.pop())
                left += dirs
                yield pd.DataFrame({"path": names}, dtype=object)

    dirs, names = listed(*opened(), "")
    top = spark.createDataFrame([(n,) for n in names], "path string")
    if not dirs:
        return top
    return top.unionByName(spark.createDataFrame([(x,) for x in dirs], "path string").repartition(len(dirs)).mapInPandas(run, "path string"))


def read(paths: DataFrame, root: str) -> DataFrame:
    """(path, text, digest): contents as UTF-8 with replacement; a file that cannot be read has nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f["path"]:
                try:
                    with open(os.path.join(root, p), "rb") as fh:
                        out.append((p, fh.read()))
                except OSError:
                    out.append((p, None))
            yield pd.DataFrame(out, columns=["path", "raw"])

    raw = paths.select("path").mapInPandas(run, "path string, raw binary")
    return raw.select("path", F.decode("raw", "UTF-8").alias("text"), F.sha2("raw", 256).alias("digest"))


def scopes(paths: DataFrame) -> DataFrame:
    return paths.select(S.scope_of(F.col("path")).alias("scope")).distinct()


def tree_hash(files: DataFrame) -> DataFrame:
    """(tree_hash) over (path, digest) in order of the paths' parts; that of an empty tree is the hash of "empty"."""
    parts = F.split("path", "/")
    g = files.agg(F.array_sort(F.collect_list(F.struct(parts.alias("p"), F.col("path").alias("s"), F.col("digest").alias("h")))).alias("l"))
    return g.select(F.sha2(F.when(F.size("l") == 0, "empty").otherwise(F.array_join(F.transform("l", lambda x: F.concat(x["s"], x["h"])), "")), 256).alias("tree_hash"))


def unpack_vectors(df: DataFrame, raw_col: str, out_col: str) -> DataFrame:
    """Packed native float32 bytes as array<float>; null and ragged bytes give an empty vector."""

    @F.pandas_udf("array<float>")
    def unpack(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, np.float32).tolist() if b and len(b) % 4 == 0 else [])

    return df.withColumn(out_col, unpack(raw_col))


def transcript_costs(spark: SparkSession, path: str) -> DataFrame:
    """(session, n_turns, n_tools, n_failed, n_repeated, tokens) of JSON-lines transcripts; bad lines are skipped.

    ``content`` may be a string or a list of blocks; a repeated read is a tool call of the same session and input.
    """
    schema = "session string, type string, usage struct<input_tokens:long,output_tokens:long>, content string, tools array<struct<name:string,input:string,error:boolean>>"
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").filter("session IS NOT NULL")
    tokens = F.coalesce("usage.input_tokens", F.lit(0)) + F.coalesce("usage.output_tokens", F.lit(0))
    turns = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(tokens).alias("tokens"))
    calls = rows.select("session", F.explode("tools").alias("t"))
    used = calls.groupBy("session").agg(F.count(F.lit(1)).alias("n_tools"), F.count_if(F.coalesce("t.error", F.lit(False))).alias("n_failed"), (F.count(F.lit(1)) - F.count_distinct("t.name", F.coalesce("t.input", F.lit("")))).alias("n_repeated"))
    return turns.join(used, "session", "left").fillna(0, ["n_tools", "n_failed", "n_repeated"])


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) that no cache row answers, once a key."""
    w = Window.partitionBy("key").orderBy(*(c for c in wanted.columns if c != "key"))
    return wanted.join(cache.select("key").distinct(), "key", "left_anti").withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def cache_key(model: str, ontology_hash: str, context: str, text_col: str):
    return F.sha2(F.concat_ws(":", F.lit("v5"), F.lit(model), F.lit(ontology_hash), F.lit(context), F.col(text_col)), 256)


def write_snapshot(df: DataFrame, table_dir: str, commit: str) -> None:
    """Replaces the partition of one graph_commit. The old files stay until the job commits the new ones, which are staged apart."""
    df.withColumn("graph_commit", F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_commit").parquet(table_dir)


def append_journal(spark: SparkSession, path: str, command: str, args: list[str], ms: int, code: int, commit: str | None) -> None:
    row = spark.range(1).select(F.expr("uuid()").alias("uuid"), F.current_timestamp().alias("at"), F.lit(command).alias("command"), F.array(*map(F.lit, args)).cast("array<string>").alias("args"), F.lit(ms).alias("duration_ms"), F.lit(code).alias("exit_code"), F.lit(commit and commit[:8]).cast("string").alias("graph_commit"))
    row.write.mode("append").json(path)
