"""Queries of the table functions over formats, and of the streaming windows on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.catalog import query
from graphloom.runtime import spread, table
from graphloom.sources import chunkers, parsers
from graphloom.streaming import ingest


def _parsed(spark: SparkSession, d: str, *suffixes: str) -> DataFrame:
    files = parsers.files_of_chunks(table(spark, d, "chunks"))
    low = F.lower("path")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | low.endswith(s)
    return parsers.extract(files.filter(keep))


def _register(name: str, *suffixes: str) -> None:
    query(name)(lambda spark, d: _parsed(spark, d, *suffixes))


_register("parse_python", ".py")
_register("parse_javascript", ".ts", ".js")
_register("parse_rust", ".rs")
_register("parse_terraform", ".tf")
_register("parse_yaml", ".yaml", ".yml")
_register("parse_graphql", ".graphql")


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk(spread(table(spark, d, "documents")), "doc_id", "text", "markdown")


@query("chunk_prose")
def chunk_prose(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk(spread(table(spark, d, "documents")), "doc_id", "text", "prose")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
