"""Session, table access, lineage cuts and skew helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "graphloom", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with the settings that the operators expect; an existing one is returned as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder of spark.checkpoint.dir.

    A temporary folder stands in only for a session on one machine without that setting, as in tests; it goes when the
    process ends. On a cluster a session without the setting is refused, as the folder of one machine would be lost with it.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores; used before costly per-row work.

    A small table of few, large row groups would otherwise keep most cores idle. A large one has partitions enough and
    is not shuffled.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than one row beyond."""
    return df.limit(most_rows + 1).count() <= most_rows


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | list[str],
    how: str = "left",
    hot_rows: int = 200_000,
    most_hot: int = 100_000,
) -> DataFrame:
    """Join on ``keys`` where some keys of ``left`` may hold a large part of all rows.

    Keys with more than ``hot_rows`` rows in ``left`` are found by a pre-aggregated count and get as many salts as they
    have times ``hot_rows`` rows; only their partners in ``right`` are repeated, once a salt. The list of hot keys goes
    through the driver, is broadcast and holds the ``most_hot`` largest at most: a key beyond it has less than 1 / ``most_hot`` of all rows and
    is joined whole like every other key. Without a hot key this is a plain join. Null keys join nothing.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = left.dropna(subset=keys).groupBy(*keys).count().filter(F.col("count") > hot_rows)
    salts = F.ceil(F.col("count") / hot_rows).cast("int").alias("__n")
    hot = counts.orderBy(F.col("count").desc()).limit(most_hot).select(*keys, salts)
    rows = hot.collect()
    if not rows:
        return left.join(right.hint("merge"), keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    lsalt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__n")).cast("int"), F.lit(0))
    l2 = left.join(hot, keys, "left").withColumn("__salt", lsalt).drop("__n")
    r2 = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1))).drop("__n")
    return l2.join(r2.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def norm_kind(c: Column) -> Column:
    """A kind without the letter case and blanks that sources disagree on; null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
