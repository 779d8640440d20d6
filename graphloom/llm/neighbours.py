"""The most similar vectors of every vector, by multiprobe p-stable hashing and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import cut, salted_join, small_enough

#: Width of a bucket on unit vectors.
WIDTH = 2.0
#: Share of the pairs at the bound that the tables are to find, whatever the number of rows.
RECALL = 0.97
#: Probes a table, the vector's own bucket included, that a plan may choose from.
PROBES = (2, 3, 4, 6, 8, 12)
#: Unrelated vectors that one probe may meet, by expectation: from the least to the most.
STRANGERS = (4.0, 100.0)
#: Coordinates whose perturbations are tried, alone, in pairs and in threes.
LOOSE = 7
#: Bytes of an entry that is shuffled, and what a comparison of two sketches costs beside such a byte.
ENTRY, COMPARE = 40, 0.5


class Plan(NamedTuple):
    """Hashes a table, tables, probes a table, and the bits (of 128) in which the sketches of a pair may differ."""

    hashes: int
    tables: int
    probes: int
    bits: int


def stranger_chance() -> float:
    """Chance that one hash puts two unrelated unit vectors, which are the root of 2 apart, into one bucket."""
    t = WIDTH / math.sqrt(2)
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def found_share(hashes: int, least: float, trials: int = 6000, seed: int = 5) -> np.ndarray:
    """Of pairs with a cosine of ``least``, the share that one table finds with 1, 2, ... of the most probes of PROBES.

    Pairs are drawn, not taken from data: projections of two vectors that far apart differ by a normal variable. They
    go through the very keys that the tables are made of, and either may be the one that probes.
    """
    rng = np.random.default_rng(seed)
    x = rng.random((trials, 1, hashes)) * 1000
    y = x + rng.standard_normal(x.shape) * math.sqrt(2 - 2 * least) / WIDTH
    mult = rng.integers(1, 1 << 62, (1, hashes), dtype=np.int64) * 2 + 1
    kx, ky = probe_keys(x, mult, PROBES[-1]), probe_keys(y, mult, PROBES[-1])
    hit = (kx == ky[:, :, :1]) | (ky == kx[:, :, :1])
    return np.maximum.accumulate(hit[:, 0], axis=1).mean(0)


@lru_cache(maxsize=64)
def plan_for(rows: int, least: float, recall: float = RECALL) -> Plan:
    """The cheapest tables that find ``recall`` of the pairs at ``least`` among ``rows`` vectors.

    More hashes a table keep the unrelated vectors that a probe meets few as rows grow; what that loses of the pairs is
    made up by more tables. Cost is the entries that are shuffled and the sketches that are compared.
    """
    angle = math.acos(least) / math.pi
    bits = math.ceil(128 * angle + 4.4 * math.sqrt(128 * angle * (1 - angle)))
    chance = stranger_chance()
    best = None
    for m in range(4, 200):
        strangers = rows * chance**m
        if strangers > STRANGERS[1] and m < 199:
            continue
        if strangers < STRANGERS[0] and best:
            break
        share = found_share(m, least)
        for probes in PROBES:
            p = float(share[min(probes, len(share)) - 1]) - 0.005
            tables = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p)) if p > 0.002 else 10_000
            cost = tables * (probes + 1) * ENTRY + COMPARE * tables * probes * strangers
            if best is None or cost < best[0]:
                best = cost, Plan(m, tables, probes, bits)
    return best[1]


@lru_cache(maxsize=32)
def _planes(dim: int, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    n = plan.tables * plan.hashes
    return rng.standard_normal((dim, n)).astype(np.float32), rng.random(n).astype(np.float32), rng.integers(1, 1 << 62, n, dtype=np.int64) * 2 + 1, rng.standard_normal((dim, 128)).astype(np.float32)


@lru_cache(maxsize=1)
def _subsets() -> list[tuple[int, ...]]:
    return [c for k in (1, 2, 3) for c in combinations(range(LOOSE), k)]


def probe_keys(y: np.ndarray, mult: np.ndarray, probes: int) -> np.ndarray:
    """(rows, tables, probes) keys of the buckets that projections ``y`` (rows, tables, hashes) visit, most promising first.

    The first is the bucket that the vector itself lies in. The others perturb the coordinates that lie closest to a
    border, by one each, in the order of the summed squares of their distances to those borders.
    """
    m = y.shape[2]
    cell = np.floor(y)
    inside = y - cell
    with np.errstate(over="ignore"):
        base = (cell.astype(np.int64) * mult).sum(2)
        low = inside < 0.5
        score = np.where(low, inside, 1 - inside) ** 2
        near = np.argsort(score, axis=2)[:, :, :LOOSE]
        s = np.take_along_axis(score, near, 2)
        d = np.take_along_axis(np.where(low, -1, 1).astype(np.int64) * mult, near, 2)
        subsets = [c for c in _subsets() if max(c) < min(LOOSE, m)]
        cost = np.stack([s[:, :, list(c)].sum(2) for c in subsets], 2)
        k = min(probes - 1, len(subsets))
        if k < 1:
            return base[:, :, None]
        top = np.argpartition(cost, k - 1, axis=2)[:, :, :k]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(cost, top, 2), axis=2), 2)
        shift = np.stack([d[:, :, list(c)].sum(2) for c in subsets], 2)
        return np.concatenate([base[:, :, None], base[:, :, None] + np.take_along_axis(shift, top, 2)], 2)


def buckets(unit: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables, probes) bucket keys of unit vectors, and their sketches of two 64-bit words."""
    n, dim = unit.shape
    a, b, mult, sk = _planes(dim, plan)
    y = (unit @ a * np.float32(1 / WIDTH) + b).reshape(n, plan.tables, plan.hashes)
    with np.errstate(over="ignore"):
        salt = ((np.arange(plan.tables, dtype=np.int64) + 1) * np.int64(7919) + np.int64(dim) * np.int64(104729)) * np.int64(0x9E3779B97F4A7C1)
        keys = probe_keys(y, mult.reshape(plan.tables, plan.hashes), plan.probes) + salt[None, :, None]
    return keys, np.packbits(unit @ sk > 0, axis=1).view(np.int64)


def usable(chunks: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): one row an id with a vector that has a direction; null, empty, zero and non-finite vectors are left out.

    Where an id has unlike vectors the smallest in order counts.
    """
    v = F.col(vec_col).cast("array<float>")
    ok = F.size(v) > 0
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return chunks.select(F.col(id_col).cast("string").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(ok & sound).groupBy("id").agg(F.min("v").alias("v"))


def _entries(reps: DataFrame, plan: Plan, probes: bool) -> DataFrame:
    """(bucket, h, s1, s2) of every vector: its own buckets, or all probes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby(f["v"].map(len)):
                for at in range(0, len(g), 1024):
                    part = g.iloc[at : at + 1024]
                    x = np.stack(part["v"].to_list()).astype(np.float32)
                    x /= np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
                    keys, sk = buckets(x, plan if probes else plan._replace(probes=1))
                    per = keys.shape[1] * keys.shape[2]
                    yield pd.DataFrame({"bucket": keys.reshape(-1), "h": np.repeat(part["h"].to_numpy(), per), "s1": np.repeat(sk[:, 0], per), "s2": np.repeat(sk[:, 1], per)})

    return reps.select("h", "v").mapInPandas(run, "bucket long, h long, s1 long, s2 long")


def _crowded(index: DataFrame, probe: DataFrame, reps: DataFrame, full: DataFrame, block: int, k: int, least: float) -> DataFrame:
    """(a, b), a < b: of every vector that probes a crowded bucket, the best of that bucket, compared exactly.

    Both sides are dealt into parts of about ``block`` members and each part meets each, so no task holds a bucket. A
    meeting gives the ``k`` + 8 best of each vector at most, some more than can count, for what single precision mixes up.
    """
    parts = full.withColumn("n", F.ceil(F.col("count") / block).cast("int"))
    deal = lambda c: F.pmod(F.xxhash64("h", F.lit(c)), F.col("n")).cast("int").alias(c)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(c)
    members = index.select("bucket", "h").join(parts, "bucket").select("bucket", "h", deal("i"), each("j")).join(reps, "h")
    asking = probe.select("bucket", "h").join(parts, "bucket").select("bucket", "h", deal("j"), each("i")).join(reps, "h")

    def meet(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for dim, g in m.groupby(m["v"].map(len)):
            x, hx = np.stack(g["v"].to_list()).astype(np.float64), g["h"].to_numpy()
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            ask = q[q["v"].map(len) == dim]
            for at in range(0, len(ask), 1024):
                part = ask.iloc[at : at + 1024]
                y, hy = np.stack(part["v"].to_list()).astype(np.float64), part["h"].to_numpy()
                c = (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32) @ x.T
                c[hy[:, None] == hx[None, :]] = -2
                top = np.argpartition(-c, min(k + 8, len(hx)) - 1, axis=1)[:, : k + 8]
                r, t = np.nonzero(np.take_along_axis(c, top, 1) >= least - 1e-5)
                a.append(hy[r])
                b.append(hx[top[r, t]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return members.groupBy("bucket", "i", "j").cogroup(asking.groupBy("bucket", "i", "j")).applyInPandas(meet, "a long, b long")


def _pairs(reps: DataFrame, plan: Plan, hot: int, block: int, k: int, least: float) -> DataFrame:
    """(a, b), a < b: vectors that share a probed bucket and whose sketches are close.

    Buckets of more than ``hot`` vectors, which would give all pairs of their members, are compared exactly, in parts,
    and give the best of each vector only.
    """
    index = cut(_entries(reps, plan, False))
    full = cut(index.groupBy("bucket").count().filter(F.col("count") > hot))
    any_hot = bool(full.take(1))
    if small_enough(full, 200_000):
        full = F.broadcast(full)
    keep = index.join(full, "bucket", "left_anti") if any_hot else index
    probe = _entries(reps, plan, True)
    near = (
        probe.join(keep.select("bucket", F.col("h").alias("h2"), F.col("s1").alias("t1"), F.col("s2").alias("t2")).hint("shuffle_hash"), "bucket")
        .filter((F.col("h") != F.col("h2")) & (F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= plan.bits))
        .select(F.least("h", "h2").alias("a"), F.greatest("h", "h2").alias("b"))
        .distinct()
    )
    return near.unionByName(_crowded(index, probe, reps, full, block, k, least)).distinct() if any_hot else near


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null where a vector has no direction or the dimensions differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def neighbours(chunks: DataFrame, k: int = 5, least: float = 0.9, id_col: str = "id", vec_col: str = "embedding", hot: int = 256, block: int = 4096) -> DataFrame:
    """(id, other, cosine): the ``k`` most similar other ids of every id, as far as their cosine is at least ``least``.

    Every vector is indexed and every vector is a query, in whichever scope. Candidates come from the tables' buckets;
    the cosine of each is then computed exactly, and ties go to the smaller id. Equal vectors are one in the search;
    each of their ids has the others first, without all pairs of them being formed. Tables, probes and sketches are set
    to ``least`` and to the number of unlike vectors so that of the pairs at that very cosine RECALL are found, and
    more of closer ones (:func:`plan_for`). Buckets of more than ``hot`` vectors are compared exactly, in parts.
    """
    own = usable(chunks, id_col, vec_col).withColumn("h", F.xxhash64("v"))
    own = cut(own)
    reps = own.groupBy("h").agg(F.min("v").alias("v"))
    reps = cut(reps)
    pairs = _pairs(reps, plan_for(reps.count(), least), hot, block, k, least)
    both = pairs.join(reps.select(F.col("h").alias("a"), F.col("v").alias("va")), "a").join(reps.select(F.col("h").alias("b"), F.col("v").alias("vb")), "b")
    near = both.withColumn("cosine", cosine(F.col("va"), F.col("vb"))).filter(F.col("cosine") >= least).select("a", "b", "cosine")
    near = cut(near)
    # the first ids of every set of equal vectors are all that anyone can have among its k best
    first = Window.partitionBy("h").orderBy("id")
    heads = own.select("h", "id").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select(F.col("h").alias("h2"), F.col("id").alias("other"))
    links = near.select(F.col("a").alias("h"), F.col("b").alias("h2"), "cosine").unionByName(near.select(F.col("b").alias("h"), F.col("a").alias("h2"), "cosine"))
    multi = own.groupBy("h").count().filter("count > 1").select("h", F.col("h").alias("h2"), F.lit(1.0).alias("cosine"))
    ranked = Window.partitionBy("h").orderBy(F.col("cosine").desc(), "other")
    lists = links.unionByName(multi).join(heads, "h2").withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1).select("h", "other", "cosine", "r")
    mine = salted_join(own.select("h", "id"), lists, "h", "inner").filter(F.col("id") != F.col("other"))
    best = Window.partitionBy("id").orderBy("r")
    return mine.withColumn("p", F.row_number().over(best)).filter(F.col("p") <= k).select("id", "other", "cosine")


def neighbour_pairs(chunks: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """(id_a, id_b), the smaller first: pairs of which one is among the other's ``k`` most similar, once each."""
    n = neighbours(chunks, k, least)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
