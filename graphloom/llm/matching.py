"""Matching records of two tables that share no key, by several partial and noisy attributes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import cut, salted_join, small_enough

#: Hashes of the MinHash signature of each attribute.
HASHES = 32
#: Words that names wear in prose and that say nothing about what is named.
DRESS = frozenset("the a an of service manager component class module function method type file handler".split())
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_PAREN = re.compile(r"\([^)]*\)")
_FILE = re.compile(r"[\w@.-]+(?:/[\w@.-]+)*\.[A-Za-z]{1,8}\b")
_LINE = re.compile(r":(\d+)\b|\(?lines? (\d+)\)?")
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"(?<![\w/.])\d+(?![\w/])")
_HASHES = np.random.default_rng(11).integers(1, 1 << 62, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def name_words(name: str) -> list[str]:
    return [w for w in _WORD.findall(_CAMEL.sub(r"\1 \2", _PAREN.sub(" ", name)).lower()) if w not in DRESS]


def bone(word: str) -> str:
    """The first letters of a word without its vowels: the same for a word and its usual abbreviations."""
    return (word[0] + re.sub("[aeiou]", "", word[1:]))[:3]


def places(text: str) -> tuple[list[str], str | None]:
    """(paths, line) that a text refers to."""
    paths = _FILE.findall(text or "")
    line = _LINE.search(text or "") if paths else None
    return paths, (line.group(1) or line.group(2)) if line else None


def said(text: str | None) -> tuple[list[str], set[str]]:
    """(words, numbers) of a description, without the paths and lines in it."""
    t = _FILE.sub(" ", text or "")
    t = re.sub(r"\(line \d+\)|:\d+\b", " ", t).lower()
    return [w for w in _WORD.findall(t) if len(w) > 3], set(_NUMBER.findall(t))


def signature(tokens: set[str]) -> list[int]:
    """MinHash of the pairs of a set of tokens: the elements that are least under any of the hashes.

    Pairs are what makes a record telling: two that share a single word share no pair. A single token stands for itself.
    """
    t = sorted(tokens)
    pairs = [f"{a} {b}" for i, a in enumerate(t) for b in t[i + 1 :]] or t
    if not pairs:
        return []
    x = np.array([xxhash.xxh64_intdigest(p) for p in pairs], dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = x[:, None] * _HASHES[0] + _HASHES[1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x[np.unique(h.argmin(0))].astype(np.int64).tolist()


def near(a: str, b: str) -> bool:
    """Whether two words are equal or one slip of the pen apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def short(a: str, b: str) -> bool:
    """Whether ``a`` is a short form of ``b``: its beginning, or it without vowels but for the first letter."""
    return len(a) < len(b) and (len(a) > 2 and b.startswith(a) or a == b[0] + re.sub("[aeiou]", "", b[1:]))


def name_view(code: str, doc: str) -> int:
    """0 unlike, 1 a part of it, 2 all but one word, 3 the same but for short forms and slips, 4 the same words."""
    a, b = name_words(code), name_words(doc)
    if not a or not b:
        return 0
    if a == b:
        return 4
    rest = list(a)
    hit = 0
    for w in b:
        k = next((x for x in rest if near(x, w)), None) or next((x for x in rest if short(w, x)), None)
        if k is not None:
            rest.remove(k)
            hit += 1
    if hit == len(a) == len(b):
        return 3 if all(near(x, y) or short(y, x) for x, y in zip(a, b)) else 2
    if hit == len(b) and hit < len(a):
        return 1
    return 2 if len(a) > 1 and hit >= max(len(a), len(b)) - 1 and hit else 0


def place_view(source: str, line: object, name: str, text: str | None) -> int:
    """0 no place named, 1 another file, 2 its file, 3 its file and line, 4 its file but another line."""
    paths, at = places(f"{text or ''} ")
    inside = _FILE.findall(" ".join(_PAREN.findall(name)))
    if not paths and not inside:
        return 0
    own = any(source == p or source.endswith("/" + p) for p in [*paths, *inside])
    if not own:
        return 1
    if at is None or line is None or line != line:
        return 2
    return 3 if int(line) == int(at) else 4


def text_view(code: str | None, doc: str | None, common: frozenset[str]) -> tuple[int, int, int]:
    """(telling words shared, numbers, common words shared).

    Words: 0 none though both have some, 1, 2 (or more, or all), 3 nothing to compare. Numbers: 0 unlike, 1 equal, 2 not both.
    Common words: 0 none, 1 some, 2 nothing to compare.
    """
    (a, n), (b, m) = said(code), said(doc)
    ta, tb = {w for w in a if w not in common}, {w for w in b if w not in common}
    hit = sum(any(near(x, y) for y in tb) for x in ta)
    words = 3 if not ta or not tb else 2 if hit == len(ta) else min(2, hit)
    numbers = 2 if not n or not m else int(bool(n & m))
    ca, cb = {w for w in a if w in common}, {w for w in b if w in common}
    return words, numbers, 2 if not ca or not cb else int(any(x == y or x[:5] == y[:5] for x in ca for y in cb))


def records(table: DataFrame) -> DataFrame:
    """One row an ent_id; repeated rows count once. A null name is an empty one."""
    cols = ["name", "kind", "source_file", "description", "def_line"]
    return table.filter("ent_id IS NOT NULL").groupBy(F.col("ent_id").cast("long").alias("ent_id")).agg(F.max(F.struct(*cols)).alias("r")).select("ent_id", F.coalesce("r.name", F.lit("")).alias("name"), F.lower(F.trim(F.coalesce("r.kind", F.lit("")))).alias("kind"), F.coalesce("r.source_file", F.lit("")).alias("source_file"), F.col("r.description").alias("description"), F.col("r.def_line").cast("int").alias("def_line"))


def with_project(code: DataFrame, doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``project``; a document of ``portfolio/`` has the projects that its description names."""
    first = F.substring_index("source_file", "/", 1)
    code = code.withColumn("project", first)
    doc = doc.withColumn("project", first)
    names = code.select("project").distinct()
    told = doc.filter("project = 'portfolio'").select("ent_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("description", F.lit(""))), r"[^a-z0-9_.-]+"))).alias("project"))
    told = told.withColumn("project", F.regexp_replace("project", r"^[.:-]+|[.:-]+$", "")).join(names, "project", "left_semi").distinct()
    return code, doc.filter("project <> 'portfolio'").unionByName(doc.drop("project").join(told, "ent_id").select(*doc.columns))


def common_words(code: DataFrame, doc: DataFrame, share: float = 0.02, manner: float = 0.003, times: float = 8, least: int = 5) -> frozenset[str]:
    """Words that tell nothing: those of more than ``share`` of all descriptions, and the documents' manner of speaking.

    The latter are words of more than ``manner`` of the mentions that are ``times`` as frequent there as with the
    definitions. At least ``least`` descriptions must hold a word. With some 30 words a description no more than
    30 / manner words can qualify, however large the tables.
    """
    every = code.select("description", F.lit(0).alias("side")).unionByName(doc.select("description", F.lit(1).alias("side"))).filter("description IS NOT NULL")
    n, m = every.agg(F.count(F.lit(1)), F.sum("side")).first()
    w = F.explode(F.array_distinct(F.split(F.lower("description"), r"[^a-z]+")))
    c = every.select(w.alias("w"), "side").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("m"))
    there, here = F.col("m") / max(m or 0, 1), (F.col("n") - F.col("m") + 0.5) / max(n - (m or 0), 1)
    rows = c.filter((F.col("n") >= least) & ((F.col("n") > share * n) | ((there > manner) & (there > times * here)))).select("w").collect()
    return frozenset(r[0] for r in rows)


def candidates(code: DataFrame, doc: DataFrame, common: frozenset[str]) -> DataFrame:
    """(code_id, doc_id): records of one project that share an element of the MinHash of an attribute, or a place.

    Names, descriptions (telling words and numbers) and places are signed one by one, so two records meet if any one of
    them is alike. Keys hold the project, and common words are left out, so a key gathers no more than the records of one project that
    bear one name; mentions beyond 20,000 a key are dealt to several tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, project, name, text, source, line in f[["ent_id", "project", "name", "description", "source_file", "def_line"]].itertuples(index=False):
                words, numbers = said(text)
                own = {w for w in words if w not in common}
                keys = [("n", k) for k in signature({bone(w) for w in name_words(name)})]
                keys += [("d", k) for k in signature({bone(w) + w[-1] for w in own} | numbers)]
                paths, at = places(text)
                spots = {(p, at or "") for p in paths} | {(p, "") for p in _FILE.findall(" ".join(_PAREN.findall(name)))}
                if line == line and line is not None:
                    spots.add((source, str(int(line))))
                spots.add((source, ""))
                keys += [("p", f"{p.rsplit('/', 1)[-1]}:{a}") for p, a in spots if a or p.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower().replace("_", "") == "".join(name_words(name))]
                out += [(i, xxhash.xxh64_intdigest(f"{project}|{a}|{k}") - (1 << 63)) for a, k in set(keys)]
            yield pd.DataFrame(out, columns=["ent_id", "key"])

    a = code.mapInPandas(run, "ent_id long, key long")
    b = doc.mapInPandas(run, "ent_id long, key long")
    left, right = b.select(F.col("ent_id").alias("doc_id"), "key"), a.select(F.col("ent_id").alias("code_id"), "key")
    return salted_join(left, right, "key", "inner", hot_rows=20_000).select("code_id", "doc_id").distinct()


def views(code: DataFrame, doc: DataFrame, pairs: DataFrame, common: frozenset[str]) -> DataFrame:
    """Pairs with their similarity features: nm, pl, tw, tn, tc and both kinds."""
    cols = ["ent_id", "name", "kind", "source_file", "description", "def_line"]
    j = pairs.join(code.select(*(F.col(c).alias(f"c_{c}") for c in cols)).dropDuplicates(["c_ent_id"]), F.col("code_id") == F.col("c_ent_id"))
    j = j.join(doc.select(*(F.col(c).alias(f"d_{c}") for c in cols)).dropDuplicates(["d_ent_id"]), F.col("doc_id") == F.col("d_ent_id"))
    j = j.select("code_id", "doc_id", "c_name", "d_name", "c_source_file", "c_def_line", "c_description", "d_description", "c_kind", "d_kind")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, d, cn, dn, src, line, ct, dt, ck, dk in f.itertuples(index=False):
                rows.append((c, d, name_view(cn, dn), place_view(src, line, dn, dt), *text_view(ct, dt, common), f"{ck}~{dk}"))
            yield pd.DataFrame(rows, columns=["code_id", "doc_id", "nm", "pl", "tw", "tn", "tc", "kinds"])

    return j.mapInPandas(run, "code_id long, doc_id long, nm int, pl int, tw int, tn int, tc int, kinds string")


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last column of ``x`` is the constant."""
    b = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - pull * b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


#: Features of a pair and how many values each has: name, place, telling words, numbers, common words, pair of kinds.
FEATURES = (("nm", 5), ("pl", 5), ("tw", 4), ("tn", 3), ("tc", 3), ("kd", 5))


#: What the weights of all labelled pairs sum to.
FIT_WEIGHT = 3000.0


def design(f: pd.DataFrame) -> np.ndarray:
    """One column a value of each feature, one a pair of values of two features, and the constant."""
    one = [np.eye(n)[f[c].to_numpy(int)] for c, n in FEATURES]
    both = [(a[:, :, None] * b[:, None, :]).reshape(len(f), a.shape[1] * b.shape[1]) for i, a in enumerate(one) for b in one[i + 1 :]]
    return np.hstack([*one, *both, np.ones((len(f), 1))])


def weak_labels(f: pd.DataFrame) -> np.ndarray:
    """1, 0, or -1 for none: votes of the single features, as far as they do not contradict each other.

    For a match vote a like name (twice if its words are the same), all telling words, an equal number, the file, and
    (twice) the line. Against it vote an unlike name, no telling word (twice under an unlike name), another file, and
    (twice each) unlike numbers and another line. Two votes for and none against make a match; two against that
    outnumber those for, or an unlike name without any vote for, make none. Every other pair has no label: what becomes of it
    is the classifier's to say, as is the confidence of all.
    """
    like, none = f.nm >= 3, f.tw == 0
    pro = like.astype(int) + (f.nm == 4) + (f.tw == 2) + (f.tn == 1) + (f.pl == 2) + 2 * (f.pl == 3)
    con = 2 * (f.tn == 0) + 2 * (f.pl == 4) + (f.pl == 1) + (f.nm == 0) + none + (none & ~like)
    return np.where((pro >= 2) & (con == 0), 1, np.where((con >= 2) & (con > pro) | (pro == 0) & ~like, 0, -1))


def kind_levels(pairs: DataFrame) -> DataFrame:
    """(kinds, kd): how much a pair of kinds speaks for a match, in five levels; 2 where too little is known.

    Odds are those among pairs with the same telling words and number, or the same line, against pairs that share nothing.
    """
    own = F.count_if(F.expr("(tw = 2 AND tn = 1) OR pl = 3")).alias("yes")
    alien = F.count_if(F.expr("tw = 0 AND tn = 0 AND nm = 0")).alias("no")
    k = pairs.groupBy("kinds").agg(own, alien)
    total = k.agg(F.sum("yes").alias("ys"), F.sum("no").alias("ns"))
    odds = F.log((F.col("yes") + 1) / (F.col("ys") + 20)) - F.log((F.col("no") + 1) / (F.col("ns") + 20))
    level = F.when(odds < -1.5, 0).when(odds < -0.5, 1).when(odds <= 0.5, 2).when(odds <= 1.5, 3).otherwise(4)
    return k.crossJoin(F.broadcast(total)).select("kinds", level.cast("int").alias("kd"))


class Model(NamedTuple):
    """Weights of the columns of :func:`design`, slope and shift of the calibration, and its table on held-out pairs."""

    weights: np.ndarray
    slope: float
    shift: float
    reliability: pd.DataFrame

    def probability(self, f: pd.DataFrame) -> np.ndarray:
        z = design(f) @ self.weights * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(counts: pd.DataFrame) -> Model:
    """A logistic model over features and their pairs, from weak labels, calibrated on held-out pairs.

    ``counts`` has the number of pairs by features and by ``part`` (0 fits the weights, 1 the calibration), so every
    pair takes part while the driver sees one row a combination of features, of which there are 2 x 4,500 at most.
    """
    label = weak_labels(counts)
    w = counts["count"].to_numpy(float)
    fit, held = (label >= 0) & (counts.part == 0), (label >= 0) & (counts.part == 1)
    x = design(counts)
    if not fit.any() or len(set(label[fit])) < 2:
        fit = label >= 0
    if not fit.any():
        return Model(np.zeros(x.shape[1]), 1.0, 0.0, pd.DataFrame())
    # weights sum to the same whatever the number of pairs, so the pull to zero means the same at every size
    b = _fit(x[fit], label[fit].astype(float), w[fit] * (FIT_WEIGHT / w[fit].sum()), ridge=0.3)
    slope, shift = 1.0, 0.0
    z = x @ b
    if held.any() and len(set(label[held])) == 2:
        slope, shift = _fit(np.stack([z[held], np.ones(held.sum())], 1), label[held].astype(float), w[held], ridge=1e-3)
    model = Model(b, float(slope), float(shift), pd.DataFrame())
    p = model.probability(counts[held])
    bins = pd.DataFrame({"bin": np.minimum((p * 10).astype(int), 9), "p": p * w[held], "y": label[held] * w[held], "n": w[held]}).groupby("bin").sum()
    table = pd.DataFrame({"pairs": bins.n, "mean_confidence": bins.p / bins.n, "share_of_matches": bins.y / bins.n})
    return model._replace(reliability=table)


def scored_pairs(code: DataFrame, doc: DataFrame) -> tuple[DataFrame, Model]:
    """All candidate pairs with their features and confidence, and the model behind it."""
    code, doc = with_project(records(code), records(doc))
    code, doc = cut(code), cut(doc)
    common = common_words(code, doc)
    pairs = cut(views(code, doc, candidates(code, doc, common), common))
    levels = cut(kind_levels(pairs))
    if small_enough(levels, 100_000):
        pairs = pairs.join(F.broadcast(levels), "kinds")
    else:
        pairs = salted_join(pairs, levels, "kinds", "inner")
    names = [c for c, _ in FEATURES]
    part = F.pmod(F.xxhash64("code_id", "doc_id"), F.lit(2)).alias("part")
    counts = pairs.groupBy(*names, part).count().toPandas()
    model = train(counts)
    every = counts[names].drop_duplicates().reset_index(drop=True)
    every["confidence"] = model.probability(every) if len(every) else np.zeros(0)
    schema = ", ".join(f"{c} int" for c in names) + ", confidence double"
    table = code.sparkSession.createDataFrame([tuple(int(x) for x in r[:-1]) + (float(r[-1]),) for r in every.itertuples(index=False)], schema)
    return pairs.join(F.broadcast(table), names), model


def matches(code: DataFrame, doc: DataFrame, least: float = 0.5) -> DataFrame:
    """(code_id, doc_id, confidence): each mention with the definition that it most probably means, if any.

    Candidates come from :func:`candidates`, their features from :func:`views`, the confidence from the model that
    :func:`train` fits and calibrates; a pair is taken if and only if its confidence is ``least`` or more and no other
    definition of that mention has more. Equal confidences go to the closer name, then to the smaller id. A definition
    may have many mentions. Null descriptions, kinds and names are no evidence either way. Empty tables give no row.
    """
    scored, _ = scored_pairs(code, doc)
    best = Window.partitionBy("doc_id").orderBy(F.col("confidence").desc(), F.col("nm").desc(), "code_id")
    taken = scored.filter(F.col("confidence") >= least).withColumn("r", F.row_number().over(best)).filter("r = 1")
    return taken.select("code_id", "doc_id", F.round("confidence", 6).alias("confidence"))
