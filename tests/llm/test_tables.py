"""Matching, ranking, neighbours and leakage."""

import random
from statistics import NormalDist

import numpy as np
import pytest

from graphloom.llm import leakage, matching, neighbours, ranking

ENT = "ent_id long, name string, kind string, source_file string, description string, def_line int, confidence string"


# ---- matching
def tables(spark, code, doc):
    return spark.createDataFrame([(*r, "x") for r in code], ENT), spark.createDataFrame([(*r, None, "x") for r in doc], ENT)


NOUNS = [f"{a}{b}" for a in ("amber", "cedar", "delta", "ember", "flint", "grove", "hazel", "ivory") for b in ("ax", "bow", "cap", "den", "elm", "fig", "gum", "hub")]


def corpus(n=60):
    rng = random.Random(5)
    code, doc, want = [], [], set()
    for i in range(n):
        a, b, x, y = rng.sample(NOUNS, 4)
        num = 100 + i
        code.append((i, f"{a}_{b}", "function", f"proj/src/{a}.py", f"Parses {x} {y} records older than {num} days.", i))
        said = [f"Past an age of {num} days it reads and splits the records of the {y} {x}.", f"Responsible for {y} and {x}: reads their records ({num}).", None][i % 3]
        doc.append((1000 + i, f"{a.title()}{b.title()}", "operation", "proj/README.md", said))
        want.add((i, 1000 + i))
        # the same name about something else is no match
        u, v = rng.sample([w for w in NOUNS if w not in (x, y)], 2)
        doc.append((2000 + i, f"{a} {b}", "operation", "proj/docs/x.md", f"Responsible for {u} and {v}: seals their quotes ({num + 500})."))
    return code, doc, want


def test_matching_finds_what_is_meant(spark):
    code, doc, want = corpus()
    c, d = tables(spark, [*code, code[0], (900, None, None, None, None, None)], [*doc, doc[0], (990, "", None, None, None), (991, "x" * 5000, "k", "portfolio/a.md", "y " * 5000)])
    got = {(r.code_id, r.doc_id): r.confidence for r in matching.matches(c, d).collect()}
    assert len(want & set(got)) >= 0.95 * len(want) and not {p for p in got if 2000 <= p[1] < 3000}
    assert all(0.5 <= v <= 1 for v in got.values())
    assert len({d for _, d in got}) == len(got)


def test_matching_of_empty_tables(spark):
    code, doc, _ = corpus(4)
    c, d = tables(spark, code, doc)
    none_c, none_d = tables(spark, [], [])
    assert matching.matches(none_c, d).count() == matching.matches(c, none_d).count() == matching.matches(none_c, none_d).count() == 0


@pytest.mark.parametrize("code,doc,view", [("StemCell", "stem_cell", 4), ("amber_figs_den", "AmberFgisDen", 3), ("steam_dial", "StmDial", 3), ("quartz_reef", "Reef", 1), ("quartz_reef", "QuartzFig", 2), ("a_delta_reef", "reef delta", 2), ("delta", "ember", 0), ("", "x", 0)])
def test_name_view(code, doc, view):
    assert matching.name_view(code, doc) == view


# ---- ranking
def test_percentiles_against_the_plain_way(spark):
    rng = random.Random(1)
    rows = [("g" if i % 3 else None, f"i{i}", rng.choice([None, float("nan"), 1.0, 2.0, 5e9, -3.5]), float(rng.randrange(6)), "x") for i in range(90)]
    df = spark.createDataFrame(rows, "grp string, item string, a double, b double, score string")
    got = {(r.grp, r.item): r.score for r in ranking.fuse(df, "grp", "item", [("a", True, 1.0), ("b", False, 3.0)], hot_rows=10).collect()}
    want = {}
    for g in ("g", None):
        own = [r for r in rows if r[0] == g]
        for k, sign, w in ((2, 1, 0.25), (3, -1, 0.75)):
            v = {r[1]: (-1e300 if r[k] is None or r[k] != r[k] else sign * r[k]) for r in own}
            for i, x in v.items():
                p = (sum(y < x for y in v.values()) + sum(y == x for y in v.values()) / 2) / len(v)
                want[g, i] = want.get((g, i), 0) + w * NormalDist().inv_cdf(p)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_no_range_decides_alone(spark):
    df = spark.createDataFrame([("g", "a", 1e12, 0.1), ("g", "b", 2.0, 0.9), ("g", "c", 3.0, 0.8), ("g", "d", 1.0, 0.0)], "grp string, item string, x double, y double")
    order = ranking.best(ranking.fuse(df, "grp", "item", [("x", True, 1.0), ("y", True, 1.0)]), "grp", "item", 3).orderBy("position").collect()
    # first and third of each score: the huge value counts no more than the 0.9, and the tie goes to the smaller item
    assert [r.item for r in order] == ["a", "b", "c"] and order[0].score == order[1].score
    assert ranking.fuse(df.limit(0), "grp", "item", [("x", True, 1.0)]).count() == 0


# ---- neighbours
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 32))
    x = np.vstack([base + 0.12 * rng.standard_normal(base.shape) for _ in range(4)] + [rng.standard_normal((200, 32))])
    x = x * rng.uniform(0.5, 3, (len(x), 1))
    rows = [(f"i{k:04d}", v.tolist(), "s") for k, v in enumerate(x)]
    rows += [("zero", [0.0] * 32, "s"), ("none", None, "s"), ("empty", [], "s"), ("other", [1.0, 2.0], "s"), (None, [1.0] * 32, "s"), ("nan", [float("nan")] * 32, "s"), rows[0]]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, cosine string")
    f = np.array([r[1] for r in rows[:-7]], dtype=np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    want = set()
    for i, s in enumerate(f @ f.T):
        s[i] = -9
        for k in sorted(np.nonzero(s >= 0.9)[0], key=lambda k: (-s[k], k))[:5]:
            want.add((min(rows[i][0], rows[k][0]), max(rows[i][0], rows[k][0])))
    got = {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 100


def test_equal_vectors_and_crowded_buckets(spark):
    same = [(f"s{k:03d}", [1.0, 2.0, 3.0, 4.0]) for k in range(50)]
    rng = np.random.default_rng(3)
    crowd = [(f"c{k:03d}", (np.array([4.0, -1, 2, 0]) + 1e-3 * rng.standard_normal(4)).tolist()) for k in range(80)]
    df = spark.createDataFrame([*same, *crowd], "id string, embedding array<float>")
    got = neighbours.neighbours(df, hot=20, block=30).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.other)
    assert set(by["s007"]) == {"s000", "s001", "s002", "s003", "s004"}
    assert all(len(v) <= 5 for v in by.values()) and sum(len(by.get(f"s{k:03d}", [])) for k in range(50)) == 250
    assert sum(bool(by.get(i)) for i, _ in crowd) >= 70
    assert neighbours.neighbour_pairs(df.limit(0)).count() == 0


def test_a_crowded_bucket_of_unlike_vectors_loses_no_pair(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal(64) + 0.28 * rng.standard_normal((300, 64))
    df = spark.createDataFrame([(f"i{k:03d}", v.tolist()) for k, v in enumerate(x)], "id string, embedding array<float>")
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    c = f @ f.T - 9 * np.eye(300)
    want = {(i, j) for i in range(300) for j in np.argsort(-c[i])[:5] if c[i, j] >= 0.9}
    got = {(int(r.id[1:]), int(r.other[1:])) for r in neighbours.neighbours(df, hot=20, block=30).collect()}
    assert len(want) > 1000 and len(want & got) >= 0.97 * len(want)


@pytest.mark.parametrize("rows", [10, 100_000, 1_000_000, 100_000_000, 1_000_000_000])
def test_the_tables_find_what_is_stated_at_any_size(rows):
    plan = neighbours.plan_for(rows, 0.9)
    for cosine in (0.9, 0.92, 0.95):
        one = neighbours.found_share(plan.hashes, cosine, trials=8000, seed=77)[plan.probes - 1]
        assert 1 - (1 - one) ** plan.tables >= 0.95
    assert rows * neighbours.stranger_chance() ** plan.hashes <= neighbours.STRANGERS[1]


# ---- leakage
def passage(rng, n=80):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(9)
    p = [passage(rng) for _ in range(6)]
    fill = lambda n: [f"f{rng.randrange(900)}" for _ in range(n)]
    changed = [w if k % 9 else "zzz" for k, w in enumerate(p[1][10:60])]
    loose = list(p[3])
    rng.shuffle(loose)
    texts = {
        1: " ".join(fill(300) + p[0] + fill(50)),
        2: "<p>" + " ".join(w.upper() if k % 2 else f"<b>{w}</b>,​" for k, w in enumerate(fill(40) + changed)) + "</p>",
        3: " ".join(fill(30) + p[2][:14] + fill(40) + p[2][14:30] + fill(20)),
        4: " ".join(loose),
        5: " ".join(fill(100) + p[4][:11] + fill(100)),
        6: None,
        7: "",
        8: " ".join(fill(20_000) + p[5][20:45]),
        9: " ".join(fill(60)),
    }
    d = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(1, texts[1], "x")], "doc_id long, text string, task_id string")
    t = spark.createDataFrame([(50 + k, " ".join(w), "x") for k, w in enumerate(p)] + [(50, " ".join(p[0]), "x"), (99, None, "x"), (98, "too short", "x"), (None, "x " * 40, "x")], "task_id long, passage string, doc_id string")
    got = {(r.doc_id, r.task_id) for r in leakage.leaks(d, t).collect()}
    assert got == {(1, 50), (2, 51), (3, 52), (8, 55)}
    assert leakage.leaks(d.limit(0), t).count() == 0 and leakage.leaks(d, t.limit(0)).count() == 0


def test_a_passage_in_a_third_of_the_documents_leaks(spark):
    rng = random.Random(4)
    p, few = passage(rng), passage(rng)
    fill = lambda n: [f"f{rng.randrange(100_000)}" for _ in range(n)]
    hot = [(i, " ".join(fill(30 + i % 8) + p + fill(40))) for i in range(100)]
    part = [(100 + i, " ".join(fill(30 + i % 8) + p[i % 50 : i % 50 + 22] + fill(40))) for i in range(40)]
    shared = [(140 + i, " ".join(fill(30 + i % 8) + p[i : i + 11] + fill(40))) for i in range(20)]
    rest = [(160 + i, " ".join(fill(90))) for i in range(140)]
    d = spark.createDataFrame([*hot, *part, *shared, *rest, (500, " ".join(fill(30) + few + fill(30)))], "doc_id long, text string")
    t = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(few))], "task_id long, passage string")
    assert {(r.doc_id, r.task_id) for r in leakage.leaks(d, t).collect()} == {(i, 1) for i in range(140)} | {(500, 2)}


def test_texts_in_other_words_leak_with_an_answer(spark):
    rng = random.Random(8)
    p = [passage(rng) for _ in range(3)]
    fill = lambda n: [f"f{rng.randrange(900)}" for _ in range(n)]
    other = [x for k, w in enumerate(p[0]) for x in ([w] if k % 3 else fill(2))]
    d = spark.createDataFrame([(1, " ".join(fill(60) + other + ["see", "src/deep/place.py"])), (2, " ".join(fill(60) + other)), (3, " ".join(fill(30) + p[1] + fill(9))), (4, "src/deep/place.py " + " ".join(fill(90)))], "doc_id long, text string")
    t = spark.createDataFrame([(k, " ".join(w), ["src/deep/place.py", "x", None]) for k, w in enumerate(p)], "task_id long, passage string, gold array<string>")
    got = {(r.doc_id, r.task_id): (r.how, r.n_answers) for r in leakage.leaks(d, t, answer_col="gold").collect()}
    assert got == {(1, 0): ("paraphrase", 1), (3, 1): ("passage", 0)}
    # one pass a passage gives the same
    again = {(r.doc_id, r.task_id): (r.how, r.n_answers) for r in leakage.leaks(d, t, answer_col="gold", pass_words=50).collect()}
    assert again == got


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(0)
    dense = (rng.random((7, 11)) < 0.3) * rng.random((7, 11))
    a = leakage.Sparse([(np.flatnonzero(r), r[r != 0]) for r in dense])
    dense = dense[dense.any(1)]
    block = rng.random((11, 3))
    assert np.allclose(a.times(block), dense @ block)
    terms, back = a.back(dense @ block)
    full = np.zeros((11, 3))
    full[terms] = back
    assert np.allclose(full, dense.T @ dense @ block)


def test_alignment_is_nearly_without_gaps():
    a = np.arange(30)
    assert leakage.align(a, a)[0] == 30
    assert leakage.repeated(a, np.concatenate([a[:12], np.full(30, 99), a[12:24]])) == 24
    assert leakage.repeated(a, a[::-1].copy()) < 20
    assert leakage.align(a, np.array([], dtype=int))[0] == 0
