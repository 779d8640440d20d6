"""Evaluation passages that occur in a corpus, whole or in part and not always letter by letter."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
#: Words of a window of a document and between two, and words of a window of a passage and between two.
WINDOW, SLIDE, SPAN, STEP = 24, 8, 45, 22
#: Rank of the latent space, and the cosine in it from which a window is looked at word by word.
RANK, COSINE = 256, 0.25
#: A term in at most this share of the documents, or in so few of them, is telling. The latent space is asked about windows
#: of three such terms; where LEAST words of a passage hold fewer than SEEDS of them, its terms are sought one by one.
TELLING, FEW = 0.05, 50
#: Terms of one passage, in its order but for DRIFT words and within REACH words, that have a place looked at word by word
#: whatever the terms weigh. 20 words found at the price of 13 lost, the most that an alignment bears, leave 6 terms.
SEEDS, REACH, DRIFT = 6, 33, 8
#: Terms of a passage without which no alignment of LEAST words comes about, be it interrupted; and of LEAST repeated words
#: those that stand beside a neighbour of theirs, so that a phrase that many documents share is not taken for a beginning.
SHARED, BESIDE = 5, 16
#: Words that are aligned at once, besides what lies around them.
STRETCH = 2000
#: Words of a passage that must be repeated, words of the smaller part of an interrupted one, and of the interruption.
LEAST, PART, INTERRUPTION = 20, 6, 160
#: Share of a passage's words that a text in other words must keep in order, beside one of the task's answers.
KEPT = 0.5
#: Words of the passages that one pass over the corpus serves: their terms make up the block of the SVD on the driver.
PASS_WORDS = 40_000


def words(text: str) -> list[str]:
    """Lower-case words without markup, invisible characters and punctuation; compatibility forms are unified."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text).replace("­", "").replace("​", "")
    return _WORD.findall(text.lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """(matched, a0, a1, b0, b1): the best local alignment of two rows of word ids.

    A common word counts 1, a changed, dropped or added one -1.5, so what is found runs nearly without gaps: it is a
    longest common subsequence in which every three words lost cost five words found.
    """
    if not len(a) or not len(b):
        return 0, 0, 0, 0, 0
    j = np.arange(1, len(b) + 1, dtype=np.float32) * np.float32(1.5)
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=np.float32)
    same = a[:, None] == b[None, :]
    step = same * np.float32(2.5) - np.float32(1.5)
    some = same.any(1)
    t, u, live = np.empty(len(b), np.float32), np.empty(len(b), np.float32), False
    for i in range(len(a)):
        if not live and not some[i]:
            continue  # nothing is open and nothing begins
        np.add(h[i, :-1], step[i], out=t)
        np.subtract(h[i, 1:], np.float32(1.5), out=u)
        np.maximum(t, u, out=t)
        np.maximum(t, 0, out=t)
        np.add(t, j, out=t)
        np.maximum.accumulate(t, out=t)
        np.subtract(t, j, out=h[i + 1, 1:])
        live = h[i + 1].max() > 0
    np.maximum(h, 0, out=h)
    i, k = np.unravel_index(int(np.argmax(h)), h.shape)
    a1, b1, matched = int(i), int(k), 0
    while i > 0 and k > 0 and h[i, k] > 1e-3:
        same = a[i - 1] == b[k - 1]
        if abs(h[i, k] - (h[i - 1, k - 1] + (1.0 if same else -1.5))) < 1e-2:
            matched += bool(same)
            i, k = i - 1, k - 1
        elif abs(h[i, k] - (h[i - 1, k] - 1.5)) < 1e-2:
            i -= 1
        else:
            k -= 1
    return matched, int(i), a1, int(k), b1


def repeated(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the passage ``a`` that ``b`` repeats in order and nearly without gaps, interrupted once at most."""
    m, a0, a1, b0, b1 = align(a, b)
    if m >= LEAST or m < PART:
        return m
    # the rest of the passage may go on behind an interruption, or may have begun before one
    later, la0, *_ = align(a[max(0, a1 - 1) :], b[b1 : b1 + INTERRUPTION + len(a)])
    sooner = align(a[: a0 + 1], b[max(0, b0 - INTERRUPTION - len(a)) : b0])
    more = max(later if la0 <= 4 else 0, sooner[0] if a0 - sooner[2] <= 3 else 0)
    return m + more if more >= PART else m


def kept_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """The most words of the passage ``a`` that a stretch of ``b`` of twice its length holds in order (longest common subsequence)."""
    best, wide = 0, 2 * len(a)
    for at in range(0, max(1, len(b) - len(a)), max(1, len(a))):
        part = b[at : at + wide]
        h = np.zeros(len(part) + 1, dtype=np.int32)
        for w in a:
            h[1:] = np.maximum(h[1:], h[:-1] + (part == w))
            np.maximum.accumulate(h, out=h)
        best = max(best, int(h[-1]))
    return best


def beside(place: np.ndarray, stand: np.ndarray) -> int:
    """Words of a passage that a text keeps beside their neighbours, in one part or two.

    ``place`` and ``stand``: where terms of the passage stand in the text and in the passage. A part is the terms whose
    shift differs by DRIFT at most; a second one goes on within DRIFT words of the passage and INTERRUPTION of the text.
    """
    shift = place - stand
    order = np.argsort(shift, kind="stable")
    s = shift[order]
    upto = np.searchsorted(s, s + DRIFT, "right")
    k = int(np.argmax(upto - np.arange(len(s))))
    band = order[k : upto[k]]

    def words_of(at: np.ndarray) -> int:
        return len(np.union1d(stand[at], stand[at] + 1))

    first, s0, s1, p0, p1 = words_of(band), stand[band].min(), stand[band].max(), place[band].min(), place[band].max()
    more = 0
    for side in ((stand > s1) & (stand <= s1 + LEAST) & (place > p1) & (place <= p1 + INTERRUPTION + LEAST), (stand < s0) & (stand >= s0 - LEAST) & (place < p0) & (place >= p0 - INTERRUPTION - LEAST)):
        rest = np.flatnonzero(side)
        if len(rest):
            t = np.sort(shift[rest])
            if abs(stand[rest] - (s1 if stand[rest[0]] > s1 else s0)).min() <= DRIFT:
                u = np.searchsorted(t, t + DRIFT, "right")
                i = int(np.argmax(u - np.arange(len(t))))
                more = max(more, words_of(rest[(shift[rest] >= t[i]) & (shift[rest] <= t[i] + DRIFT)]))
    return first + more


class Sparse:
    """Rows of weighted terms; multiplied as they are, without the zeros between."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        rows = [r for r in rows if len(r[0])]
        self.n = len(rows)
        self.term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(self.n), [len(t) for t, _ in rows]) if rows else np.zeros(0, np.int64)

    def times(self, block: np.ndarray) -> np.ndarray:
        """rows x block, one column at a time."""
        return np.stack([np.bincount(self.row, self.value * c[self.term], minlength=self.n) for c in block.T], 1) if self.n else np.zeros((0, block.shape[1]))

    def back(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, transposed rows x block) for the terms that occur."""
        terms, at = np.unique(self.term, return_inverse=True)
        return terms, np.stack([np.bincount(at, self.value * c[self.row], minlength=len(terms)) for c in block.T], 1) if self.n else np.zeros((0, block.shape[1]))


class Terms:
    """The terms of the passages: pairs of adjacent words. Maps a text to its words' numbers and its terms' numbers."""

    def __init__(self, passages: list[list[str]]):
        self.vocab = {x: i for i, x in enumerate(sorted({x for w in passages for x in w}))}
        self.size = len(self.vocab) + 1  # the last number stands for every other word
        self.codes = np.unique(np.concatenate([self._codes(self.numbers(w)) for w in passages]))

    def numbers(self, w: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, w, repeat(len(self.vocab))), np.int64, len(w))

    def _codes(self, at: np.ndarray) -> np.ndarray:
        return at[:-1] * self.size + at[1:]

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms): where terms of the passages stand in a row of words, and which."""
        code = self._codes(at)
        k = np.searchsorted(self.codes, code)
        k[k == len(self.codes)] = 0
        place = np.flatnonzero(self.codes[k] == code)
        return place, k[place]


class Probe:
    """What every task needs to search documents: the terms, their weights, the latent basis and the passages."""

    def __init__(self, terms: Terms, idf: np.ndarray, telling: np.ndarray, rare: float, basis: np.ndarray, of: np.ndarray, latent: np.ndarray, passages: list[tuple[int, np.ndarray]], answers: dict[str, list[int]]):
        self.answers, self._auto = answers, None
        self.terms, self.idf, self.rare, self.passages, self.of, self.latent = terms, idf, rare, passages, of, latent
        self.rows = (basis * idf[:, None]).astype(np.float32)
        self.telling = telling
        self.own = []
        for _, p in passages:
            at, own = terms.of(p)
            order = np.argsort(own, kind="stable")
            self.own.append((own[order], at[order]))
        # the passages and places that hold each term, one term's after the other's, where LEAST words are short of telling terms
        rows = []
        for i, (_, p) in enumerate(passages):
            at, own = terms.of(p)
            short = np.convolve(telling[own], np.ones(LEAST - 1), "valid") < SEEDS
            keep = np.convolve(short, np.ones(LEAST - 1)) > 0
            rows.append((own[keep], np.full(np.count_nonzero(keep), i), at[keep]))
        term, who, at = map(np.concatenate, zip(*rows))
        order = np.argsort(term, kind="stable")
        self.held, self.stands = who[order], at[order]
        self.first = np.append(0, np.cumsum(np.bincount(term, minlength=len(idf))))

    def close(self, at: np.ndarray, place: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passages, words at which windows begin): windows that come close to a passage in the latent space."""
        telling = self.telling[term]
        if np.count_nonzero(telling) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.arange(0, max(1, len(at) - WINDOW + SLIDE), SLIDE)
        end = np.minimum(start + WINDOW - 1, len(at) - 1)
        weight = np.full(len(at) - 1, self.rare**2)
        weight[place] = self.idf[term] ** 2
        weight = np.append(0, np.cumsum(weight))
        place, term = place[telling], term[telling]
        a, b = np.searchsorted(place, start), np.searchsorted(place, end)
        norm = np.sqrt(weight[end] - weight[start])
        # a projection is no longer than what is projected
        most = np.append(0, np.cumsum(self.idf[term] ** 2))
        maybe = np.flatnonzero((b - a >= 3) & (np.sqrt(most[b] - most[a]) >= COSINE * norm))
        if not len(maybe):
            return maybe, maybe
        upto = np.zeros((len(term) + 1, self.rows.shape[1]), np.float32)
        np.cumsum(self.rows[term], axis=0, out=upto[1:])
        sums = upto[b[maybe]] - upto[a[maybe]]
        # nor has a window a greater cosine than its length in the space, as passages have unit length
        far = np.sqrt(np.einsum("ij,ij->i", sums, sums)) >= COSINE * norm[maybe]
        maybe, sums = maybe[far], sums[far]
        if not len(maybe):
            return maybe, maybe
        w, q = np.nonzero(sums @ self.latent / norm[maybe, None] >= COSINE)
        return self.of[q], start[maybe[w]]

    def seeded(self, place: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passages, words): places where SEEDS terms of one passage stand nearly as they stand in it.

        Only parts of passages that are short of telling terms are sought so. Weights have no say here: a passage that stands in a large part of the documents makes its own terms common, and
        rare words beside them would then hide it from the latent space.
        """
        k = SEEDS - 1
        if not len(self.held):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        per = self.first[term + 1] - self.first[term]
        i = np.repeat(self.first[term] - np.cumsum(per) + per, per) + np.arange(per.sum())
        who, where = self.held[i], np.repeat(place, per)
        shift = where - self.stands[i] + (1 << 20)
        out = []
        # bands of shifts overlap by half, so a drift of DRIFT words lies in one of them
        for off in (0, DRIFT):
            key = (who << 40) + (shift + off) // (2 * DRIFT)
            order = np.argsort(key, kind="stable")
            key, w = key[order], where[order]
            near = np.flatnonzero((key[k:] == key[:-k]) & (w[k:] - w[:-k] < REACH)) if len(key) > k else order[:0]
            out.append((key[near] >> 40, w[near]))
        return tuple(map(np.concatenate, zip(*out)))

    def candidates(self, at: np.ndarray, place: np.ndarray, term: np.ndarray) -> tuple[set[int], dict[int, list[tuple[int, int]]]]:
        """(passages that windows come close to, passage number to the spans of words in which they do or hold its terms)."""
        if len(place) < 3:
            return set(), {}
        near = self.close(at, place, term)
        p, s = map(np.concatenate, zip(near, self.seeded(place, term)))
        order = np.lexsort((s, p))
        out: dict[int, list[tuple[int, int]]] = {}
        for i, x in zip(p[order].tolist(), s[order].tolist()):
            spans = out.setdefault(i, [])
            if spans and x - spans[-1][1] <= 2 * (len(self.passages[i][1]) + INTERRUPTION) and x - spans[-1][0] <= STRETCH:
                spans[-1] = spans[-1][0], x + WINDOW
            else:
                spans.append((x, x + WINDOW))
        return set(near[0].tolist()), out

    def answered(self, w: list[str]) -> dict[int, int]:
        """Passage number to how many of its task's answers a text holds."""
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for a, of in self.answers.items():
                self._auto.add_word(f" {a} ", (a, of))
            self._auto.make_automaton()
        seen = {a: of for _, (a, of) in self._auto.iter(f" {' '.join(w)} ")} if self.answers else {}
        return Counter(i for of in seen.values() for i in of)

    def search(self, text: str) -> list[tuple[int, int, int, str]]:
        """(task, words repeated, answers held, how) of the passages that leaked into one text."""
        w = words(text)
        if len(w) < LEAST:
            return []
        at = self.terms.numbers(w)
        held = self.answered(w)
        found = {}
        place, term = self.terms.of(at)
        near, cands = self.candidates(at, place, term)
        for p, spans in cands.items():
            passage = self.passages[p][1]
            wide = len(passage) + INTERRUPTION
            terms, stands = self.own[p]
            left, right = np.searchsorted(terms, term, "left"), np.searchsorted(terms, term, "right")
            for lo, hi in spans:
                lo, hi = max(0, lo - wide), hi + wide
                a, b = np.searchsorted(place, (lo, hi))
                per = (right - left)[a:b]
                if np.count_nonzero(per) < SHARED:
                    continue
                if p not in near:
                    i = np.repeat(left[a:b] - np.cumsum(per) + per, per) + np.arange(per.sum())
                    if beside(np.repeat(place[a:b], per), stands[i]) < BESIDE:
                        continue
                if (m := repeated(passage, at[lo:hi])) >= LEAST:
                    found[p] = max(found.get(p, (0,)), (m,))
        found = {p: (m, "passage") for p, (m,) in found.items()}
        for p in held.keys() - found.keys():
            passage = self.passages[p][1]
            if (m := kept_in_order(passage, at)) >= KEPT * len(passage):
                found[p] = m, "paraphrase"
        return [(self.passages[p][0], m, held.get(p, 0), how) for p, (m, how) in found.items()]


def document_frequencies(docs: DataFrame, terms: Terms, text_col: str) -> tuple[np.ndarray, int]:
    """(documents that hold each term, all documents), over all documents; a task sums its own documents first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(terms.codes), np.int64), 0
        for f in frames:
            for t in f.iloc[:, 0]:
                if t:
                    n += 1
                    w = words(t)
                    if len(w) > 1:
                        total[np.unique(terms.of(terms.numbers(w))[1])] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"w": np.append(-1, some), "n": np.append(n, total[some])})

    rows = docs.select(text_col).mapInPandas(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(terms.codes))
    for w, n in rows:
        if w >= 0:
            df[w] = n
    return df, next((n for w, n in rows if w == -1), 0)


def randomised_svd(tasks: DataFrame, vectors: Callable, width: int, rank: int, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """The ``rank`` leading right singular vectors (width x rank) of the matrix whose sparse rows ``vectors`` makes of ``tasks``.

    Randomised subspace iteration: each round multiplies the rows' Gram matrix with an orthonormal block. Tasks multiply
    their own rows and give a row a term that occurs in them; these are summed by term before the driver reads one block of
    width x (rank + 10), whose size depends on PASS_WORDS and never on the corpus.
    """
    k = min(rank + 10, width)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]
    for _ in range(rounds + 1):
        now = block

        def run(frames: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            for f in frames:
                a = vectors(f.iloc[:, 1])
                term, rows = a.back(a.times(now))
                yield pd.DataFrame({"term": term, "part": [r.tobytes() for r in rows]})

        def add(g: pd.DataFrame) -> pd.DataFrame:
            term, at = np.unique(g["term"].to_numpy(), return_inverse=True)
            total = np.zeros((len(term), k))
            np.add.at(total, at, np.frombuffer(b"".join(g["part"])).reshape(len(g), k))
            return pd.DataFrame({"term": term, "part": [r.tobytes() for r in total]})

        parts = tasks.mapInPandas(run, "term int, part binary").groupBy(F.pmod("term", F.lit(16))).applyInPandas(add, "term int, part binary").toLocalIterator()
        block = np.zeros((width, k))
        for term, part in parts:
            block[term] = np.frombuffer(part)
        block = np.linalg.qr(block)[0]
    return block[:, : min(rank, k)]


def leaks(docs: DataFrame, tasks: DataFrame, doc_col: str = "doc_id", text_col: str = "text", task_col: str = "task_id", passage_col: str = "passage", answer_col: str | None = None, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, task_id, n_words, n_answers, how): documents into which a task's passage leaked, once each.

    ``how`` is ``passage`` where at least LEAST of its words are repeated in order and nearly without gaps, and
    ``paraphrase`` where KEPT of them stand in order, however far apart, in a text that also holds one of the task's
    answers (``answer_col``, an array; answers of less than two words are none). The passages are a held-out set and
    are broadcast; each ``pass_words`` of them take a pass over the corpus, so there may be any number. Their terms,
    pairs of adjacent words, are weighted by their frequency over all documents; the windows of the passages span a
    latent space by a randomised SVD; every window of every document is placed in it, and those close to a passage's
    window by cosine, or holding SEEDS terms of a part of it that is short of telling ones, are aligned with the passage
    word by word. An interruption is at most INTERRUPTION words long, and the smaller part at least PART. A null or short
    text repeats nothing; a passage under LEAST words cannot leak; a null passage is none. Repeated tasks give one row;
    extra columns are left out.
    """
    answers = F.col(answer_col) if answer_col else F.lit(None)
    clean = tasks.select(F.col(task_col).cast("long").alias("t"), F.col(passage_col).alias("p"), answers.cast("array<string>").alias("a")).filter("t IS NOT NULL AND p IS NOT NULL").distinct()
    kind = docs.schema[doc_col].dataType.simpleString()
    out = f"`{doc_col}` {kind}, `{task_col}` long, n_words int, n_answers int, how string"
    blocks: list[list] = [[]]
    size = 0
    for t, p, a in sorted((t, p, a or []) for t, p, a in clean.toLocalIterator()):
        w = words(p)
        if len(w) >= LEAST:
            if size and size + len(w) > pass_words:
                blocks.append([])
                size = 0
            size += len(w)
            blocks[-1].append((t, w, a))
    if not blocks[0]:
        return docs.sparkSession.createDataFrame([], out)
    found = None
    for rows in blocks:
        some = _leaks_of(docs, rows, doc_col, text_col, task_col, out)
        found = some if found is None else found.unionByName(some)
    best = F.max(F.struct((F.col("how") == "passage").alias("whole"), "n_words", "n_answers", "how")).alias("b")
    return found.groupBy(doc_col, task_col).agg(best).select(doc_col, task_col, "b.n_words", "b.n_answers", "b.how")


def _leaks_of(docs: DataFrame, rows: list[tuple[int, list[str], list[str]]], doc_col: str, text_col: str, task_col: str, out: str) -> DataFrame:
    """The leaks of one block of passages, by one count of its terms and one search over all documents."""
    spark = docs.sparkSession
    terms = Terms([w for _, w, _ in rows])
    df, n = document_frequencies(docs, terms, text_col)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    rare = math.log(n + 1) + 0.1

    def windows(w: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for s in range(0, max(1, len(w) - SPAN + STEP), STEP) if len(w) > 1 else ():
            term, times = np.unique(terms.of(terms.numbers(w[s : s + SPAN]))[1], return_counts=True)
            v = times * idf[term]
            found.append((term, v / max(np.linalg.norm(v), 1e-9)))
        return found

    few = spark.createDataFrame([(t, " ".join(w)) for t, w, _ in rows], "t long, p string").repartition(max(1, min(64, len(rows) // 50)))
    basis = randomised_svd(few, lambda texts: Sparse([x for p in texts for x in windows(p.split(" "))]), len(idf), RANK)
    own = [windows(w) for _, w, _ in rows]
    latent = Sparse([x for o in own for x in o]).times(basis)
    of = np.repeat(np.arange(len(rows)), [sum(1 for x in o if len(x[0])) for o in own])
    passages = [(t, terms.numbers(w)) for t, w, _ in rows]
    answers: dict[str, list[int]] = {}
    for i, (_, _, a) in enumerate(rows):
        for x in {" ".join(words(x)) for x in a if x}:
            if " " in x:
                answers.setdefault(x, []).append(i)
    shared = spark.sparkContext.broadcast(Probe(terms, idf, (df <= FEW) | (df <= TELLING * n), rare, basis, of, latent.T.astype(np.float32), passages, answers))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = shared.value
        for f in frames:
            hits = [(d, *hit) for d, x in zip(f.iloc[:, 0], f.iloc[:, 1]) if x for hit in probe.search(x)]
            yield pd.DataFrame(hits, columns=[doc_col, task_col, "n_words", "n_answers", "how"])

    return docs.select(doc_col, text_col).mapInPandas(run, out)
