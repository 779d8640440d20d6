"""Measures of a graph and of answers: recall sets, ranks with and without a step, costs, paired resampling, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def recall_sets(keyword: DataFrame, structural: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """(key, signal, priority): what both signals recall (1), structure alone (2) and keywords alone (3).

    ``most`` keeps the first of each item by priority, then by key; it is the size of a report to a classifier.
    """
    j = keyword.select(*key).distinct().withColumn("k", F.lit(True)).join(structural.select(*key).distinct().withColumn("s", F.lit(True)), key, "full")
    p = F.when(F.col("k") & F.col("s"), 1).when(F.col("s"), 2).otherwise(3)
    out = j.select(*key, F.element_at(F.array(F.lit("both"), F.lit("structural"), F.lit("keyword")), p).alias("signal"), p.alias("priority"))
    if most is None:
        return out
    w = Window.partitionBy(key[0]).orderBy("priority", *key[1:])
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def rank_delta(hits: DataFrame) -> DataFrame:
    """(question, off, on, delta): the first rank of a right answer without and with a step; ``hits`` has question, arm, rank, gold.

    An arm that finds none has null, and so has the delta then.
    """
    best = hits.groupBy("question").agg(*(F.min(F.when((F.col("arm") == a) & F.col("gold"), F.col("rank"))).alias(a) for a in ("off", "on")))
    return best.select("question", "off", "on", (F.col("off") - F.col("on")).alias("delta"))


def answer_scores(answers: DataFrame) -> DataFrame:
    """(question, recall, precision, grounding) from arrays gold, cited and known (files that exist); null without a denominator."""
    share = lambda a, b: F.when(F.size(F.array_distinct(b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(b)))
    return answers.select("question", share(F.col("cited"), F.col("gold")).alias("recall"), share(F.col("gold"), F.col("cited")).alias("precision"), share(F.col("known"), F.col("cited")).alias("grounding"))


def cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, n_calls, cache_hit_rate, cost): tokens by their rates a million; a model without a rate has a null cost.

    ``calls`` has model, input_tokens, output_tokens and cached; ``rates`` model, input_rate and output_rate, a price list.
    """
    c = calls.groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), F.avg(F.col("cached").cast("double")).alias("cache_hit_rate"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return c.join(rates, "model", "left").select("model", "n_calls", "cache_hit_rate", ((F.col("i") * F.col("input_rate") + F.col("o") * F.col("output_rate")) / 1e6).alias("cost"))


def paired_bootstrap(spark: SparkSession, pairs: DataFrame, rounds: int = 10_000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(n, mean, low, high): the mean difference of paired scores (``a`` - ``b``) and its interval over ``rounds`` resamples.

    Every question takes part in each round as often as a Poisson variable of mean 1 says, which is drawn from its hash and
    the round's; so questions are read where they lie, and only sums a round are shuffled. Rounds without a question count nothing.
    """
    d = pairs.select(F.xxhash64(*pairs.columns).alias("h"), (F.col("a") - F.col("b")).cast("double").alias("d")).filter("d IS NOT NULL")
    u = (F.pmod(F.xxhash64("h", "r", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    limits, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        limits.append(total)
        p /= k + 1
    times = sum((u > x).cast("int") for x in limits)
    each = d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("t", times).filter("t > 0")
    means = each.groupBy("r").agg((F.sum(F.col("t") * F.col("d")) / F.sum("t")).alias("m"))
    tail = (1 - level) / 2
    low = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean")).crossJoin(low)


def evidence(files: DataFrame, words: list[str], around: int = 1, most: int = 12) -> DataFrame:
    """(path, line_no, line): lines with one of ``words``, each with ``around`` lines on both sides, the first ``most`` of a file."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("low", F.lower("line"))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("low").contains(w.lower())
    near = Window.partitionBy("path").orderBy("p").rowsBetween(-around, around)
    kept = lines.withColumn("near", F.max(hit).over(near)).filter("near")
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("p"))).filter(F.col("r") <= most).select("path", (F.col("p") + 1).alias("line_no"), "line")


def answer_sections(answers: DataFrame, text: str = "text") -> DataFrame:
    """(id, question, title, body) of texts with headings ``## Q1 ...``; what follows a heading ``Scorecard`` is left out."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?ims)^#+ *scorecard\b.*\z", "")
    part = F.explode(F.expr(f"filter(split(x, '(?m)^(?=## *Q[0-9]+)'), s -> s rlike '^## *Q[0-9]+')")).alias("s")
    s = answers.select("id", t.alias("x")).select("id", part)
    title = F.trim(F.regexp_extract("s", r"^## *Q\d+[.:) -]*([^\n]*)", 1))
    return s.select("id", F.regexp_extract("s", r"^## *(Q\d+)", 1).alias("question"), title.alias("title"), F.regexp_replace(F.regexp_replace("s", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def paths_in(text: Column) -> Column:
    """Distinct file paths that a text names, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)*\.[A-Za-z]{1,8})\b"), 1))


def unhedged(lines: DataFrame, col: str = "line") -> DataFrame:
    """Lines that claim something: those that only suppose, or say that nothing was found, are left out."""
    return lines.filter(~F.coalesce(F.lower(col).rlike(r"\b(?:might|may be|perhaps|possibly|probably|unclear|not sure|could not find|no evidence|appears to|seems)\b"), F.lit(False)))


def relative_paths(df: DataFrame, root: str, col: str = "description") -> DataFrame:
    """Descriptions with the absolute paths below ``root`` as relative ones."""
    return df.withColumn(col, F.replace(col, F.lit(root.rstrip("/") + "/"), F.lit("")))


def vocabulary_block(lines: DataFrame, budget: int, order: str = "pos", text: str = "line") -> DataFrame:
    """(pos, line): definition lines (``- term: ...`` or ``**term** ...``) in order, as many as the budget of characters holds."""
    own = lines.filter(F.col(text).rlike(r"^\s*(?:[-*] +\S|\*\*\S)"))
    used = F.sum(F.char_length(text) + 1).over(Window.partitionBy("doc").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("used", used).filter(F.col("used") <= budget).drop("used")
