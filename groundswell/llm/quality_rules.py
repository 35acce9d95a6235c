"""Quality rules that vote, weighed by expectation-maximisation (weak supervision)."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.common import settled, words

SYMBOLS = r"[^#*$%&|<>]"


def features(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_ends, n_lines.

    Everything is computed inside the row by array functions, so nothing is shuffled and no group can be hot; a very
    long text costs its own sort of 3-word windows.
    """
    w = F.col("w")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows = rows.withColumn("w", words(F.col("t")))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")) > 0))
    # Hashes of the 3-word windows with their places, sorted: equal windows are neighbours.
    windows = F.when(F.size("w") >= 3, F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    rows = rows.withColumn("s", windows)
    twice = F.size(F.array_distinct(F.col("s.h"))) < F.size("s")
    rows = rows.withColumn("s", F.when(twice, F.sort_array("s")))
    s = F.col("s")
    same = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])))
    rows = rows.withColumn("p", F.sort_array(F.transform(same, lambda x: x["p"])))
    p = F.col("p")
    # A repeated window at p covers words p, p + 1, p + 2; the next one takes over where it starts.
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")), lambda a: a["n"])
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^.!?]", "")).cast("long").alias("n_ends"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Each looks at one side of a text (``shape`` and ``rhythm`` at what others look at, too, and
    ``rhythm`` strictly),
    says good or bad where that side is plain, and abstains in between."""
    n, c, s, u = F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_upper")
    r, e, d, lines = F.col("n_repeat_words"), F.col("n_ends"), F.col("n_dup_lines"), F.col("n_lines")

    def votes(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": votes(n >= 50, n < 20),
        "word_length": votes((c >= 3 * n) & (c <= 9 * n), (c < 2 * n) | (c > 12 * n)),
        "symbols": votes(s * 50 <= n, s * 20 > n),
        "lines": votes(d == 0, d * 10 > lines * 3),
        "repeats": votes(r * 10 <= n * 2, r * 10 > n * 4),
        "upper": votes(u * 10 <= c, u * 10 > c * 3),
        "ends": votes((e * 100 >= n) & (e * 4 <= n), (n >= 30) & ((e * 200 < n) | (e * 2 > n))),
        "shape": votes((s + u) * 10 <= c, (s + u) * 6 > c),
        "rhythm": votes((n >= 7 * e) & (n <= 11 * e), (n < 6 * e) | (n > 12 * e)),
    }


#: Where EM starts. A text is good, or junk of the kind that one of the rules is against. How often a vote is bad: on good
#: texts, of the rule against a junk text's kind, and of the other rules on it. Each start counts as HELD votes.
BAD_OF_GOOD, BAD_OF_OWN, BAD_OF_OTHER = 0.01, 0.9, 0.1
HELD = 10.0
#: Each kind of junk starts at this share of the texts, and that counts as so much of all documents.
KIND, KIND_HELD = 0.0125, 0.5


def accuracies(patterns: list[tuple[tuple[int, ...], int]], *, kind: float = KIND, rounds: int = 1000, settled_at: float = 1e-9) -> tuple[list[float], list[list[float]]]:
    """(share of each class, how often each rule's vote is bad on each class), by expectation-maximisation over counted vote patterns.

    Class 0 is good; class j + 1 is the junk that rule j is against. Given the class rules vote independently, and
    abstaining says nothing. A rule is right on good texts with 1 - out[0][j] and on its own junk with out[j + 1][j]. One
    whose bad votes stand alone in more texts than junk of one kind is expected in is found to be often wrong; bad
    votes that come together confirm each other. No pattern: the start is returned.
    """
    m = len(patterns[0][0]) if patterns else 0
    start = np.full((m + 1, m), BAD_OF_OTHER)
    start[0] = BAD_OF_GOOD
    start[np.arange(1, m + 1), np.arange(m)] = BAD_OF_OWN
    shares = np.array([1 - kind * m] + [kind] * m)
    first, bad = shares.copy(), start.copy()
    if not patterns:
        return shares.tolist(), bad.tolist()
    votes, n = np.array([v for v, _ in patterns], float), np.array([k for _, k in patterns], float)
    for _ in range(rounds):
        own = _classes(votes, shares, bad) * n[:, None]
        before = np.concatenate([shares, bad.ravel()])
        shares = (own.sum(0) + KIND_HELD * n.sum() * first) / ((1 + KIND_HELD) * n.sum())
        bad = np.clip((own.T @ (votes < 0) + HELD * start) / (own.T @ (votes != 0) + HELD), 1e-5, 1 - 1e-5)
        if np.abs(np.concatenate([shares, bad.ravel()]) - before).sum() < settled_at:
            break
    return shares.tolist(), bad.tolist()


def _classes(votes: np.ndarray, shares: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The probability of each class given each row of votes."""
    log = np.log(shares) + (votes < 0) @ np.log(bad).T + (votes > 0) @ np.log1p(-bad).T
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posterior(votes: tuple[int, ...], shares: list[float], bad: list[list[float]]) -> float:
    """The probability that a text with these votes is good."""
    return float(_classes(np.array([votes], float), np.array(shares), np.array(bad))[0, 0])


def quality_rules(docs: DataFrame, *, threshold: float = 0.5, own_rules: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, the counts of :func:`features`, base_failed, one vote_<rule> column a rule, posterior and kept.

    The vote patterns of all documents are counted (at most 3 ** rules rows, whatever the input), EM on those counts
    estimates each rule's accuracy on good texts and on kinds of junk, and a document is kept if its posterior of being good reaches ``threshold`` and
    it passes the base rules: 50 words or more, and at most half of them in repeated 3-word windows.

    Null text: no words, base_failed. Null doc_id and repeated rows pass through, judged by their text. Empty table:
    empty result. Other columns are not looked at.
    """
    votes = dict(own_rules or rules())
    if not 1 <= len(votes) <= 10:
        raise ValueError("one to ten rules: more have too many vote patterns for the driver")
    rows = settled(features(docs))
    voted = rows.select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    counted = [(tuple(int(r[c]) for c in names), int(r["n"])) for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()]
    shares, bad = accuracies(counted)
    # The odds of good against each kind of junk, from each rule's evidence; junk kinds are summed.
    against = F.lit(0.0)
    for k in range(1, len(shares)):
        log = F.lit(math.log(shares[k] / shares[0]))
        for j, c in enumerate(names):
            log = log + F.when(F.col(c) < 0, math.log(bad[k][j] / bad[0][j])).when(F.col(c) > 0, math.log((1 - bad[k][j]) / (1 - bad[0][j]))).otherwise(0.0)
        against = against + F.exp(log)
    n = F.col("n_words")
    failed = (n < 50) | (F.col("n_repeat_words") * 100 > n * 50)
    out = voted.withColumn("base_failed", failed).withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + against))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
