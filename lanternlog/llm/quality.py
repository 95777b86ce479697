"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, however many documents) estimates how often each rule is right in either
class, and a document's posterior probability of being good replaces a filter that all rules must pass.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_marked_words", "n_stops", "n_distinct")
SENTENCE_END = tuple(".!?")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text; a null text has no words. Words in windows of three that occur twice or more are repeated."""
    text = text or ""
    words = WORDS.findall(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    repeated = 0
    if len(ids) > 3:
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) < 1 << 20:
            windows = pairs[:-1] * len(number) + ids[2:]
        else:  # too many words for one number a window
            windows = np.unique(pairs[:-1], return_inverse=True)[1] * len(number) + ids[2:]
        _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        inside = np.zeros(len(ids), bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        repeated = int(inside.sum())
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(any(c in SYMBOLS for c in w) or w.endswith("!!") for w in words)
    stops = sum(w.endswith(SENTENCE_END) for w in words)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), lines, dup, repeated, upper, marked, stops, len(number)


def with_counts(df: DataFrame, text: str, name: str = "counts") -> DataFrame:
    """Adds a struct of the counts of a text column."""
    ship(df.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS))

    return df.withColumn(name, counted(F.col(text)))


GOOD, ABSTAIN, BAD = 1, 0, -1
#: What is held of a rule before any text is seen: it seldom votes bad on a good text and catches a part of the bad ones;
#: this counts as much as that share of the texts.
RIGHT_ON_GOOD, RIGHT_ON_BAD, PRIOR_WEIGHT = 0.98, 0.4, 0.02


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int")


def votes(c: Column) -> dict[str, Column]:
    """The rules over a struct of counts: name -> vote. On a text without words all but the length rule abstain."""
    n = c.n_words
    some = n > 0
    share = lambda x: F.when(some, x / n)
    return {
        "length": _vote(n < 5, n >= 100),
        "word_length": _vote((share(c.word_chars) < 2.5) | (share(c.word_chars) > 9), share(c.word_chars).between(3, 7)),
        "symbols": _vote(share(c.n_symbols) > 0.1, share(c.n_symbols) < 0.02),
        "marked_words": _vote(share(c.n_marked_words) > 0.2, share(c.n_marked_words) < 0.02),
        "repetition": _vote(share(c.n_repeat_words) > 0.3, share(c.n_repeat_words) < 0.1),
        "duplicate_lines": _vote(c.n_dup_lines > 0.3 * c.n_lines, some & (c.n_dup_lines == 0)),
        "capitals": _vote(share(c.n_upper_words) > 0.3, share(c.n_upper_words) < 0.05),
        "sentences": _vote(share(c.n_stops) > 0.5, share(c.n_stops).between(0.03, 0.25)),
        "variety": _vote(share(c.n_distinct) < 0.15, share(c.n_distinct) > 0.4),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, how often each rule that votes is right on good texts, and on bad ones), by
    expectation-maximisation from a vote in which bad votes weigh more, with a prior that rules are mostly right."""
    n = counts.astype(float)
    good, bad = (patterns == GOOD).astype(float), (patterns == BAD).astype(float)
    q = 1 / (1 + np.exp(-(good.mean(1) - 4 * bad.mean(1)) * 4)) if patterns.size else np.zeros(len(n))
    prior = PRIOR_WEIGHT * n.sum() + 1
    share, right_good, right_bad = 0.5, np.full(patterns.shape[1], RIGHT_ON_GOOD), np.full(patterns.shape[1], RIGHT_ON_BAD)
    for _ in range(rounds):
        a, b = n * q, n * (1 - q)
        share = (a.sum() + 1) / (n.sum() + 2)
        right_good = (a @ good + prior * RIGHT_ON_GOOD) / (a @ (good + bad) + prior)
        right_bad = (b @ bad + prior * RIGHT_ON_BAD) / (b @ (good + bad) + prior)
        new = posterior(patterns, share, right_good, right_bad)
        done = np.abs(new - q).max(initial=0.0) < 1e-10
        q = new
        if done:
            break
    return float(share), right_good, right_bad


def posterior(patterns: np.ndarray, share: float, right_good: np.ndarray, right_bad: np.ndarray) -> np.ndarray:
    """Probability that a text is good given its votes; abstentions say nothing."""
    good, bad = (patterns == GOOD).astype(float), (patterns == BAD).astype(float)
    odds = np.log(share) - np.log(1 - share) + good @ np.log(right_good / (1 - right_bad)) + bad @ np.log((1 - right_good) / right_bad)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge_counts(counted: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds _votes (a struct of the rules' votes), _quality (posterior probability) and _good (at least `least`) to a table
    with _counts, which is read twice and should be a settled one."""
    rules = votes(F.col("_counts"))
    voted = counted.withColumn("_votes", F.struct(*(v.alias(k) for k, v in rules.items())))
    seen = voted.groupBy(*(F.col(f"_votes.{k}").alias(k) for k in rules)).count().collect()  # at most 3 ** rules rows
    patterns = np.array([r[:-1] for r in seen], np.int64).reshape(-1, len(rules))
    share, right_good, right_bad = fit_votes(patterns, np.array([r[-1] for r in seen], np.int64))
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for i, k in enumerate(rules):
        for vote, weight in ((GOOD, np.log(right_good[i] / (1 - right_bad[i]))), (BAD, np.log((1 - right_good[i]) / right_bad[i]))):
            odds = odds + F.when(F.col(f"_votes.{k}") == vote, F.lit(float(weight))).otherwise(0.0)
    return voted.withColumn("_quality", 1 / (1 + F.exp(-odds))).withColumn("_good", F.col("_quality") >= least)


def judge(docs: DataFrame, text: str = "text", least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row (all, if not given) with _counts, _votes, _quality and _good.

    The texts are counted once; counts and kept columns are settled. A null or empty text has no words: its length rule votes
    bad and all others abstain. Repeated rows are judged alike and counted as often as they occur. Columns with the added names
    are replaced. An empty table is returned as it is, with the added columns."""
    counted = with_counts(docs, text, "_counts")
    return judge_counts(settle(counted.select(*keep, "_counts") if keep else counted), least)


def base_failed(c: Column) -> Column:
    return (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, whether it fails the base rules, and whether it is kept."""
    c = F.col("_counts")
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id",
        *(F.col(f"_counts.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(c).alias("base_failed"),
        (~base_failed(c) & F.col("_good")).alias("kept"),
        F.col("_quality").alias("quality"),
    )
