"""Quality rules combined by weak supervision (built-in functions only).

Every rule looks at counts of a whole text and votes good (1), bad (-1) or
abstains (0). No rule is trusted by itself: expectation-maximisation over the
table of vote patterns estimates how each rule votes on good and on bad
documents, and a document stays if its posterior probability of being good
reaches ``keep_at``. The pattern table has at most ``3 ** len(RULES)`` rows, so
the driver's share of the work does not grow with the corpus, while its counts
come from every document.

Defined cases: a null text counts as empty; an empty text has all counts 0 and
fails the base rule; an empty table gives an empty result; repeated rows are
judged one by one and alike; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.workspace import written

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, as columns over what :func:`counts` returns."""
    repeat, symbol = _share("n_repeat_words", "n_words"), _share("n_symbols", "n_words")
    lines, upper = _share("n_dup_lines", "n_lines"), _share("n_upper", "word_chars")
    length = _share("word_chars", "n_words")
    return {
        "long_enough": _vote(F.col("n_words") < 20, F.col("n_words") >= 60),
        "repeats": _vote(repeat > 0.3, repeat <= 0.1),
        "symbols": _vote(symbol > 0.25, symbol <= 0.08),
        "lines": _vote(lines > 0.3, (lines <= 0.1) & (F.col("n_lines") > 1)),
        "capitals": _vote(upper > 0.4, upper <= 0.15),
        "word_length": _vote((length < 2.5) | (length > 14), (length >= 3.5) & (length <= 10)),
    }


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text, without a shuffle."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    kept = [c for c in df.columns if c != "hashes"]
    df = df.select(
        *kept,
        F.when(
            F.size("hashes") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size("hashes") - WINDOW + 1, F.lit(1))),
                lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)),
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("windows"),
    )
    df = df.select(
        *kept,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    same = lambda e, k: e["h"] == F.get("ordered", k)["h"]
    df = df.select(
        *kept,
        F.array_sort(
            F.transform(
                F.filter("ordered", lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False))),
                lambda e: e["i"],
            )
        ).alias("starts"),
    )
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return df.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def fit_votes(patterns: Sequence[Sequence[int]], weights: Sequence[int], rounds: int = 200, smoothing: float = 0.01) -> np.ndarray:
    """Posterior probability of good for each vote pattern, by EM.

    A rule's votes are independent given the class. The start says that rules
    are right four times in five; ``smoothing`` adds that share of all documents
    as prior observations of the start, so neither class can vanish or swap.
    """
    if not len(patterns):
        return np.zeros(0)
    v, n = np.asarray(patterns, dtype=int) + 1, np.asarray(weights, dtype=float)
    start = np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]])  # P(vote | bad), P(vote | good)
    table = np.repeat(start[None], v.shape[1], axis=0)
    share, prior = 0.8, smoothing * n.sum()
    good = np.zeros(len(n))
    for _ in range(rounds):
        logs = np.log(np.array([1 - share, share]))[:, None] + sum(np.log(table[r][:, v[:, r]]) for r in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        if np.abs(new - good).max() < 1e-10:
            break
        good = new
        for r in range(v.shape[1]):
            for c, p in enumerate((1 - good, good)):
                seen = np.bincount(v[:, r], weights=n * p, minlength=3) + prior * start[c]
                table[r, c] = seen / seen.sum()
        share = ((n * good).sum() + 0.8 * prior) / (n.sum() + prior)
    return good


def judge(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept, one row per input row."""
    rules = votes()
    measured = written(counts(docs), "quality-counts")
    voted = measured.select("*", F.concat_ws(",", *[c.cast("string") for c in rules.values()]).alias("pattern"))
    table = voted.groupBy("pattern").count().collect()
    good = fit_votes([[int(x) for x in r["pattern"].split(",")] for r in table], [r["count"] for r in table])
    # At most 3 ** len(rules) rows.
    verdicts = docs.sparkSession.createDataFrame([(r["pattern"], float(p)) for r, p in zip(table, good)], "pattern string, posterior double")
    voted, posterior = voted.join(F.broadcast(verdicts), "pattern", "left"), F.col("posterior")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.coalesce(posterior, F.lit(0.0)) >= keep_at)).alias("kept"),
        posterior,
    )
