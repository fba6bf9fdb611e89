"""Weak supervision of text quality.

Every rule votes good (+1), bad (-1) or abstains (0). The rules' accuracies
are not given: expectation-maximisation over the counts of vote patterns
estimates, for either class, how often each rule casts each vote, and the
posterior probability of "good" replaces a demand that all rules pass.

Scale: one pass computes the statistics of each text inside its task; the
votes are DataFrame expressions; only the counts of vote patterns (3^rules at
most, never more) reach the driver. The second pass is a lookup by pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, with_columns
from .textstats import NAMES, text_stats

STATS = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
MAX_RULES = 10  # 59,049 patterns: the bound of what reaches the driver


def _per(a: str, b: str = "n_words") -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(value: Column, good: tuple[float, float], bad_above: float | None = None, bad_below: float | None = None) -> Column:
    """+1 within ``good``, -1 beyond a bad bound, else 0."""
    out = F.when(value.between(*good), 1)
    if bad_above is not None:
        out = out.when(value > bad_above, -1)
    if bad_below is not None:
        out = out.when(value < bad_below, -1)
    return out.otherwise(0)




def default_rules() -> list[tuple[str, Column]]:
    """Votes that hold for any language written with spaces."""
    return [
        ("repetition", _vote(_per("n_repeat_words"), (0.0, 0.10), bad_above=0.25)),
        ("doubled_words", _vote(_per("n_double"), (0.0, 0.03), bad_above=0.10)),
        ("symbols", _vote(_per("n_symbols"), (0.0, 0.02), bad_above=0.15)),
        ("capitals", _vote(_per("n_upper", "n_bytes"), (0.0, 0.10), bad_above=0.30)),
        ("exclamations", _vote(_per("n_marks"), (0.0, 0.02), bad_above=0.15)),
        ("vocabulary", _vote(_per("n_distinct"), (0.35, 1.0), bad_below=0.20)),
        ("bare_words", _vote(_per("n_bare_words"), (0.85, 1.0), bad_below=0.70)),
        ("word_length", _vote(_per("word_chars"), (3.0, 9.0), bad_above=14.0, bad_below=2.0)),
    ]


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the statistics of ``text`` (same-named input columns are replaced)."""

    def make():
        def stats(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = np.array([text_stats(b) for b in byte_texts(batch.column(text))], dtype=np.int64).reshape(-1, len(NAMES))
            return {n: pa.array(rows[:, i]) for i, n in enumerate(NAMES)}

        return stats

    return with_columns(df, make, STATS)


def vote_pattern(rules: Sequence[tuple[str, Column]]) -> Column:
    """The votes of one row as a number in base 3."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules: the patterns' counts go to the driver")
    code = F.lit(0)
    for _, vote in rules:
        code = code * 3 + (F.coalesce(vote, F.lit(0)) + 1)
    return code.cast("int")


def fit_votes(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 200) -> dict:
    """EM over distinct vote patterns.

    Start: a text with no bad vote is good, since defects are of different
    kinds and most rules see nothing wrong with any one of them. Every rule
    keeps a Dirichlet prior of a hundredth of the rows that favours votes
    agreeing with the class, so that the two classes cannot swap. No rows:
    prior 0.5 and the prior table.
    """
    votes = (patterns[:, None] // 3 ** np.arange(n_rules - 1, -1, -1)) % 3  # 0 bad, 1 abstain, 2 good
    total = float(counts.sum())
    prior = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]) * max(total * 0.01, 1.0)
    post = 1 / (1 + np.exp(4.0 * (votes == 0).sum(1) - 2.0))
    onehot = (votes[:, :, None] == np.arange(3)).astype(float)
    pi, table = 0.5, np.broadcast_to((prior / prior.sum(1, keepdims=True))[:, None, :], (2, n_rules, 3))
    for _ in range(rounds if total else 0):
        weight = np.stack([counts * (1 - post), counts * post])
        pi_new = (weight[1].sum() + 1) / (total + 2)
        table = np.einsum("cp,prv->crv", weight, onehot) + prior[:, None, :]
        table = table / table.sum(2, keepdims=True)
        logit = np.log(pi_new / (1 - pi_new)) + np.einsum("prv,rv->p", onehot, np.log(table[1]) - np.log(table[0]))
        new = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        done = np.abs(new - post).max(initial=0.0) < 1e-9 and abs(pi_new - pi) < 1e-12
        post, pi = new, pi_new
        if done:
            break
    agree = [float((pi * table[1, r, 2] + (1 - pi) * table[0, r, 0]) / max(1e-12, pi * (1 - table[1, r, 1]) + (1 - pi) * (1 - table[0, r, 1]))) for r in range(n_rules)]
    return {"prior": float(pi), "accuracy": agree, "posterior": dict(zip(patterns.tolist(), post.tolist()))}


def fit(stats: DataFrame, rules: Sequence[tuple[str, Column]] | None = None) -> dict:
    """Fit the label model to all rows of ``stats`` (from ``with_stats``)."""
    rules = rules or default_rules()
    rows = stats.groupBy(vote_pattern(rules).alias("pattern")).agg(F.count("*").alias("n")).toPandas()
    rows = rows.sort_values("pattern")
    return fit_votes(rows["pattern"].to_numpy(np.int64), rows["n"].to_numpy(float), len(rules))


def with_posterior(stats: DataFrame, model: dict, rules: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """Append ``quality_prob``: the posterior of the row's vote pattern."""
    rules = rules or default_rules()
    spark = stats.sparkSession
    rows = [(int(k), float(v)) for k, v in model["posterior"].items()]
    lookup = spark.createDataFrame(rows, "_pattern int, quality_prob double")
    return (
        stats.drop("quality_prob")
        .withColumn("_pattern", vote_pattern(rules))
        .join(F.broadcast(lookup), "_pattern", "left")
        .drop("_pattern")
        .withColumn("quality_prob", F.coalesce("quality_prob", F.lit(0.5)))
    )


def base_failed() -> Column:
    """The base rule: under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def kept(threshold: float = 0.5) -> Column:
    return ~base_failed() & (F.col("quality_prob") >= threshold)


def keep(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.5, rules: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept; columns unchanged, also those named like a statistic."""
    new = {*NAMES, "quality_prob", "_pattern"}
    clash = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in new}
    held = with_posterior(with_stats(docs.withColumnsRenamed(clash), clash.get(text, text)), model, rules).where(kept(threshold))
    return held.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
