"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule rejects documents of which a measure exceeds a cutoff. In each stratum a cutoff may be used
only if the exact binomial (Clopper-Pearson) bound on the share of good documents that it rejects
is within the rule's part of ``alpha``; of the usable cutoffs the strictest is taken. The confidence
is divided by the number of all bounds looked at (strata x rules x cutoffs), so with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents to all rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphrecon.llm.batches import add_columns
from graphrecon.session import materialize

SYMBOLS = b"#*$%&|<>"
NGRAM = 5
ALPHA, DELTA = 0.05, 0.05
#: In thousandths, from strict to lenient.
CUTOFFS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750)
#: Strata up to which their cutoffs are sent to every task; more are joined by a shuffle.
BROADCAST_STRATA = 100_000

_UPPER, _LOWER, _BANGS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"!?"
_PLAIN = "word_chars n_symbols n_dup_lines n_repeat_words".split()
_MORE = "n_lines n_upper n_letters n_bangs".split()


def repeated_words(words: list[bytes], size: int = NGRAM) -> int:
    """Words inside windows of ``size`` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    values = np.random.default_rng(len(known)).integers(1, 1 << 63, len(known), dtype=np.uint64)[ids]
    total = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + values[j : len(words) - size + 1 + j]
    order = np.sort(total)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(total, twice))
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """Words, then what ``_PLAIN`` and ``_MORE`` name, of a whole text; zeros for null."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at spaces and the controls 9 to 13 alone
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = (len(data) - len(data.translate(None, some)) for some in (_UPPER, _LOWER))
    return (
        len(words),
        len(text) - (len(data) - sum(map(len, words))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + lower,
        len(data) - len(data.translate(None, _BANGS)),
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the measures of each text. No shuffle; one batch of texts at a time."""
    def run(texts):
        return list(zip(*map(measures, texts)))

    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    return add_columns(rows, ["__text"], dict.fromkeys(["n_words", *_PLAIN, *_MORE], "long"), run, ["__text"])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    """Thousandths; 0 where the whole is nothing (a text without words, lines or ASCII letters)."""
    return F.coalesce(F.floor(F.try_divide(F.col(part) * 1000, F.col(whole))), F.lit(0))


def rules() -> dict[str, Column]:
    """Measures in thousandths; the more, the worse.

    Capitals are counted among ASCII letters: scripts without case, and texts of digits alone, don't shout.
    """
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        "shouting": _share("n_upper", "n_letters"),
        "bangs": _share("n_bangs", "n_words"),
    }


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with ``n`` and ``p``, for k below n p; 1 beyond, where no bound is met."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(log + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while term > total * 1e-17 and term > 0:
        total += term
        if k == 0:
            break
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return min(1.0, total)


def certified(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the exact upper bound at confidence ``1 - delta`` on a rate seen ``k`` of ``n`` times is ``alpha`` or less."""
    return n > 0 and binomial_at_most(k, n, alpha) <= delta


def choose_cutoffs(
    rows: DataFrame, labels: DataFrame, key: str, stratum: str, good: str, alpha: float, delta: float
) -> DataFrame:
    """One row per stratum: ``stratum`` and for each rule its cutoff, null where none is certified.

    The holdout is every labelled good row of the stratum that passes the base rules. A key labelled
    more than once is good if all its labels are; null labels count as not given.
    """
    held = labels.groupBy(F.col(key)).agg(F.min(good).alias("__good")).where("__good = 1")
    names = list(rules())
    measured = rows.where(~base_failed()).join(held, key, "left_semi").select(stratum, *[v.alias(n) for n, v in rules().items()])
    counts = materialize(
        measured.groupBy(stratum).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum((F.col(n) > c).cast("long")).alias(f"{n}_{c}") for n in names for c in CUTOFFS],
        )
    )
    tests = max(1, counts.count()) * len(names) * len(CUTOFFS)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {stratum: batch[stratum]}
            for name in names:
                picked = []
                for _, row in batch.iterrows():
                    fit = (c for c in CUTOFFS if certified(int(row[f"{name}_{c}"]), int(row["n"]), alpha / len(names), delta / tests))
                    picked.append(next(fit, None))
                out[f"cut_{name}"] = pd.array(picked, dtype="Int64")
            yield pd.DataFrame(out)

    return counts.mapInPandas(choose, f"`{stratum}` string, " + ", ".join(f"cut_{n} long" for n in names))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    good: str = "quality",
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """``key``, ``stratum``, the measures, ``base_failed``, ``kept`` and ``failed_rules`` (names) of each document.

    A null or empty text has zeros and fails the base rules. A null stratum is a stratum of its
    own. Where too few good rows are labelled to certify any cutoff (or none are), no rule but the base ones
    applies. Repeated documents are judged each; an empty table gives an empty result. The measures
    are written once; only they, not the texts, are shuffled to meet the labels.
    """
    named = docs.select(
        F.col(key), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("__stratum"), F.col(text)
    )
    rows = materialize(measure(named, text, (key, "__stratum")))
    cutoffs = materialize(choose_cutoffs(rows, labels, key, "__stratum", good, alpha, delta))
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    broken = F.array_compact(
        F.array(*[F.when(value > F.col(f"cut_{name}"), F.lit(name)) for name, value in rules().items()])
    )
    judged = rows.join(cutoffs, "__stratum", "left").withColumn("failed_rules", broken)
    return judged.select(
        key,
        F.expr("substring(__stratum, 2)").alias(stratum),
        "n_words",
        *_PLAIN,
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size("failed_rules") == 0)).alias("kept"),
        "failed_rules",
    )
