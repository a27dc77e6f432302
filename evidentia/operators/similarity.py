"""Likeness of an answer to its reference by characters: BLEU-4 and ROUGE-1, -2 and -L.

A vectorised function counts what a pair of texts shares, and the scores are columns over these counts. No row is
shuffled, and texts are taken whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: N-grams that BLEU takes the mean over.
ORDERS = 4


def common_subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence, a row of its table at a time as the bits of one integer.

    Bit i of the row is 0 where the length grows by one at a's place i."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def shared_ngrams(a: str, b: str, n: int) -> int:
    """N-grams of a, each counted as often as it is in b too at most."""
    x, y = (Counter(zip(*(s[i:] for i in range(n)), strict=False)) for s in (a, b))
    return sum(min(c, y[g]) for g, c in x.items() if g in y)


def _counts(answers: pd.Series, references: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(answers, references, strict=True):
        a, b = a or "", b or ""
        rows.append(([shared_ngrams(a, b, n) for n in range(1, ORDERS + 1)], common_subsequence(a, b)))
    return pd.DataFrame(rows, columns=["shared", "common"])


def _f1(shared: Column, answer: Column, reference: Column) -> Column:
    """Harmonic mean of the shares of both sides, 0 where nothing is shared."""
    return F.when(shared > 0, 2 * shared.cast("double") / (answer + reference)).otherwise(0.0)


def bleu(shared: Sequence[Column], answer: Column, reference: Column) -> Column:
    """Geometric mean of the n-gram precisions times the penalty for short answers.

    Orders without a match count as 1 / (2^k possible), k counting such orders; no shared character at all gives 0."""
    log_sum, misses = F.lit(0.0), F.lit(0)
    for i, s in enumerate(shared):
        possible = F.greatest(answer - i, F.lit(1))
        misses = misses + F.when(s == 0, 1).otherwise(0)
        log_sum = log_sum + F.when(s > 0, F.log(s / possible)).otherwise(-F.log(F.pow(F.lit(2.0), misses) * possible))
    short = F.when(answer > reference, 1.0).otherwise(F.exp(1 - reference.cast("double") / answer))
    return F.when((answer == 0) | (shared[0] == 0), 0.0).otherwise(short * F.exp(log_sum / len(shared)))


def text_similarity(df: DataFrame, answer: str, reference: str) -> DataFrame:
    """Adds bleu_4, rouge_1, rouge_2 and rouge_l in percent, rounded to four places; a NULL text is empty."""
    a, b = (F.char_length(F.coalesce(F.col(c), F.lit(""))).cast("bigint") for c in (answer, reference))
    counts = F.pandas_udf(_counts, "struct<shared: array<bigint>, common: bigint>")
    counted = df.withColumn("__s", counts(F.col(answer), F.col(reference))).withColumns({"__a": a, "__b": b})
    shared = [F.col("__s")["shared"][i] for i in range(ORDERS)]
    a, b = F.col("__a"), F.col("__b")
    grams = lambda side, n: F.greatest(side - (n - 1), F.lit(0))
    scores = {"bleu_4": bleu(shared, a, b), **{f"rouge_{n}": _f1(shared[n - 1], grams(a, n), grams(b, n)) for n in (1, 2)}, "rouge_l": _f1(F.col("__s")["common"], a, b)}
    return counted.withColumns({k: F.round(v * 100, 4) for k, v in scores.items()}).drop("__s", "__a", "__b")
