"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct lower-cased words, hashed, each with the value WORDS_VALUE / sqrt(number of distinct words),
and one-hot bins of structure statistics (symbols, capitals, digits, bars, repeated words and lines, line and word
lengths) and of metadata (the text's length). The score is the logistic of a linear term and all pairwise
interactions of the features through `RANK`-dimensional factors; the pairs are summed in linear time as half the
difference between the square of the sum and the sum of squares.

The machine is fitted in numpy on at most `FIT_ROWS` labelled rows, those of the least hash of doc_id and, where
doc_ids repeat, of text; everything else covers all documents. Labels, lang, source and doc_id are no features.

Cases: null and empty texts are scored by their bins; texts are read whole; null and repeated doc_ids are scored row by
row, and a null doc_id is not held out; without labelled rows every score is 0.5; columns held_out, score and predicted
of the table's own are replaced, other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import in_small_batches, text_or_empty
from evidentia.llm.words import code_points, runs, word_hashes

FIT_ROWS = 6000
ACCEPTED = 0.7
WORD_BUCKETS = 1 << 15
RANK = 8
BINS = 12
#: Values of a text's words together and of each bin; chosen with the penalty by cross-validation among labelled rows
#: that are not held out.
WORDS_VALUE, BIN_VALUE = 0.2, 1.0
STATISTICS = ("symbols", "capitals", "digits", "bars", "distinct_words", "most_frequent_word", "repeated_lines", "word_length", "line_length", "stops", "one_word_run", "length")
FEATURES = WORD_BUCKETS + BINS * len(STATISTICS)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no label is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(n: float, of: float) -> int:
    """A bin of a share: 0 for none, then by powers of two from below 1/1024 to all."""
    if n <= 0 or of <= 0:
        return 0
    return int(min(BINS - 1, max(1, BINS - 1 + np.log2(n / of))))


def _size(n: float) -> int:
    return int(min(BINS - 1, np.log2(n + 1)))


def structure(text: str, words: np.ndarray, counts: np.ndarray, longest_run: int) -> list[int]:
    """The bins of the statistics, in the order of STATISTICS."""
    points = code_points(text)
    n = len(points)
    common = np.bincount(points[points < 256], minlength=256)
    letters = int(common[65:91].sum() + common[97:123].sum() + common[192:].sum())
    capitals = int(common[65:91].sum() + common[192:223].sum())
    digits = int(common[48:58].sum())
    plain = letters + digits + int(common[[9, 10, 13, 32, 33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63, 124]].sum()) + int((points > 255).sum())
    lines = text.split("\n")
    total = int(counts.sum())
    return [
        _share(n - plain, n), _share(capitals, letters), _share(digits, n), _share(int(common[124]), n), _share(len(counts), total),
        _share(int(counts.max(initial=0)), total), _share(len(lines) - len(set(lines)), len(lines)), _size(letters / max(total, 1)),
        _size(n / len(lines)), _share(int(common[[33, 46, 63]].sum()), total), _size(longest_run), _size(n / 16),
    ]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts in order, and the texts' bounds."""
    words, bounds = word_hashes(texts)
    numbers, values, at = [], [], [0]
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        own = words[a:b]
        distinct, counts = np.unique(own, return_counts=True)
        changes = np.flatnonzero(np.diff(own)) if len(own) else own
        run = int(np.diff(np.concatenate(([-1], changes, [len(own) - 1]))).max()) if len(own) else 0
        bins = [WORD_BUCKETS + i * BINS + v for i, v in enumerate(structure(text, own, counts, run))]
        numbers += [(distinct >> np.uint64(49)).astype(np.int32), np.array(bins, np.int32)]
        values += [np.full(len(distinct), WORDS_VALUE / np.sqrt(max(len(distinct), 1)), np.float32), np.full(len(bins), BIN_VALUE, np.float32)]
        at.append(at[-1] + len(distinct) + len(bins))
    return np.concatenate(numbers), np.concatenate(values), np.array(at)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, numbers: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scaled = self.factors[numbers] * values[:, None]
        sums = np.add.reduceat(scaled, bounds[:-1], axis=0)
        squares = np.add.reduceat(scaled * scaled, bounds[:-1], axis=0)
        linear = np.add.reduceat(self.linear[numbers] * values, bounds[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), scaled, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(*features(texts))[0].astype(np.float64)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], *, steps: int = 600, batch: int = 64, rate: float = 0.02, penalty: float = 1e-3, seed: int = 7) -> FactorisationMachine:
    """Logistic loss and Adam over (feature numbers, values, label) of each example, for whole rounds of at least `steps` batches."""
    rng = np.random.default_rng(seed)
    labels = np.array([e[2] for e in examples], np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    machine = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32))
    moments = [np.zeros_like(x) for x in (machine.linear, machine.linear, machine.factors, machine.factors)]
    step = 0
    while step < steps:
        order = rng.permutation(len(examples))
        for start in range(0, len(order), batch):
            step += 1
            rows = [examples[i] for i in order[start : start + batch]]
            numbers, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            sizes = np.array([len(r[0]) for r in rows])
            raw, scaled, sums = machine.raw(numbers, values, np.concatenate(([0], np.cumsum(sizes))))
            error = (1 / (1 + np.exp(-raw)) - labels[order[start : start + batch]]) / len(rows)
            machine.bias -= rate * float(error.sum())
            each = np.repeat(error, sizes)[:, None] * values[:, None]
            used, place = np.unique(numbers, return_inverse=True)
            for k, (table, gradient) in enumerate(((machine.linear, each[:, 0]), (machine.factors, each * (np.repeat(sums, sizes, axis=0) - scaled)))):
                g = np.zeros((len(used), *table.shape[1:]), np.float32)
                np.add.at(g, place, gradient)
                g += penalty * table[used]
                m, v = moments[2 * k], moments[2 * k + 1]
                m[used] = 0.9 * m[used] + 0.1 * g
                v[used] = 0.999 * v[used] + 0.001 * g * g
                table[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.999**step)) + 1e-8)
    return machine


def fit_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> FactorisationMachine | None:
    """Fits labels.quality on at most `fit_rows` labelled documents that are not held out."""
    chosen = labels.where(~held_out() & F.col("quality").isNotNull()).select(F.col("doc_id").alias("__ev_id"), F.col("quality").cast("int").alias("__ev_label"))
    chosen = chosen.orderBy(F.xxhash64("__ev_id"), "__ev_id", "__ev_label").limit(fit_rows)
    rows = in_small_batches(docs).select("doc_id", text_or_empty().alias("text"), F.xxhash64("doc_id", text_or_empty()).alias("tie")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__ev_id"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in runs(texts):
                numbers, values, at = features(texts[a:b])
                part = frame.iloc[a:b][["doc_id", "label", "tie"]].copy()
                part["numbers"] = [numbers[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                part["value"] = [float(values[x]) for x in at[:-1]]
                yield part

    measured = rows.select("doc_id", F.col("__ev_label").alias("label"), "tie", "text").mapInPandas(measure, "doc_id long, label int, tie long, numbers array<int>, value float")
    # a doc_id that repeats brings all its rows, so the bound is set once more
    measured = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "tie", "label").limit(fit_rows)
    examples = []
    for r in sorted(measured.collect(), key=lambda r: (r["doc_id"], r["label"], len(r["numbers"]), r["tie"])):
        numbers = np.array(r["numbers"], np.int32)
        values = np.where(numbers < WORD_BUCKETS, np.float32(r["value"]), np.float32(BIN_VALUE)).astype(np.float32)
        examples.append((numbers, values, r["label"]))
    return fit(examples) if examples else None


def score_column(machine: FactorisationMachine | None, text: str = "text") -> Column:
    """The score of each text, from 0 to 1."""
    if machine is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            done = [machine.scores(texts[a:b]) for a, b in runs(texts)]
            yield pd.Series(np.concatenate(done) if done else [], dtype="float64")

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents with held_out, score and predicted."""
    machine = fit_quality(docs, labels, **options)
    out = docs.withColumn("held_out", held_out()).withColumn("score", score_column(machine))
    return out.withColumn("predicted", F.when(F.col("score") >= ACCEPTED, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents whose score reaches ACCEPTED, columns as given."""
    return docs.where(score_column(fit_quality(docs, labels, **options)) >= ACCEPTED)
