"""Quality scores: a ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of every whole text (``STATISTICS``) are standardised by their means and deviations over the corpus; random Fourier features
of a fixed seed approximate a Gaussian kernel over them. The normal equations of the learning rows are summed by
partition and in a tree, so the driver solves one system of ``FEATURES`` unknowns however many rows there are. Scores of the
learning rows, summed in ``BINS`` equal bins, give an isotonic fit of the share of good labels; a score is that share,
linear between the fit's steps, with a thousandth of the uncalibrated score to keep the order of texts on a step.

Defined results: a null text counts as empty, and an empty text gets the score of its statistics, which are all 0; a document with a null
doc_id is scored but never learnt from; labels that are null, or that stand on held-out rows, are not used; several labels of
a document count as their mean; without learning rows all scores are 1. Repeated rows get a row each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .work import Work, fresh, lean, slices, tree_sum

FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 3.0, 1e-3, 4000, 20
HELD_OUT, FOLDS, CUT = 0, 5, 0.3

STATISTICS = (
    "log_words", "word_length", "word_length_deviation", "letters", "capitals", "digits", "marks", "other_marks", "space", "non_ascii",
    "words_ending_in_marks", "words_of_marks", "capital_words", "distinct_words", "commonest_word", "repeated_neighbours", "distinct_pairs",
    "log_lines", "distinct_lines", "sentence_ends", "common_words",
)

_LETTERS = re.compile(r"[^\W\d_]+")
_WORD_MARKS = re.compile(r"[^\w\s]{2,}(?=\s|$)")
_ONLY_MARKS = re.compile(r"(?:^|(?<=\s))[^\w\s]+(?=\s|$)")
_OTHER = re.compile(r"[^\w\s.,;:!?'\"()-]")
_MARK = re.compile(r"[^\w\s]")
_SPACES = re.compile(r"\s")
_ENDS = re.compile(r"[.!?](?=\s|$)")
#: Frequent function words of English, German, French and Spanish.
_COMMON = frozenset(
    "the of and to in a is that for it was on are with as be at by this from der die und das den von zu mit sich des auf ein eine ist im nicht "
    "le la les de des et un une en du est que pour dans sur el los las y por con para se del su lo al es".split()
)


def statistics(text: str) -> list[float]:
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * len(STATISTICS)
    lengths = [len(w) for w in words]
    letters = "".join(_LETTERS.findall(text))
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    mean = sum(lengths) / k
    spread = (sum(x * x for x in lengths) / k - mean * mean) ** 0.5 if k > 1 else 0.0
    return [
        np.log1p(k), mean, spread, len(letters) / n, sum(map(str.isupper, letters)) / max(1, len(letters)), sum(map(text.count, "0123456789")) / n,
        len(_MARK.findall(text)) / n, len(_OTHER.findall(text)) / n, len(_SPACES.findall(text)) / n, 1 - len(text.encode("ascii", "ignore")) / n,
        len(_WORD_MARKS.findall(text)) / k, len(_ONLY_MARKS.findall(text)) / k, sum(map(str.isupper, words)) / k, len(counts) / k, max(counts.values()) / k,
        same / max(1, k - 1), pairs / max(1, k - 1), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(_ENDS.findall(text)) / k,
        sum(v for w, v in counts.items() if w.lower() in _COMMON) / k,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 500):
        rows = np.array([statistics(t or "") for t in b.column(1).to_pylist()], np.float64).reshape(b.num_rows, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], ["doc_id", *STATISTICS])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for null."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


class FourierFeatures:
    """cos and sin of random projections of standardised statistics, clipped to +-8 deviations, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int) -> None:
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.projection = np.random.default_rng(seed).normal(size=(len(mean), features // 2)) / width

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.deviation, -8, 8) @ self.projection
        return np.concatenate([np.cos(z), np.sin(z), np.ones((len(rows), 1))], 1)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], 1)


def _equations(features: FourierFeatures):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z, y = features(_rows(b)), b.column("label").to_numpy(zero_copy_only=False)
                own = np.concatenate([z.T @ z, (z.T @ y)[None]])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean places and non-decreasing values of the pooled blocks, for ascending x."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _score(features: FourierFeatures, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = features(_rows(b)) @ weights if b.num_rows else np.zeros(0)
            columns, names = [b.column("doc_id"), pa.array(raw)], ["doc_id", "raw"]
            if "label" in b.schema.names:
                columns, names = [*columns, b.column("label")], [*names, "label"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _calibrate(places: np.ndarray, values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").to_numpy(zero_copy_only=False)
            score = 0.999 * np.interp(raw, places, values) + 0.001 * np.clip((raw + 1) / 3, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, cut: float = CUT, seed: int = SEED, work: Work | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Reads doc_id and text, and doc_id and quality of ``labels``."""
    work = work or Work(docs.sparkSession, "quality")
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)
    measured = work.save(docs.select("doc_id", "text").mapInArrow(lean(_measure), schema), "statistics")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    learn = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    learn = learn.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    learnt = work.save(measured.join(learn, "doc_id"), "learnt")

    moments = measured.agg(*[F.avg(c) for c in STATISTICS], *[F.stddev_pop(c) for c in STATISTICS]).first()
    k = len(STATISTICS)
    some = np.array([x or 0.0 for x in moments], float)
    maps = FourierFeatures(some[:k], some[k:], features, width, seed)
    total = tree_sum(learnt.mapInArrow(lean(_equations(maps)), "sums binary"), work, "equations")
    if total is None:
        return measured.select("doc_id", held_out.alias("held_out"), F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    size = 2 * (features // 2) + 1
    total = total.reshape(size + 1, size)
    n = total[size - 1, size - 1]
    weights = np.linalg.solve(total[:size] + ridge * n * np.eye(size) / size, total[size])

    scored = learnt.mapInArrow(lean(_score(maps, weights)), "doc_id long, raw double, label double")
    bins = scored.groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * (BINS / 3)).alias("bin")).agg(F.avg("raw"), F.avg("label"), F.count(F.lit(1)))
    table = np.array(sorted((r[1], r[2], r[3]) for r in bins.collect()))  # BINS + 1 rows at most
    places, values = isotonic(table[:, 0], table[:, 1], table[:, 2])
    out = measured.mapInArrow(lean(_score(maps, weights)), "doc_id long, raw double").mapInArrow(lean(_calibrate(places, values)), "doc_id long, score double")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns. Rows that share a doc_id stay if any of them is good."""
    name = fresh(docs, "good_id")
    good = quality_scores(docs, labels, **options).filter("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
