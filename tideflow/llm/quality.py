"""Quality classifier: histogram gradient-boosted trees over statistics of the whole document."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tideflow.llm import trees
from tideflow.llm.labelled import MAX_TRAIN_ROWS, keep_rows, matrix, score_all, training_texts
from tideflow.llm._shared import table

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
_MARKS = [ord(c) for c in ".,;:!?|*#$%&=+-_/\\<>{}[]()@~^'\"`\n\t"]


def statistics(text: str) -> list[float]:
    """Document statistics, all finite for any text."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    size = max(n, 1)
    share = lambda a, b: float(c[a:b].sum()) / size
    p = c[c > 0] / size
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split("\n")
    line_counts = Counter(lines)
    same_next = sum(map(str.__eq__, words, words[1:])) if words else 0
    pairs = len(set(zip(words, words[1:])))
    top = counts.most_common(1)[0][1] if counts else 0
    once = sum(1 for v in counts.values() if v == 1)
    upper = sum(map(str.isupper, counts))
    alpha = sum(map(str.isalpha, counts))
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), float(-(p * np.log2(p)).sum()) if n else 0.0,
        share(65, 91), share(97, 123), share(48, 58), share(128, 256), share(0, 32), float(c[32]) / size,
        float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())), float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        len(counts) / w, top / w, once / w, same_next / w, pairs / w, upper / max(len(counts), 1), alpha / max(len(counts), 1),
        len(words) / len(lines), 1 - len(line_counts) / len(lines), line_counts.most_common(1)[0][1] / len(lines),
        len(zlib.compress(raw, 1)) / size,
        *(float(c[m]) / size for m in _MARKS),
    ]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Callable[[list[str]], np.ndarray]:
    """A scorer of texts, learnt from at most ``max_rows`` labelled rows outside the held-out fold."""
    x, y, _ = matrix(training_texts(docs, labels, "quality", FOLDS, HELD_OUT, max_rows), lambda text, fold: statistics(text))
    forest = trees.fit(x, y)

    def score(texts: list[str]) -> np.ndarray:
        return forest.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), -1))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts score as empty ones; repeated rows each get the same score; with no labels, or labels
    of one class, every score is the smoothed share of good ones; an empty table gives no rows.
    """
    return score_all(docs, fit(docs, labels, max_rows), FOLDS, HELD_OUT, THRESHOLD)


def good_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    Null texts are judged as empty ones, rows with a null doc_id and repeated rows like others; columns
    may have any name; without labels, or with labels of one class, all rows get one judgement; an
    empty table gives no rows.
    """
    return keep_rows(docs, fit(docs, labels, max_rows), THRESHOLD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
