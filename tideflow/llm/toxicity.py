"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt from the training rows: words and word beginnings found in far more toxic than
other documents. It is cross-fitted: a training row's densities use a lexicon learnt without its fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm import trees
from tideflow.llm._shared import materialize, table
from tideflow.llm.labelled import MAX_TRAIN_ROWS, matrix, score_all, training_texts

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
#: Characters of the word beginnings that may be entries.
STEMS = (4, 5, 6)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(word: str) -> str:
    """A lower-cased word without disguise: look-alike digits and signs as letters, other marks dropped."""
    if word.isalpha():
        return word
    core = word.strip(".,;:!?\"'()[]{}…-*#%&")
    return core if core.isalpha() else _NOT_LETTERS.sub("", core.translate(_LEET))


def entries(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)]


def text_entries(text: str) -> set[str]:
    """The distinct entries of a text; learning and scoring cut words alike."""
    return {e for raw in set(text.lower().split()) if len(word := plain(raw)) > 1 for e in entries(word)}


def learn_lexicon(training: DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """(entry, toxic documents by fold, other documents by fold) of the entries that support and odds let through.

    Each document of the bounded training sample counts once for an entry; Spark counts. What is let
    through is bounded by the sample, whose documents must have an entry three times at least.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for text, y, fold in zip(*(c.to_pylist() for c in b.columns)):
                found = sorted(text_entries(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([3 * y + fold] * len(found), pa.int32())], ["entry", "cell"])

    one = training.select("text", "y", "fold").mapInArrow(batches, "entry string, cell int")
    counts = one.groupBy("entry").agg(*[F.count_if(F.col("cell") == 3 * y + f).alias(f"c{y}{f}") for y in (0, 1) for f in range(3)])
    sizes = training.groupBy().agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    pos, neg = F.col("c10") + F.col("c11") + F.col("c12"), F.col("c00") + F.col("c01") + F.col("c02")
    odds = F.log((pos + 0.5) / (sizes["p"] + 1.0)) - F.log((neg + 0.5) / (sizes["n"] + 1.0))
    best = counts.where((pos >= 3) & (odds > 2.0)).orderBy("entry")
    return [(r["entry"], [r[f"c1{f}"] for f in range(3)], [r[f"c0{f}"] for f in range(3)]) for r in best.collect()]


def lexicon(counts: list[tuple[str, list[int], list[int]]], totals: list[list[int]], without: int | None = None) -> dict[str, float]:
    """Entry to log odds; counts of fold ``without`` left out."""
    use = [f for f in range(3) if f != without]
    n, p = (sum(totals[y][f] for f in use) for y in (0, 1))
    out = {}
    for entry, toxic, other in counts:
        a, b = sum(toxic[f] for f in use), sum(other[f] for f in use)
        odds = math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))
        if a >= 2 and odds > 2 and odds * math.sqrt(a) > 6:
            out[entry] = odds
    return out


def features(text: str, lex: dict[str, float]) -> list[float]:
    """Lexicon densities, second-person proximity, capitals, punctuation and obfuscation rates of the whole text."""
    words = text.lower().split()
    w = max(len(words), 1)
    counts = Counter(words)
    weight: dict[str, float] = {}
    hits = whole = disguised = mixed = 0
    total = top = 0.0
    kinds = second = 0
    for raw, k in counts.items():
        word = plain(raw)
        if not raw.isalpha() and not raw.strip(".,;:!?\"'()[]{}…-").isalpha():
            mixed += k
        if word in SECOND_PERSON:
            second += k
            weight[raw] = -1.0
            continue
        best = 0.0
        for e in ("=" + word, word[:4], word[:5], word[:6]):
            best = max(best, lex.get(e, 0.0))
        if best:
            hits, kinds, total, top = hits + k, kinds + 1, total + best * k, max(top, best)
            whole += k * ("=" + word in lex)
            disguised += k * (word not in raw)
            weight[raw] = best
    near = 0.0
    if hits and second:
        at = [(i, weight[x]) for i, x in enumerate(words) if x in weight]
        lasts = {True: -1000, False: -1000}
        for i, v in at:
            near = max(near, 1 / (1 + i - lasts[v > 0]))
            lasts[v < 0] = i
    n = max(len(text), 1)
    upper = sum(map(str.isupper, text.split()))
    return [
        hits / w, whole / w, kinds / max(len(counts), 1), total / w, top, math.log1p(hits), math.log1p(kinds), math.log1p(total),
        second / w, near, upper / w, text.count("!") / n, text.count("?") / n, (text.count("*") + text.count("#") + text.count("$") + text.count("@")) / n,
        mixed / w, disguised / w, math.log1p(len(words)), n / w,
    ]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Callable[[list[str]], np.ndarray]:
    """A scorer of texts, learnt from at most ``max_rows`` labelled rows outside the held-out fold."""
    training = materialize(training_texts(docs, labels, "toxic", FOLDS, HELD_OUT, max_rows), "training")
    totals = [[0] * 3, [0] * 3]
    for r in training.groupBy("y", "fold").count().collect():
        totals[r["y"]][r["fold"]] = r["count"]
    counts = learn_lexicon(training)
    by_fold = [lexicon(counts, totals, f) for f in range(3)]
    lex = lexicon(counts, totals)
    x, y, fold = matrix(training, lambda text, f: features(text, by_fold[f]))
    margins = np.zeros(len(y))
    for f in range(3):
        margins[fold == f] = trees.fit(x[fold != f], y[fold != f], trees=80).margin(x[fold == f])
    forest = trees.fit(x, y, trees=80)
    at, level = trees.isotonic(margins, y) if len(y) else (np.zeros(1), np.full(1, 0.5))

    def score(texts: list[str]) -> np.ndarray:
        z = forest.margin(np.array([features(t, lex) for t in texts], float).reshape(len(texts), -1)) if texts else np.zeros(0)
        # a little of the margin keeps apart what calibration ties
        return 0.99 * np.interp(z, at, level) + 0.01 * trees.sigmoid(z)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts score as empty ones; repeated rows each get the same score; with no labels, or labels
    of one class, all texts get one score; an empty table gives no rows.
    """
    return score_all(docs, fit(docs, labels, max_rows), FOLDS, HELD_OUT, THRESHOLD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
