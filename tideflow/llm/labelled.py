"""What both classifiers share: the bounded training sample and the batched scan of all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.llm._shared import order_hash

#: Labelled rows a model is fitted on, at most: the first in hash order of doc_id.
MAX_TRAIN_ROWS = 20_000


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def training_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y, fold of the labelled documents that may be learnt from; ``max_rows`` at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(order_hash(F.col("doc_id")), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # bounded by max_rows
    return texts.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold"))


def matrix(training: DataFrame, features: Callable[[str, int], list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, fold) of the training rows, sorted; ``features`` gets a text and its row's fold."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc_id, text, y, fold = (c.to_pylist() for c in b.columns)
            x = pa.array([features(t, f) for t, f in zip(text, fold)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(str, doc_id))), x, pa.array(y, pa.int32()), pa.array(fold, pa.int32())], ["doc_id", "x", "y", "fold"])

    got = training.mapInArrow(batches, "doc_id string, x array<double>, y int, fold int").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(float)
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1 if len(y) else 1)
    return x, y, got["fold"].to_numpy()


def score_all(docs: DataFrame, score: Callable[[list[str]], np.ndarray], folds: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; texts are read whole, batch by batch."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(batches, f"doc_id {id_type}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_rows(docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all columns."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = score([t or "" for t in b.column(b.schema.names.index("text")).to_pylist()])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(batches, docs.schema)
