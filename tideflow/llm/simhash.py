"""SimHash near-dedup: fingerprints in a grid of per-segment bit counts.

A fingerprint is mapped to the bit counts of its 32 segments. The Manhattan distance of two such
points is a lower bound of the fingerprints' Hamming distance, so a range join of radius 2 over the
points' grid meets every link. The 32 axes form groups; two points within distance 2 agree on all
groups but 2, so the join's cells are the choices of these, and no point has to look into
neighbouring cells. Pairs of a cell pass the Manhattan bound first and are then verified exactly.

Cells hold distinct fingerprints only. What lies in a crowded cell is split by the next, finer grid,
whose cells fix more axes. Cells that are crowded even there hold true clusters, whose pairs would
grow with the square: their fingerprints are linked through midpoints. Two fingerprints differ in at
most 2 bits exactly if some value is within 1 bit of both, so a midpoint's list (65 values at most)
is linked as a star, without pairs or loss.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import materialize, table
from tideflow.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENT_BITS = 2
#: Groups of axes of the grids, coarse to fine. Their cells fix 19 and 26 of the 32 axes, and two random
#: points agree on so many with a probability of 8e-9 and 8e-12.
GRIDS = (5, 12)
#: Distinct fingerprints up to which a cell is paired; beyond, it is split.
CELL_PAIRS = 16
_PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: the bits set in over half of its shingles' XXH64 values."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops[:n].tolist())), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(batches, f"doc_id {id_type}, fp long")


_LOW = 0x5555555555555555


def point(fp: Column) -> Column:
    """The bit counts of the 32 segments in one long: 0, 1, 2 as 00, 01, 11, so that the Manhattan distance is a bit count."""
    pair = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(pair).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(pair).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    return F.bit_count(point(a).bitwiseXOR(point(b)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cells(fps: DataFrame, grid: int) -> DataFrame:
    """(choice, cell, fp): the grid cells of each point, one for each choice of axis groups that may stay equal."""
    n = 64 // SEGMENT_BITS
    groups = [range(g * n // grid, (g + 1) * n // grid) for g in range(grid)]
    masks = [sum(3 << SEGMENT_BITS * axis for axis in itertools.chain(*kept)) for kept in itertools.combinations(groups, grid - DISTANCE)]
    rows = fps.select("fp", point(F.col("fp")).alias("point"), F.posexplode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("choice", "mask"))
    return rows.select("choice", F.col("point").bitwiseAND(F.col("mask")).alias("cell"), "fp")


def grid_links(fps: DataFrame, grid: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) of the cells that are not crowded, Manhattan bound first and exact distance second; and the fingerprints of the others."""
    placed = cells(fps, grid)
    crowd = placed.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(placed.join(crowd, ["choice", "cell"]), f"cells{grid}")
    few = shared.where(F.col("n") <= CELL_PAIRS).groupBy("choice", "cell").agg(F.collect_list("fp").alias("fps"))  # CELL_PAIRS at most
    pair = few.select("fps", F.posexplode("fps").alias("i", "u"))
    pair = pair.select("u", F.explode(F.slice("fps", F.col("i") + 2, F.lit(CELL_PAIRS))).alias("v"))
    near = pair.where(manhattan(F.col("u"), F.col("v")) <= DISTANCE).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
    return near, shared.where(F.col("n") > CELL_PAIRS).select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fps`` (fp) that connect all pairs within the distance."""
    found = []
    for grid in GRIDS:
        near, crowded = grid_links(fps, grid)
        found.append(near)
        fps = materialize(crowded, f"crowded{grid}")
        if fps.isEmpty():
            break
    flips = F.array(*[F.lit(_signed(f)).cast("long") for f in (0, *(1 << b for b in range(64)))])
    by_mid = fps.select("fp", F.explode(flips).alias("bit")).groupBy(F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    stars = by_mid.agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = stars.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u != v")
    return reduce(DataFrame.unionByName, [*found, stars]).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Texts without words (null, empty, blanks only) have fingerprint zero and are linked like any
    other. Texts with fewer words than a shingle give one shingle of all their words. Repeated rows
    share a component. Rows with a null doc_id link others; a component of such rows only has a
    null id. An empty table gives no rows. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(fps.select("fp")))
    tied = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = tied.join(ids, "root").select("fp", "component_id")
    out = marked.join(of_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash}
SQL: dict[str, str] = {}
