"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time 0..1. Its integral is the source's weight, so
the schedules fix how many tokens a source gives in all; the cumulative schedule, inverted, fixes
when each of its documents is met. Documents are then range-sorted by that position.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import NARROW, bounded, bucket_count, materialize, order_hash, ordered_rank, running_total, table

Schedule = Sequence[tuple[float, float]]

#: Knots (time, weight) of the repeating source classes: they integrate to 1, 2 and 3. The first fades, the last grows.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 1.5), (1.0, 4.5)))
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null: 0."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(marked, F.lit(" \t\n\x0b\f\r"))).cast("long")


def area(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))


def inverse_demand(schedule: Schedule, share: Column) -> Column:
    """Training time at which the schedule's integral reaches ``share`` (0..1) of its total."""
    whole = area(schedule)
    rest = share * whole
    out, done = F.lit(float(schedule[-1][0])), 0.0
    pieces = []
    for (t0, v0), (t1, v1) in zip(schedule, schedule[1:]):
        pieces.append((done, done := done + (t1 - t0) * (v0 + v1) / 2, t0, v0, (v1 - v0) / (t1 - t0)))
    for start, end, t0, v0, slope in reversed(pieces):
        r = F.greatest(rest - start, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(v0 * v0) + 2 * slope * r, F.lit(0.0)))
        out = F.when(rest < end, t0 + F.coalesce(F.try_divide(2 * r, v0 + root), F.lit(0.0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source_key, source_class, source_size, target) for every source.

    Sources in code-point order, null last, take the curriculum's schedules in turn. Targets share
    the total by weight and stop at ``max_repeats`` times the source's size; the excess goes to the
    others by weight until none is above. Each round is one sum over the table of sources.
    """
    n = len(curriculum)
    weights = F.array(*[F.lit(area(s)) for s in curriculum])
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_rank(sources, [F.col("source").asc_nulls_last()], "sources")
    ranked = ranked.withColumn("source_class", (F.col("rank") % n).cast("int")).withColumn("weight", F.element_at(weights, F.col("source_class") + 1))
    cap = F.col("source_size") * float(max_repeats)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.lit(capped >= 0) & (F.col("weight") * level > cap)
        row = ranked.agg(F.sum(F.when(over, cap)).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count_if(over).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        level, capped = (total - (row["c"] or 0.0)) / row["w"], row["n"]
    target = F.when(F.col("weight") * level > cap, cap).otherwise(F.col("weight") * level)
    return ranked.select(source_key(F.col("source")).alias("source_key"), "source_class", "source_size", target.alias("target"))


def source_key(source: Column) -> Column:
    """Sources as a join key without nulls."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def assign(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, max_repeats: int = MAX_REPEATS, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: ``carry`` and size, source_size, target, taken, positions.

    A source's documents form a line in hash order of doc_id; the mix takes the first ``target``
    words of that line, going round it up to ``max_repeats`` times. ``positions`` are the training
    times of the document's passes. The document in which the target is reached gives only its
    first words. Null sources are a source of their own; null and empty texts have size 0 and are
    never taken; repeated rows are counted each; an empty table gives no rows. Columns of ``docs``
    outside ``carry`` are ignored.
    """
    slim = docs.select(*[F.col(c).alias(f"_mix_{c}") for c in carry], "doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    slim = materialize(slim, "sizes")
    targets = source_targets(slim, curriculum, max_repeats)
    base = slim.withColumn("source_key", source_key(F.col("source"))).withColumn("h", order_hash(F.col("doc_id")))
    line = running_total(base, ["source_key"], "h", "size", bucket_count(slim.count()), [F.col("doc_id"), F.col("crc")])
    line = line.join(targets, "source_key")
    demand = F.round("target").cast("long")
    size, whole = F.col("size"), F.greatest(F.col("source_size"), F.lit(1))
    rest = F.least(F.greatest(F.pmod(F.col("demand"), whole) - F.col("before"), F.lit(0)), size)
    line = line.withColumn("demand", demand).withColumn("taken", (F.expr("demand div greatest(source_size, 1)") * size + rest).cast("long"))
    # a pass counts if the budget covers any of the document
    passes = F.when(size > 0, F.expr("cast(ceil(taken / greatest(size, 1)) as int)")).otherwise(F.lit(0))
    share = lambda e: (e.cast("double") * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0))

    def when_met(e: Column) -> Column:
        out = inverse_demand(curriculum[0], share(e))
        for k in range(1, len(curriculum)):
            out = F.when(F.col("source_class") == k, inverse_demand(curriculum[k], share(e))).otherwise(out)
        return out

    positions = F.filter(F.array(*[F.when(passes > e, when_met(F.lit(e))) for e in range(max_repeats)]), lambda x: x.isNotNull())
    return line.select(*[F.col(f"_mix_{c}").alias(c) for c in carry], "size", "source_size", "target", "taken", positions.alias("positions"))


def training_order(docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: every column of ``docs``, one row per pass, range-sorted by training position.

    Rows carry whole texts: the document in which a source's target is reached is met once more if
    the target covers at least half of it, so each source comes within half a document of its target.
    Null and empty texts have no words and are never met; null sources are a source, null doc_ids
    documents like others, and repeated rows documents of their own; columns may have any name; an
    empty table gives no rows. Positions are worked out on rows without texts, and texts take one
    shuffle, into the order, unless the table of positions is too large to be broadcast.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row")), "numbered")
    taken = assign(numbered.select("rid", "row.doc_id", "row.source", "row.text"), curriculum, max_repeats, ("rid",))
    copies = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    met = materialize(taken.select("rid", F.slice("positions", 1, copies).alias("positions")).where(F.size("positions") > 0), "met")
    passes = numbered.join(bounded(met, met.count() * NARROW), "rid").select("row", F.explode("positions").alias("position"))
    return passes.orderBy("position", order_hash(F.col("row.doc_id"))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = assign(table(spark, sf_dir, "documents"))
    passes = [F.try_element_at("positions", F.lit(k + 1)).alias(f"position_{k + 1}") for k in range(MAX_REPEATS)]
    out = met.select("doc_id", "size", "source_size", "target", "taken", *passes)
    return out.orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s),
a AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM r),
c AS (SELECT min(k) FILTER (WHERE w * ((total - capped) / left_w::DOUBLE) <= 3.0::DOUBLE * source_size) AS first_free FROM a),
l AS (SELECT (a.total - a.capped) / a.left_w::DOUBLE AS level FROM a, c WHERE a.k = c.first_free),
t AS (SELECT source, source_size, w, CASE WHEN w * level > 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size ELSE w * level END AS target FROM r, l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.w, round(t.target)::BIGINT AS demand,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT doc_id, size, source_size, target::DOUBLE AS target, w, before,
        ((demand // greatest(source_size, 1)) * size + least(greatest(demand % greatest(source_size, 1) - before, 0), size))::BIGINT AS taken FROM o),
p AS (SELECT *, [CASE WHEN ceil(taken / greatest(size, 1)::DOUBLE) > e THEN (e::DOUBLE * source_size + before) / greatest(target, 1.0::DOUBLE) END FOR e IN [0, 1, 2]] AS share FROM k),
-- the weight at time t of the classes is 1.5 - t, 2 and 1.5 + 3 t, and its integral up to t is their share of 1, 2 and 3
q AS (SELECT *, [CASE w WHEN 1 THEN 2 * s / (1.5 + sqrt(greatest(2.25 - 2 * s, 0))) WHEN 2 THEN s ELSE 6 * s / (1.5 + sqrt(2.25 + 18 * s)) END FOR s IN share] AS met FROM p)
SELECT doc_id, size, source_size, target, taken, met[1] AS position_1, met[2] AS position_2, met[3] AS position_3 FROM q
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": OP2_SQL}
