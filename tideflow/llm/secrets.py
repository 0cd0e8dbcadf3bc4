"""Secret scans by a trigram inverted index (DataFrame functions only).

Each rule's regex yields a Boolean query over trigrams that any match must contain. The index lists,
for every trigram that some query asks for, the documents holding it; intersecting the postings
leaves the candidates, and only these are matched against the rule. A rule that needs no trigram
(such as a run of hex digits) scans every text.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import NARROW, bounded, materialize, table


@dataclass(frozen=True)
class Rule:
    """``group`` of ``pattern`` must have ``min_length`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    any_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: Fixed values of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Spans the method adds: published token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_MOST_STRINGS = 64
_RUN = 256
#: A conjunction of clauses; each clause is a choice of trigram sets.
Query = list[list[frozenset[str]]]


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> Query:
    """What any match of ``pattern`` must contain, on lower-cased text; empty if nothing is mandatory."""
    query: Query = []

    def strings(node) -> list[str] | None:
        """All strings the node matches, if few."""
        op, arg = node
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            return sorted({chr(a).lower() for _, a in arg})
        if op is sre.SUBPATTERN:
            return sequence(arg[3])
        if op is sre.BRANCH:
            parts = [sequence(b) for b in arg[1]]
            return None if None in parts else sorted(set(itertools.chain(*parts)))
        if op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            inner = sequence(arg[2])
            return None if inner is None else sorted({"", *inner})
        return None

    def sequence(nodes) -> list[str] | None:
        out = [""]
        for node in nodes:
            part = strings(node)
            if part is None or len(out) * len(part) > _MOST_STRINGS:
                return None
            out = [a + b for a in out for b in part]
        return out

    def flush(found: list[str]) -> None:
        sets = {_grams(s) for s in found}
        if frozenset() not in sets:
            query.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    def walk(nodes) -> None:
        run = [""]
        for node in nodes:
            part = strings(node)
            if part is not None and len(run) * len(part) <= _MOST_STRINGS:
                run = [a + b for a in run for b in part]
                continue
            flush(run)
            run = [""] if part is None else part
            if part is None and node[0] is sre.SUBPATTERN:
                walk(node[1][3])
            elif part is None and node[0] is sre.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        flush(run)

    walk(sre_parse.parse(pattern))
    return query


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the trigrams asked for, over lower-cased texts."""
    low = docs.select("doc_id", _key().alias("text_hash"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    # a byte search for each trigram is cheaper than one regex pass for all of them
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", "text_hash", F.explode(held).alias("trigram"))


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def candidates(index: DataFrame, rules: dict[str, Query]) -> DataFrame:
    """doc_id, text_hash and, for each rule, whether the postings' intersection holds the document."""
    used = sorted({t for q in rules.values() for clause in q for s in clause for t in s})
    place = {t: k for k, t in enumerate(used)}
    has = index.groupBy("doc_id", "text_hash").agg(*[F.bool_or(F.col("trigram") == t).alias(f"_{k}") for t, k in place.items()])
    every = lambda s: reduce(lambda a, b: a & b, [F.col(f"_{place[t]}") for t in sorted(s)])
    met = {kind: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(every, clause)) for clause in q]) for kind, q in rules.items()}
    out = has.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), *[c.alias(f"_may_{kind}") for kind, c in met.items()])
    return out.where(reduce(lambda a, b: a | b, [F.col(f"_may_{kind}") for kind in rules]))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) in code points, end exclusive: leftmost matches that do not overlap."""
    regex = F.lit(rule.regex)
    whole, group = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(rule.group))
    found = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"), whole.alias("whole"), group.alias("group"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    full = F.array().cast("array<array<struct<start:int,rank:int,kind:string,end:int>>>")

    def step(acc: Column, m: Column) -> Column:
        """Spans are appended to a short array, and full ones put aside, so that no long one is copied for each match."""
        start = acc["pos"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        ok, turn = F.coalesce(F.length(m["group"]) >= rule.min_length, F.lit(False)), F.size(acc["spans"]) >= _RUN
        kept = F.when(~ok, acc["spans"]).when(turn, span).otherwise(F.concat(acc["spans"], span))
        return F.struct(end.alias("pos"), kept.alias("spans"), F.when(ok & turn, F.concat(acc["full"], F.array(acc["spans"]))).otherwise(acc["full"]).alias("full"))

    done = lambda acc: F.concat(F.flatten(acc["full"]), acc["spans"])
    got = F.aggregate(found, F.struct(F.lit(0).alias("pos"), none.alias("spans"), full.alias("full")), step, done)
    return F.when(text.rlike(rule.regex), got).otherwise(none)


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id, text_hash, found: the array of (start, rank, kind, end) of every row, sorted by start and rule.

    Null and empty texts hold nothing; repeated rows each get their spans; rows with a null doc_id
    are scanned like others; an empty table gives no rows. Texts are scanned whole. Other columns
    are ignored.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if queries:
        index = materialize(build_index(base, sorted({t for q in queries.values() for c in q for s in c for t in s})), "postings")
        hits = materialize(candidates(index, queries), "candidates")
        hits = bounded(hits, hits.count() * NARROW)
        keyed = base.withColumn("text_hash", _key())
        base = keyed.join(hits, keyed.doc_id.eqNullSafe(hits._doc_id) & (keyed.text_hash == hits._text_hash), "left")
    else:
        base = base.withColumn("text_hash", _key())
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = []
    for order, rule in enumerate(rules):
        found = spans(F.col("text"), rule, order)
        parts.append(F.when(F.col(f"_may_{rule.kind}"), found).otherwise(nothing) if rule.kind in queries else found)
    return base.select("doc_id", "text_hash", F.array_sort(F.concat(*parts)).alias("found"))


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql_rule(rule: Rule, order: int) -> str:
    text = rule.pattern.replace("'", "''")
    opts = "'i'" if rule.any_case else "'c'"
    part = f"'(?i){text}'" if rule.any_case else f"'{text}'"
    return f"""SELECT doc_id, {order} AS rank, '{rule.kind}' AS kind, val[i] AS val,
       (list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0))::BIGINT AS s, length(hit[i]) AS n
FROM (SELECT doc_id, gap, hit, val, unnest(range(1, len(hit) + 1)) AS i FROM (
  SELECT doc_id, regexp_split_to_array(t, {part}) AS gap, regexp_extract_all(t, '{text}', 0, {opts}) AS hit, regexp_extract_all(t, '{text}', {rule.group}, {opts}) AS val FROM d WHERE regexp_matches(t, '{text}', {opts})))
WHERE length(val[i]) >= {rule.min_length}"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_rule(r, k) for k, r in enumerate(BASE_RULES + MORE_RULES))}),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
        string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_secrets": op10_secrets}
SQL = {"op10_secrets": OP10_SQL}
