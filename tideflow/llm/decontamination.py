"""Benchmark decontamination by a positional inverted index over the training tokens (DataFrame functions only).

1. Training texts become a table of token lists, written once.
2. The index holds the postings (term, row, position) of every term of the benchmark, in every training text.
3. Each benchmark window looks for its terms from the rarest on: the postings of the rarest, less its
   offset, are the places where the window may start; the lists of the next terms, less theirs, are
   intersected with them one after another, and what is left of the lists with what is left of the places.
   All joins but the first are on (term, row, position), so a common term is split by document and place.
4. A proximity match is a run of words that holds most of a window's distinct terms, in any order.
   It lacks a few at most, so one of as many terms and one more must be there: the rarest are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import bounded, drop_scratch, materialize, table

WINDOW = 13
#: Proximity: at least this share of a window's distinct terms within as many words as two windows.
SHARE, NEAR_WORDS = 0.8, 2 * WINDOW
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the pieces in which proximity looks at a text, so that no row carries a long one.
STRETCH = 256
#: Terms whose lists are intersected one at a time; few places are left for the others.
SINGLE_TERMS = 3


def fold(text: Column) -> Column:
    """Lower-cases A-Z only; on ASCII texts that is what ``lower`` does."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def token_table(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text_hash, n_words, tokens of every document."""
    out = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), tokens(F.col("text")).alias("tokens"))
    return materialize(out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", F.size("tokens").cast("long").alias("n_words"), "tokens"), "tokens")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words: distinct windows of each item; an item of fewer words is one window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), tokens(F.col("text")).alias("tokens"))
    items = items.where(F.size("tokens") > 0).withColumn("length", F.least(F.size("tokens"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("tokens") - F.col("length") + 1)
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("tokens", i, F.col("length")))).alias("words")).distinct()


def vocabulary(windows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct terms of the windows, and the bytes they take."""
    terms = materialize(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    return terms, terms.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]


def postings(store: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """The index: term, row, pos (0-based) of every occurrence of the ``terms``."""
    placed = store.select("row", F.posexplode("tokens").alias("pos", "term"))
    return materialize(placed.join(bounded(terms, size), "term", "left_semi").select("term", "row", "pos"), "postings")


def plan(windows: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """window, words, terms: distinct windows with their (n, term, offset) from the rarest on; n is 0 for a term that never occurs."""
    counts = bounded(index.groupBy("term").agg(F.count("*").alias("n")), size)
    numbered = materialize(windows.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    placed = numbered.select("window", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left")
    lists = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")))
    return materialize(placed.groupBy("window", "words").agg(lists.alias("terms")), "plans")


def phrase_matches(index: DataFrame, plans: DataFrame) -> DataFrame:
    """row, window, start, length of every exact occurrence of a window."""
    known = plans.where(F.col("terms")[0]["n"] > 0)
    size = known.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws("", "words")) + 32), F.lit(0))).first()[0]
    length = F.size("terms")

    def nth(k: int) -> DataFrame:
        """The k-th rarest term of each window; the last again for windows of fewer terms."""
        t = F.element_at("terms", F.least(F.lit(k + 1), length))
        return bounded(known.select("window", t["term"].alias("term"), t["offset"].alias("offset")), size)

    places = index.join(nth(0), "term").select("window", "row", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    for k in range(1, SINGLE_TERMS):
        wanted = places.join(nth(k), "window").withColumn("pos", F.col("start") + F.col("offset"))
        lists = index.join(nth(k).select("term").distinct(), "term", "left_semi")
        places = materialize(wanted.join(lists, ["term", "row", "pos"], "left_semi").select("window", "row", "start"), f"places{k}")
    rest = F.slice("terms", F.least(F.lit(SINGLE_TERMS + 1), length), length)
    others = bounded(known.select("window", length.alias("length"), F.size(rest).alias("n_rest"), rest.alias("rest")), size)
    wanted = places.join(others, "window").select("window", "row", "start", "length", "n_rest", F.inline("rest"))
    wanted = wanted.withColumn("pos", F.col("start") + F.col("offset"))
    met = wanted.join(index, ["term", "row", "pos"]).groupBy("row", "window", "start", "length", "n_rest").agg(F.count("*").alias("met"))
    return met.where("met = n_rest").select("row", "window", "start", "length")


def stretches(store: DataFrame, reach: int) -> DataFrame:
    """row, lead, part: texts in pieces of ``STRETCH`` words with ``reach`` more on either side, of which ``lead`` come first."""
    first = lambda c: F.greatest(c * STRETCH - reach, F.lit(0))
    piece = lambda c: F.struct((c * STRETCH - first(c)).alias("lead"), F.slice("tokens", first(c) + 1, c * STRETCH - first(c) + STRETCH + reach).alias("part"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(tokens) - 1) div {STRETCH}").cast("int")), piece)
    return store.where(F.size("tokens") > 0).select("row", F.explode(cut).alias("piece")).select("row", "piece.lead", "piece.part")


def proximity_matches(store: DataFrame, plans: DataFrame, share: float = SHARE, words: int = NEAR_WORDS) -> DataFrame:
    """(row, window), each once: texts in which some run of ``words`` words holds ``share`` of a window's distinct terms."""
    distinct = F.array_distinct("words")
    need = F.ceil(F.lit(share) * F.size(distinct)).cast("int")
    rarest = F.array_distinct(F.transform("terms", lambda t: t["term"]))
    probes = plans.select("window", distinct.alias("wanted"), F.transform(distinct, lambda w: F.xxhash64(w)).alias("wanted_hashes"), need.alias("need"), F.explode(F.slice(rarest, F.lit(1), F.size(distinct) - need + 1)).alias("term"))
    size = plans.agg(F.coalesce(F.sum((F.octet_length(F.concat_ws("", "words")) + 600) * (F.size(distinct) - need + 1)), F.lit(0))).first()[0]
    pieces = stretches(store, words - 1).withColumn("part_hashes", hashes("part"))
    placed = pieces.select("row", "lead", "part", "part_hashes", F.posexplode("part").alias("pos", "term"))
    placed = placed.where((F.col("pos") >= F.col("lead")) & (F.col("pos") < F.col("lead") + STRETCH))
    start = F.greatest(F.col("pos") - words + 1, F.lit(0))
    around = lambda c: F.slice(c, start + 1, F.col("pos") - start + words)
    # few words are looked up; only they take along what lies around them
    placed = placed.join(bounded(probes.select("term").distinct(), size), "term", "left_semi").select("row", "term", around("part").alias("near"), around("part_hashes").alias("near_hashes"))
    # a run with the term lies around it: enough terms there, by their hashes, and only then a look at each run
    enough = F.size(F.array_intersect("near_hashes", "wanted_hashes")) >= F.col("need")
    run = lambda i: F.size(F.array_intersect("wanted", F.slice("near", i, F.lit(words)))) >= F.col("need")
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - words + 1, F.lit(1)))
    met = (F.col("term") == F.col("probe")) & F.when(enough, F.exists(starts, run)).otherwise(F.lit(False))
    return placed.join(bounded(probes, size).withColumnRenamed("term", "probe"), met).select("row", "window").distinct()


def hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def document_hits(matches: DataFrame, owners: DataFrame) -> DataFrame:
    """row, n_hit (words inside any match), items (matched). A document's matches are bounded by its length and the windows."""
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    spans = matches.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    items = matches.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    begin = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))

    def cover(acc: Column, s: Column) -> Column:
        more = F.greatest(s["end"] - F.greatest(acc["upto"], s["start"]), F.lit(0))
        return F.struct((acc["hit"] + more).cast("long").alias("hit"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return spans.select("row", F.aggregate("spans", begin, cover)["hit"].alias("n_hit")).join(items, "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = True) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated and, unless left out, n_near for every row.

    ``n_near`` counts the items with a proximity match, exact or not. Null and empty texts have no words
    and are clean; items without words have no window; repeated rows each get the same answer; null ids
    take part like others (an item's counts as empty text); an empty table on either side gives no
    hits. Other columns are ignored.
    """
    store = token_table(docs)
    windows = materialize(benchmark_windows(benchmark, window), "items")
    terms, size = vocabulary(windows)
    index = postings(store, terms, size)
    plans = plan(windows, index, size)
    owners = materialize(windows.join(plans.select("window", "words"), "words").select("window", "item_id"), "owners")
    hits = document_hits(phrase_matches(index, plans), owners)
    out = store.drop("tokens").join(materialize(hits, "hits"), "row", "left")
    drop_scratch(index)
    columns = ["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if near:
        close = proximity_matches(store, plans).join(owners, "window").groupBy("row").agg(F.count_distinct("item_id").alias("n_near"))
        out = out.join(materialize(close, "near"), "row", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
        columns.append("n_near")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.withColumns({
        "n_hit": n_hit, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.concat_ws(",", items), 256),
        "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words")),
    }).select(*columns)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Null and empty texts and rows with a null doc_id are judged like others and stay if clean; of repeated rows all stay or
    none; columns may have any name but ``_bad_id`` and ``_bad_hash``; an empty table on either side removes nothing.
    """
    bad = decontaminate(docs, benchmark, window, near=False).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, i, dw.l AS l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id),
-- proximity: a run of 26 words lies in two blocks of 26; those with enough distinct terms are looked at run by run
win AS (SELECT row_number() OVER () AS wid, ds, ceil(0.8 * len(ds))::INT AS need FROM (SELECT DISTINCT list_sort(list_distinct(string_split(g, ' '))) AS ds FROM bw)),
own AS (SELECT DISTINCT item_id, wid FROM (SELECT item_id, list_sort(list_distinct(string_split(g, ' '))) AS ds FROM bw) JOIN win USING (ds)),
tok AS (SELECT doc_id, i, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
blk AS (SELECT DISTINCT doc_id, term, unnest([i // 26, i // 26 - 1]) AS b FROM tok),
cand AS (SELECT doc_id, wid, b FROM blk JOIN (SELECT wid, need, unnest(ds) AS term FROM win) USING (term) GROUP BY doc_id, wid, b, need HAVING count(*) >= need),
runs AS (SELECT doc_id, wid, unnest(range(greatest(26 * b, 1), 26 * b + 27)) AS s FROM cand),
nr AS (SELECT DISTINCT doc_id, wid FROM runs JOIN d USING (doc_id) JOIN win USING (wid) WHERE len(list_distinct(list_intersect(list_slice(w, s, s + 25), ds))) >= need),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN own USING (wid) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nn USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_decontamination": op7_decontamination}
SQL = {"op7_decontamination": OP7_SQL}
