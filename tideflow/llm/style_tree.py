"""Main text of HTML pages by a site style tree.

The elements of all pages of a host are merged by their path (tags with class, id and role). An element's
presentation is the sequence of its children, its content the text it shows. Both weigh by entropy over the
host's pages: an element that all pages build alike, or a text that most of them show at the same place, says
little and gets an importance near 0. Branches of low importance leave the page.

What a page declares comes first: a branch that calls itself a menu, advert, form, comment and the like goes, and
where a page declares an article or main region, its prose stays however often the host repeats it (copies of
an article are text, too). The tree decides all other branches. A host is never gathered in one task: its tree is
a table of (host, path, value) counts, combined before they are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import NARROW, bounded, materialize, table
from tideflow.llm.html_blocks import DROPPED, JUDGED, digest, parse

#: Branches of less importance leave the page.
LEAST_IMPORTANCE = 0.3
#: An element's own presentation weighs 1 - DAMPING^kinds against its children's, by the number of kinds of children.
DAMPING = 0.97
#: Distinct pages that must show a text at the same place before it can be called repeated.
LEAST_PAGES = 3

_PARSED = "page_id string, url string, sig long, texts array<string>, judged array<boolean>, nodes array<int>, contents array<long>, parents array<int>, paths array<long>, styles array<long>, kinds array<int>"
_KIND = pa.schema([
    ("page_id", pa.string()), ("url", pa.string()), ("sig", pa.int64()), ("texts", pa.list_(pa.string())), ("judged", pa.list_(pa.bool_())), ("nodes", pa.list_(pa.int32())), ("contents", pa.list_(pa.int64())),
    ("parents", pa.list_(pa.int32())), ("paths", pa.list_(pa.int64())), ("styles", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())),
])
_BATCH_CHARS = 4 << 20
_DIGITS = re.compile(r"\d+")


def host(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none, and such pages share no tree."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def page_blocks(html: str) -> tuple:
    """Kept texts of a page, which of them are to be judged, and the elements that those stand in."""
    elements, blocks = parse(html)
    blocks = [b for b in blocks if b.state != DROPPED]
    judged = [b.state == JUDGED for b in blocks]
    page = {i for i, e in enumerate(elements) if e.tag in ("", "html", "body")}  # no branches
    place: dict[int, int] = {}
    for b in blocks:
        i = b.node if b.state == JUDGED else 0
        while i not in page and i not in place:
            place[i] = 0
            i = elements[i].parent
    for k, i in enumerate(sorted(place)):  # parents first
        place[i] = k
    kept = [elements[i] for i in sorted(place)]
    # counters and dates don't make a text another
    contents = [digest(_DIGITS.sub("0", b.text)) if j else 0 for b, j in zip(blocks, judged)]
    nodes = [place.get(b.node, -1) if j else -1 for b, j in zip(blocks, judged)]
    sig = digest(*(b.text for b in blocks)) if kept else 0
    return sig, [b.text for b in blocks], judged, nodes, contents, [place.get(e.parent, -1) for e in kept], [e.path for e in kept], [digest(*e.children) for e in kept], [len(set(e.children)) for e in kept]


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows, held = [], 0
        for page_id, url, html in zip(*batch.columns):
            html = html.as_py()
            rows.append((page_id.as_py(), url.as_py(), *page_blocks(html)))
            held += len(html)
            if held > _BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KIND.types)], schema=_KIND)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KIND.types)], schema=_KIND)


def style_tree(once: DataFrame) -> DataFrame:
    """(host, path, value, importance) of what repeats: texts by their content (value), and elements by their presentation (value null).

    ``once``: host, contents, nodes, judged, paths, styles; one row for each distinct page of a host. A text that df of m
    pages show has importance 1 - log_m df; an element whose pages show styles with shares p has - sum p log_m p.
    """
    seen = F.expr("array_distinct(transform(filter(arrays_zip(contents, nodes), b -> b.nodes >= 0), b -> struct(paths[b.nodes] AS path, b.contents AS value, 'text' AS kind)))")
    style = F.expr("array_distinct(transform(arrays_zip(paths, styles), e -> struct(e.paths AS path, e.styles AS value, 'style' AS kind)))")
    page = F.expr("transform(array_distinct(paths), p -> struct(p AS path, 0L AS value, 'page' AS kind))")
    facts = once.select("host", F.explode(F.concat(seen, style, page)).alias("f")).select("host", "f.*").groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    facts = materialize(facts, "facts")
    pages = facts.where("kind = 'page'").select("host", "path", F.col("n").alias("m")).where(F.col("m") >= LEAST_PAGES)
    text = facts.where((F.col("kind") == "text") & (F.col("n") >= LEAST_PAGES)).join(pages, ["host", "path"])
    text = text.select("host", "path", "value", (1 - F.ln("n") / F.ln("m")).alias("importance"))
    shares = facts.where("kind = 'style'").groupBy("host", "path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    styles = shares.join(pages, ["host", "path"]).select("host", "path", F.lit(None).cast("long").alias("value"), ((F.ln("total") - F.col("nlogn") / F.col("total")) / F.ln("m")).alias("importance"))
    return text.unionByName(styles)


def dropped_blocks(judged: list, nodes: list, contents: list, parents: list, paths: list, kinds: list, chars: list, facts: dict) -> list[bool]:
    """Whether each block of a page leaves it. ``facts``: importance by (path, value), value None for presentation; 1 where unknown.

    An element's composite importance is its presentation's, weighed against the mean of its branches by their length.
    Branches below LEAST_IMPORTANCE go, and single texts below it; a branch that holds all there is to judge does not.
    """
    weight, total = [0.0] * len(paths), [0.0] * len(paths)
    own = [1.0] * len(judged)
    for k, j in enumerate(judged):
        if j and (i := nodes[k]) >= 0:
            own[k] = facts.get((paths[i], contents[k]), 1.0)
            weight[i] += chars[k]
            total[i] += chars[k] * own[k]
    gone, page = [False] * len(paths), sum(c for c, j in zip(chars, judged) if j)
    for i in range(len(paths) - 1, -1, -1):
        g = DAMPING ** max(kinds[i], 1)
        inside = total[i] / weight[i] if weight[i] else 1.0
        composite = (1 - g) * facts.get((paths[i], None), 1.0) + g * inside
        gone[i] = composite < LEAST_IMPORTANCE and weight[i] < page
        if parents[i] >= 0:
            weight[parents[i]] += weight[i]
            total[parents[i]] += weight[i] * composite
    for i, p in enumerate(parents):
        gone[i] |= p >= 0 and gone[p]
    return [j and nodes[k] >= 0 and (own[k] < LEAST_IMPORTANCE or gone[nodes[k]]) for k, j in enumerate(judged)]


def _decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("rid", pa.int64()), ("gone", pa.list_(pa.bool_()))])
    for batch in it:
        rids, out = [], []
        for r in batch.to_pylist():
            facts = {(f["path"], f["value"]): f["importance"] for f in r["facts"]}
            gone = dropped_blocks(r["judged"], r["nodes"], r["contents"], r["parents"], r["paths"], r["kinds"], r["chars"], facts)
            if any(gone):
                rids.append(r["rid"])
                out.append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(out, pa.list_(pa.bool_()))], schema=kind)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null html counts as empty, and an empty page, or one without text, has an empty text. Repeated rows stay, each with its own
    result, but count once in the style tree, as do pages of equal text. Pages without a host are judged by their
    declarations alone. Other columns are ignored. An empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType
    sent = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    parsed = materialize(sent.mapInArrow(_parse, _PARSED).withColumns({"rid": F.monotonically_increasing_id(), "host": host(F.col("url"))}), "blocks")
    gone = _gone(parsed.where("host IS NOT NULL AND size(paths) > 0").drop("page_id", "url"))
    out = parsed.select("rid", "page_id", "url", "texts").join(bounded(gone, gone.count() * NARROW), "rid", "left")
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.expr("transform(filter(arrays_zip(texts, gone), b -> NOT b.gone), b -> b.texts)")), "\n")
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def _gone(judged: DataFrame) -> DataFrame:
    """(rid, gone) of the pages that lose blocks: gone says of each block whether it leaves."""
    first = judged.groupBy("host", "sig").agg(F.min("rid").alias("rid"))
    once = judged.join(first.select("rid"), "rid", "left_semi")
    tree = materialize(style_tree(once.select("host", "contents", "nodes", "judged", "paths", "styles")), "tree")
    # only pages that show a repeated text can lose a branch
    places = F.expr("array_distinct(concat(transform(filter(arrays_zip(contents, nodes), b -> b.nodes >= 0), b -> struct(paths[b.nodes] AS path, b.contents AS value)), transform(paths, p -> struct(p AS path, CAST(NULL AS LONG) AS value))))")
    asked = judged.select("rid", "host", F.explode(places).alias("f")).select("rid", "host", "f.path", F.col("f.value").alias("value"), F.coalesce("f.value", F.lit(0).cast("long")).alias("_v"), F.col("f.value").isNull().alias("_p"))
    known = tree.select("host", "path", "importance", F.coalesce("value", F.lit(0).cast("long")).alias("_v"), F.col("value").isNull().alias("_p"))
    facts = asked.join(known, ["host", "path", "_v", "_p"]).groupBy("rid").agg(F.collect_list(F.struct("path", "value", "importance")).alias("facts"))
    facts = facts.where(F.exists("facts", lambda f: f.value.isNotNull()))
    state = judged.select("rid", "judged", "nodes", "contents", "parents", "paths", "kinds", F.expr("transform(texts, t -> length(t))").alias("chars"))
    return materialize(state.join(facts, "rid").mapInArrow(_decide, "rid long, gone array<boolean>"), "gone")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_html_text": op11_html_text}
SQL: dict[str, str] = {}
