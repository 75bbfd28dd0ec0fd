"""Grounding names in a local title index: queries, best match in stages, enrichment."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.functions.text import SPACE, html_unescape_all, is_blank, slugify, strip
from factloom.operators.graph import id_map, remap_endpoints, rename_nodes
from factloom.plans.session import cut
from factloom.schemas import CATEGORY_HINTS

#: Fixed value: characters are counted in so many classes; more only make the bound tighter.
CLASSES = 64


def category_hint(label: Column, overrides: dict[str, str] | None = None) -> Column:
    """The hint for a label: an override, else the default category, else null."""
    out = F.lit(None).cast("string")
    for known, hint in (CATEGORY_HINTS | (overrides or {})).items():
        out = F.when(label == known, hint).otherwise(out)
    return out


def search_query(name: Column, hint: Column, deepcat: bool = False) -> Column:
    """``intitle:"name"`` without quotes and doubled blanks, and the hint if there is one."""
    safe = F.regexp_replace(strip(F.replace(name, F.lit('"'), F.lit(""))), SPACE + "+", " ")
    extra = F.concat(F.lit(' deepcat:"'), hint, F.lit('"')) if deepcat else F.concat(F.lit(" "), hint)
    return F.concat(F.lit('intitle:"'), safe, F.lit('"'), F.coalesce(F.when(hint != "", extra), F.lit("")))


def page_url(url: Column, title: Column, lang: str = "en") -> Column:
    """The page's url, else one made from the title."""
    return F.coalesce(url, F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_"))))


def plain_snippet(snippet: Column) -> Column:
    """A hit's snippet without markup tags and with entities resolved."""
    return html_unescape_all(F.regexp_replace(snippet, "<[^>]*>", ""))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of the lower-cased strings; the argument order matters. Null gives 0."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def _trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("-"), slugify(text), F.lit("-"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda k: F.substr(padded, k, F.lit(3))))


def title_hits(queries: DataFrame, pages: DataFrame, limit: int | None = None, rare: int = 6) -> DataFrame:
    """label, query and pages of the label whose titles share letters with it, ranked.

    The index is the titles' letter trigrams. A query looks only under its ``rare`` trigrams
    that the fewest titles have, so neither a misspelt word, its place nor a common word
    decides. Rank is by the share of all trigrams in common, then the difference of lengths,
    then the page id; ``limit`` keeps the first ranks, as a search service would.
    """
    asked = cut(queries.filter(~is_blank(F.col("query"))).filter(slugify(F.col("query")) != "").select("label", "query", _trigrams(F.col("query")).alias("gq")))
    titles = cut(pages.filter(slugify(F.col("title")) != "").select("label", "title", "pageid", _trigrams(F.col("title")).alias("gt")))
    posted = titles.select("label", "title", "pageid", "gt", F.explode("gt").alias("g"))
    df = posted.groupBy("label", "g").agg(F.count("*").alias("df"))
    looked = asked.select("label", "query", F.explode("gq").alias("g")).join(df, ["label", "g"])
    looked = looked.groupBy("label", "query").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "g"))), 1, rare).alias("r"))
    looked = looked.select("label", "query", F.explode("r").alias("r")).select("label", "query", F.col("r.g").alias("g")).join(asked, ["label", "query"])
    met = looked.join(posted, ["label", "g"]).select("label", "query", "title", "pageid", "gq", "gt").dropDuplicates(["label", "query", "title", "pageid"])
    share = F.size(F.array_intersect("gq", "gt")) / F.size(F.array_union("gq", "gt"))
    hits = met.select("label", "query", "title", "pageid", share.alias("share"))
    if limit is None:
        return hits.drop("share")
    order = F.struct((-F.col("share")).alias("s"), F.abs(F.length("title") - F.length("query")).alias("d"), "pageid", "title")
    top = hits.groupBy("label", "query").agg(F.slice(F.array_sort(F.collect_list(order)), 1, limit).alias("h"))
    return top.select("label", "query", F.explode("h").alias("h")).select("label", "query", "h.title", "h.pageid")


def _letter_counts(texts: list[str]) -> np.ndarray:
    """A row per text: how many of its characters fall into each class."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for k, t in enumerate(texts):
        np.add.at(out[k], [ord(c) % CLASSES for c in t], 1)
    return out


def close_titles(queries: DataFrame, pages: DataFrame, threshold: float, block_rows: int = 4096) -> DataFrame:
    """label, query, title, pageid, ratio for all pages of the query's label with at least ``threshold``.

    The pages go through the queries in blocks of ``block_rows``. The characters that two
    texts have in common, in whatever order, bound difflib's matches from above, so a pair
    whose bound is under the threshold is left out without a loss; all others get the ratio.
    """
    asked = cut(queries.filter(~is_blank(F.col("query"))).select("label", "query"))
    found, block = None, []

    def scan(rows: list[tuple]) -> DataFrame:
        lowered = [r[1].lower() for r in rows]
        counts = _letter_counts(lowered)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list[tuple] = []
                for label, part in batch.groupby("label"):
                    names = part["query"].tolist()
                    texts = [n.lower() for n in names]
                    letters, sizes = _letter_counts(texts), np.array([len(t) for t in texts])
                    for k, (of, title, pageid) in enumerate(rows):
                        if of != label:
                            continue
                        whole = np.maximum(sizes + len(lowered[k]), 1)
                        near = np.nonzero(2.0 * np.minimum(sizes, len(lowered[k])) / whole >= threshold)[0]
                        near = near[2.0 * np.minimum(letters[near], counts[k]).sum(axis=1) / whole[near] >= threshold]
                        matcher = SequenceMatcher(None, "", lowered[k]) if len(near) else None
                        for i in near:
                            matcher.set_seq1(texts[i])
                            if (ratio := matcher.ratio()) >= threshold:
                                out.append((label, names[i], title, pageid, ratio))
                yield pd.DataFrame(out, columns=["label", "query", "title", "pageid", "ratio"])

        return asked.mapInPandas(run, "label string, query string, title string, pageid long, ratio double")

    for row in pages.select("label", "title", "pageid").dropna().toLocalIterator():
        block.append(tuple(row))
        if len(block) == block_rows:
            found = scan(block) if found is None else found.unionByName(scan(block))
            block = []
    if block or found is None:
        found = scan(block) if found is None else found.unionByName(scan(block))
    return found


def exact_matches(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """label, query, pageid: pages whose slug is the query's, the least page id of several."""
    side = pages.withColumn("slug", slugify(F.col("title"))).filter("slug != ''").groupBy("label", "slug").agg(F.min("pageid").alias("pageid"))
    return queries.withColumn("slug", slugify(F.col("query"))).join(side, ["label", "slug"]).select("label", "query", "pageid")


def best_matches(queries: DataFrame, pages: DataFrame, threshold: float = 0.9, limit: int | None = None, rerank=None) -> DataFrame:
    """label, query, pageid, stage, ratio for distinct queries that have a match.

    Stages: an exact slug; a reranker's best hit at or above the threshold (``rerank`` adds a
    column ``rerank_score`` to hits, matched by hit and not by text); the best difflib ratio
    at or above it among all titles of the label. Later stages only see queries that are still
    open. With a ``limit`` both later stages see the first hits only, as after a search.
    """
    queries = queries.select("label", "query").distinct()
    exact = exact_matches(queries, pages)
    found = exact.select("label", "query", "pageid", F.lit("exact").alias("stage"), F.lit(1.0).alias("ratio"))
    open_ = queries.join(exact, ["label", "query"], "left_anti")
    best = lambda df, score: df.filter(F.col(score) >= threshold).groupBy("label", "query").agg(F.max(F.struct(score, (-F.col("pageid")).alias("p"))).alias("m"))
    hits = title_hits(open_, pages, limit) if rerank is not None or limit is not None else None
    if rerank is not None:
        ranked = best(rerank(hits), "rerank_score").select("label", "query", (-F.col("m.p")).alias("pageid"), F.lit("rerank").alias("stage"), F.col("m.rerank_score").alias("ratio"))
        found = found.unionByName(ranked)
        open_ = open_.join(ranked, ["label", "query"], "left_anti")
    if limit is None:
        scored = close_titles(open_, pages, threshold)
    else:
        scored = hits.join(open_, ["label", "query"], "left_semi").withColumn("ratio", sequence_ratio("query", "title"))
    fuzzy = best(scored, "ratio")
    return found.unionByName(fuzzy.select("label", "query", (-F.col("m.p")).alias("pageid"), F.lit("fuzzy").alias("stage"), F.col("m.ratio").alias("ratio")))


def enrich(nodes: DataFrame, matches: DataFrame, pages: DataFrame, lang: str = "en") -> DataFrame:
    """Nodes (label, name) with the matched page's wiki_ columns; unmatched nodes have nulls."""
    page = pages.select("pageid", F.col("title").alias("wiki_title"), page_url(F.col("fullurl"), F.col("title"), lang).alias("wiki_url"), F.col("description").alias("wiki_description"), "wikidata_id")
    side = matches.select("label", F.col("query").alias("name"), "pageid").join(page, "pageid").withColumn("wiki_lang", F.lit(lang))
    return nodes.join(side.withColumnRenamed("pageid", "wiki_pageid"), ["label", "name"], "left")


def ground_graph(nodes: DataFrame, rels: DataFrame, pages: DataFrame, labels: list[str] | None = None, threshold: float = 0.9, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(enriched nodes, rewritten relations): named nodes of ``labels`` take their page's title and a new id.

    ``labels`` null: all; an empty list grounds nothing. Nodes without a match keep their name
    and id, and ends of relations follow the ids of their chunk.
    """
    chosen = ~is_blank(F.col("name")) & (F.lit(True) if labels is None else F.col("label").isin(labels) if labels else F.lit(False))
    asked = nodes.filter(chosen).select("label", F.col("name").alias("query"))
    matches = cut(best_matches(asked, pages, threshold))
    enriched = enrich(nodes, matches.select("label", "query", "pageid"), pages, lang)
    titles = enriched.filter("wiki_title is not null").select("label", "name", F.col("wiki_title").alias("canonical")).distinct()
    renamed = rename_nodes(enriched, titles)
    untouched = F.col("wiki_title").isNull()
    renamed = renamed.withColumn("new_id", F.when(untouched, F.coalesce("id", "new_id")).otherwise(F.col("new_id")))
    return renamed, remap_endpoints(rels, id_map(renamed))


def lookup_through(df: DataFrame, key: str, lookup, schema: str) -> DataFrame:
    """Join ``df`` with a remote lookup of its distinct keys; ``lookup`` maps a list of keys to rows of ``schema``.

    A failing call gives no rows for its keys.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.DataFrame(lookup(batch.iloc[:, 0].tolist()), columns=names)
            except Exception:  # noqa: BLE001 - a remote service may fail in any way
                yield pd.DataFrame([], columns=names)

    return df.join(df.select(key).dropna().distinct().mapInPandas(run, schema), key, "left")
