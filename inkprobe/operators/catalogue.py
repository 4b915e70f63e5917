"""Catalogue pages: metadata, links and collection state."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprobe.session import materialize

NAMES_PER_BLOCK = 50_000

# Names of the catalogue's elements and link texts.
RECORD_ID = "bibrec"
LANGUAGE_PROPERTY = "dcterms:language"
DOWNLOADS_ITEM = "interactionCount"
TITLE_ITEM = "headline"
AUTHOR_ITEM = "creator"
PUBLISHED_ITEM = "datePublished"
WANTED_LANGUAGE = "English"
PLAIN_TEXT, HTML_TEXT = "Plain Text", "HTML"
BOOK_PATH = "ebooks"

TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"
RECORD_OPEN = rf"""(?is)<div(?:\s[^>]*)?\sid\s*=\s*["']?{RECORD_ID}["']?(?=[\s>/])[^>]*>"""
DIV_TAG = r"(?i)</?div(?=[\s>/])[^>]*>"
ANCHOR_PATTERN = r"(?is)<a\s[^>]*>.*?</a>"
ITEM_PATTERN = r"(?is)<li[^>]*>.*?</li>"
HREF_PATTERN = r"""(?is)<a\s[^>]*href=["']([^"']*)["']"""
LINK_CLASS_PATTERN = r"""(?is)^<a\s[^>]*class=["'](?:[^"']*\s)?link(?:\s[^"']*)?["']"""
TAG_PATTERN = r"(?s)<[^>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def element_pattern(tag: str, attribute: str, value: str) -> str:
    return rf"""(?is)<{tag}[^>]*{attribute}=["']{value}["'][^>]*>(.*?)</{tag}>"""


def plain(html: Column) -> Column:
    """Text of an HTML fragment."""
    out = F.regexp_replace(html, TAG_PATTERN, "")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def _first(html: Column, pattern: str) -> Column:
    """Text of the first match, NULL when nothing matches."""
    return F.when(F.regexp_like(html, F.lit(pattern)),
                  plain(F.regexp_extract(html, pattern, 1)))


def _record(html: Column) -> Column:
    """What stands between the record block's opening tag and the closing tag that balances it.

    Empty without a block; a block that is never closed runs to the end.
    """
    rest = F.get(F.split(html, RECORD_OPEN, 2), 1)
    tags = F.regexp_extract_all(rest, F.lit(DIV_TAG), F.lit(0))
    # Depth after each tag; the block ends with the first that brings it to 0.
    state = F.aggregate(
        tags, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end")),
        lambda a, t: F.struct(
            (a["depth"] + F.when(t.startswith("</"), -1).otherwise(1)).alias("depth"), (a["i"] + 1).alias("i"),
            F.when((a["end"] == 0) & (a["depth"] == 1) & t.startswith("</"), a["i"] + 1).otherwise(a["end"]).alias("end")))
    pieces = F.split(rest, DIV_TAG)
    count = F.when(state["end"] == 0, F.size(pieces)).otherwise(state["end"])
    own = F.zip_with(F.slice(pieces, F.lit(1), count), F.concat(F.array(F.lit("")), F.slice(
        tags, F.lit(1), F.greatest(count - 1, F.lit(0)))), lambda p, t: F.concat(t, p))
    return F.coalesce(F.array_join(own, ""), F.lit(""))


def page_title(html: Column) -> Column:
    return _first(html, TITLE_PATTERN)


def page_language(html: Column) -> Column:
    row = _first(_record(html), element_pattern("tr", "property", LANGUAGE_PROPERTY))
    return F.when(row.contains(WANTED_LANGUAGE), WANTED_LANGUAGE).otherwise(row)


def page_metadata(df: DataFrame, html: str = "html") -> DataFrame:
    return df.withColumn("title", page_title(F.col(html))).withColumn(
        "language", page_language(F.col(html)))


def page_downloads(df: DataFrame, html: str = "html") -> DataFrame:
    cell = _first(_record(F.col(html)), element_pattern("td", "itemprop", DOWNLOADS_ITEM))
    count = F.get(F.split(cell, " "), 0).try_cast("int")
    return df.withColumn("downloads", F.coalesce(count, F.lit(0)))


def page_bib(df: DataFrame, html: str = "html") -> DataFrame:
    """Title, author and date of the record: all three or none."""
    record = _record(F.col(html))
    parts = {
        "bib_title": element_pattern("td", "itemprop", TITLE_ITEM),
        "bib_author": element_pattern("a", "itemprop", AUTHOR_ITEM),
        "bib_published": element_pattern("td", "itemprop", PUBLISHED_ITEM),
    }
    rest = df.columns
    raw = df.select(*rest, *[
        F.replace(_first(record, pattern), F.lit("\n"), F.lit("")).alias(name)
        for name, pattern in parts.items()])
    whole = F.lit(True)
    for name in parts:
        whole = whole & F.col(name).isNotNull()
    return raw.select(*rest, *[F.when(whole, F.col(name)).alias(name) for name in parts])


def metadata_line() -> Column:
    """One line of the metadata listing, with the comma its format has after the date."""
    return F.concat("bib_title", F.lit("\t"), "bib_published", F.lit(",\t"), "bib_author")


def eligible_pages(df: DataFrame, language: str = WANTED_LANGUAGE, min_downloads: int = 0) -> DataFrame:
    return df.filter((F.col("language") == language) & (F.col("downloads") >= min_downloads))


def _last(links: Column, test) -> Column:
    return F.element_at(F.concat(F.array(F.lit("")), F.filter(links, test)), -1)


def pick_link(df: DataFrame, html: str = "html") -> DataFrame:
    """The last plain-text link of a page, else its last HTML link, else ''."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(ANCHOR_PATTERN), F.lit(0))
    links = F.filter(anchors, lambda a: F.regexp_like(a, F.lit(LINK_CLASS_PATTERN)))
    rest = df.columns
    found = df.select(*rest, links.alias("_links")).select(
        *rest,
        F.regexp_extract(_last(F.col("_links"), lambda a: a.contains(PLAIN_TEXT)), HREF_PATTERN, 1).alias("_plain"),
        F.regexp_extract(_last(F.col("_links"), lambda a: a.contains(HTML_TEXT) & ~a.contains(PLAIN_TEXT)),
                         HREF_PATTERN, 1).alias("_html"))
    return found.select(*rest, F.when(F.col("_plain") != "", F.col("_plain")).otherwise(
        F.col("_html")).alias("link"))


def list_links(df: DataFrame, limit: int | None = None, path: str = BOOK_PATH,
               html: str = "html", key: str = "page_id") -> DataFrame:
    """Links of a listing page by title; the last link of a repeated title wins.

    ``limit`` counts list items before any filter, as the listing's own top-n.
    Items without a link are passed over.
    """
    items = F.regexp_extract_all(F.col(html), F.lit(ITEM_PATTERN), F.lit(0))
    if limit is not None:
        items = F.slice(items, 1, limit)
    rows = df.select(key, F.posexplode(items).alias("pos", "item")).select(
        key, "pos", plain(F.col("item")).alias("title"),
        F.regexp_extract("item", HREF_PATTERN, 1).alias("href"))
    return rows.filter(F.col("href").contains(path)).groupBy(key, "title").agg(
        F.max_by("href", "pos").alias("href"))


def name_contains(df: DataFrame, query: str | Sequence[str], col: str = "name") -> DataFrame:
    """Rows whose name contains the query (or one of a list), ignoring case."""
    queries = [query] if isinstance(query, str) else list(query)
    hit = F.lit(False)
    for q in queries:
        hit = hit | F.lower(col).contains(F.lower(F.lit(q)))
    return df.filter(hit)


def _finder(words: Broadcast) -> Callable:
    """A condition on lower-cased names: whether any of ``words`` stands in them, in one walk over each name."""
    @F.pandas_udf("boolean")
    def found(names: pd.Series) -> pd.Series:
        import ahocorasick

        search = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words.value:
            search.add_word(w)
        search.make_automaton()
        return names.map(lambda name: name is not None and next(search.iter(name), None) is not None)

    return found


def name_contains_any(df: DataFrame, queries: DataFrame, key: str, col: str = "name", query: str = "query",
                      per_block: int = NAMES_PER_BLOCK) -> DataFrame:
    """Rows whose name contains any of many queries, ignoring case.

    Queries go into Aho-Corasick automata of about ``per_block`` of them, which bounds what a
    task holds; each walks over every name once. NULL and empty queries match nothing. Rows
    that share a ``key`` are judged together where there are several blocks.
    """
    words = materialize(queries.select(F.lower(query).alias("w")).filter("w <> ''").distinct(), "queries")
    n_blocks = max(1, -(-words.count() // per_block))
    block = F.pmod(F.xxhash64("w"), F.lit(n_blocks))
    spark, hits = df.sparkSession, []
    for i in range(n_blocks):
        held = [r["w"] for r in words.filter(block == i).collect()]  # one block
        if not held:
            continue
        found = _finder(spark.sparkContext.broadcast(held))(F.lower(col))
        if n_blocks == 1:
            return df.filter(found)
        hits.append(materialize(df.filter(found).select(key), "hits"))
    if not hits:
        return df.limit(0)
    return df.join(reduce(DataFrame.unionByName, hits).distinct(), key, "left_semi")


def skip_collected(df: DataFrame, have: DataFrame, title: str = "title", name: str = "name") -> DataFrame:
    """Titles not collected yet.

    A title counts as collected when the folder holds it, it with '.txt', or it
    with '_' for ' ' and '.txt'. Two equi anti-joins instead of one OR join.
    """
    bare = F.regexp_replace(name, r"\.txt$", "")
    stems = have.filter(F.col(name).endswith(".txt")).select(bare.alias("_k"))
    as_is = have.select(F.col(name).alias("_k")).unionByName(stems)
    left = df.join(as_is, F.col(title) == F.col("_k"), "left_anti")
    return left.join(stems, F.replace(F.col(title), F.lit(" "), F.lit("_")) == F.col("_k"), "left_anti")
