"""Pages, links and the search for content pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import ordered as O
from quillspan.sources import stores


def _links(limit: int) -> Column:
    """The first ``limit`` http links of a page, resolved."""
    found = F.regexp_extract_all(T.without_code(F.col("html")), F.lit(T.HREF), F.lit(1))
    hrefs = F.transform(found, lambda h: T.unescape(F.when(h.rlike("^[\"']"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h)))
    links = F.transform(F.filter(hrefs, lambda h: ~F.startswith(h, F.lit("#"))), lambda h: T.resolve(h, F.col("url")))
    return F.slice(F.filter(links, lambda u: u.rlike("^https?://")), 1, limit)


def leaf_flags(pages: DataFrame, *keep: str | Column, least: int = 800, many: int = 10) -> DataFrame:
    """(page_id, ``keep``, n_paragraphs, n_chars, is_leaf): enough text in paragraphs, and an article or many paragraphs."""
    html = T.marked(F.col("html"))
    parts = F.regexp_extract_all(html, F.lit(T.PARAGRAPH), F.lit(1))
    rows = pages.select("page_id", *keep, parts.alias("p"), html.rlike("(?i)<article\\b").alias("article"))
    own = [c for c in rows.columns if c not in ("p", "article")]
    chars = F.aggregate("p", F.lit(0), lambda s, x: s + F.length(T.plain(x)))
    leaf = (F.col("n_chars") >= least) & (F.col("article") | (F.col("n_paragraphs") > many))
    return rows.select(*own, F.size("p").alias("n_paragraphs"), chars.alias("n_chars"), "article").select(*own, "n_paragraphs", "n_chars", leaf.alias("is_leaf"))


def link_graph(pages: DataFrame, limit: int = 20) -> DataFrame:
    """(page_id, url, links, n_paragraphs, n_chars, is_leaf): all that leaves, links and expansions need of a page, from one look at
    its html; no shuffle. Kept as a table, it serves :func:`expand_links` without the pages."""
    return leaf_flags(pages, "url", _links(limit).alias("links"))


def extract_links(pages: DataFrame, limit: int = 20) -> DataFrame:
    """(page_id, link_no, url): the first ``limit`` http links of each page, resolved; no shuffle."""
    return pages.select("page_id", F.posexplode(_links(limit)).alias("link_no", "url"))


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): the text of the article, or else of the body, without navigation."""
    html = F.regexp_replace(T.without_code(F.col("html")), r"(?is)<(nav|header|footer|aside)\b.*?</(nav|header|footer|aside)>", " ")
    article = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1)
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body>", 1)
    return pages.select("page_id", T.plain(F.when(article != "", article).when(body != "", body).otherwise(html)).alias("text"))


def join_texts(rows: DataFrame, key: str, separator: str = "----") -> DataFrame:
    """One text for each ``key`` from (key, rank, text), in rank order."""
    all_ = F.sort_array(F.collect_list(F.struct("rank", "text")))
    return rows.groupBy(key).agg(F.array_join(F.transform(all_, lambda x: x["text"]), separator).alias("text"))


def dedupe_urls(cands: DataFrame) -> DataFrame:
    """(query_id, rank, url): the first rank of each URL of a query."""
    return cands.groupBy("query_id", "url").agg(F.min("rank").alias("rank"))


def prefer_source(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the first engine, and those of the second for queries that the first has none for."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def expand_links(cands: DataFrame, pages: DataFrame, per_page: int = 3) -> DataFrame:
    """Content pages of each query: candidates that are leaves, and leaves among up to
    ``per_page`` same-host links, not yet candidates, of those that aren't. (query_id, rank, sub, url)

    ``pages`` are pages, whose :func:`link_graph` is written once, or such a table already."""
    graph = pages
    if "links" not in pages.columns:
        path = stores.fresh(pages.sparkSession, "links")
        made = link_graph(pages)
        made.write.parquet(path)
        graph = pages.sparkSession.read.schema(made.schema).parquet(path)
    found = cands.join(graph.select("url", "links", "is_leaf"), "url")
    direct = found.where("is_leaf").select("query_id", "rank", F.lit(0).alias("sub"), "url")
    out = found.where(~F.col("is_leaf")).select("query_id", "rank", T.authority(F.col("url")).alias("host"), F.posexplode("links").alias("link_no", "link")).where(F.col("host") == T.authority(F.col("link")))
    fresh = out.join(cands.select("query_id", F.col("url").alias("link")), ["query_id", "link"], "left_anti")
    order = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("link_no"))
    picked = fresh.withColumn("sub", order).where(F.col("sub") <= per_page)
    leaves = graph.where("is_leaf").select(F.col("url").alias("link"))
    return direct.unionByName(picked.join(leaves, "link").select("query_id", "rank", "sub", F.col("link").alias("url")))


def cap_pages(found: DataFrame, limit: int = 5) -> DataFrame:
    """Pages of the candidates before which fewer than ``limit`` pages were found."""
    before = F.count("*").over(Window.partitionBy("query_id").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", before).where(F.col("before") < limit).drop("before")


def fetch_slots(urls: DataFrame, interval: float = 1.0) -> DataFrame:
    """``start_s``: seconds after the first fetch of the host at which each URL may be fetched."""
    rows = O.numbered(urls.withColumn("host", T.authority(F.col("url"))), ["host"], ["rank", "url", "query_id"], "start_s")
    return rows.withColumn("start_s", (F.col("start_s") - 1) * F.lit(interval))
