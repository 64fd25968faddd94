"""Pages and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import web as W
from quillspan.queries.core import query, sql_code, sql_marked, sql_plain, table, with_

HOST = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
LEAF = rf"""parts AS (SELECT page_id, url, html, regexp_extract_all({sql_marked("html")}, '(?i)<p\b[^>]*>([^\x01]*)', 1) AS p, regexp_matches({sql_marked("html")}, '(?i)<article\b') AS article FROM pages),
leaf AS (SELECT page_id, url, len(p)::INTEGER AS n_paragraphs, coalesce(list_sum(list_transform(p, lambda x: length({sql_plain("x")}))), 0)::INTEGER AS n_chars, coalesce(list_sum(list_transform(p, lambda x: length({sql_plain("x")}))), 0) >= 800 AND (article OR len(p) > 10) AS is_leaf FROM parts)"""
LINKS = rf"""hrefs AS (SELECT page_id, url, list_filter(list_transform(regexp_extract_all({sql_code("html")}, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda h: replace(CASE WHEN h[1] IN ('"', '''') THEN h[2:-2] ELSE h END, '&amp;', '&')), lambda h: NOT starts_with(h, '#')) AS l FROM pages),
full_ AS (SELECT page_id, url, list_filter(list_transform(l, lambda h: CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || ':' || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || '://' || {HOST.format('url')} || h
  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || '://' || {HOST.format('url')} || coalesce(nullif(regexp_replace({PATH.format('url')}, '[^/]*$', ''), ''), '/') || h END), lambda u: regexp_matches(u, '^https?://'))[1:20] AS l FROM hrefs),
links AS (SELECT page_id, url AS page_url, (generate_subscripts(l, 1) - 1)::INTEGER AS link_no, unnest(l) AS url FROM full_)"""
CANDS = "cands AS (SELECT page_id // 20 AS query_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) AS rank, url FROM pages)"


def candidates(spark, sf_dir):
    """Pages as search results of queries, twenty of each at most."""
    p = table(spark, sf_dir, "pages").withColumn("query_id", F.floor(F.col("page_id") / 20))
    return p.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("page_id")).cast("long").alias("rank"), "url")


@query(with_(LEAF) + " SELECT page_id, n_paragraphs, n_chars, is_leaf FROM leaf")
def leaf_pages(spark, sf_dir):
    return W.leaf_flags(table(spark, sf_dir, "pages"))


@query(with_(LINKS) + " SELECT page_id, link_no, url FROM links")
def page_links(spark, sf_dir):
    return W.extract_links(table(spark, sf_dir, "pages"))


@query("SELECT page_id, url FROM pages")
def real_urls(spark, sf_dir):
    wrapped = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//search.example/l/?kh=-1&uddg="), F.url_encode("url"), F.lit("&rut=1"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.real_url(wrapped).alias("url"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(url), 'login|signup|account|captcha|auth|cookie')")
def safe_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~T.risky(F.col("url"))).select("page_id", "url")


@query(with_(LINKS) + f" SELECT page_id, count(*) FILTER (WHERE {HOST.format('url')} = {HOST.format('page_url')}) AS same, count(*) AS n FROM links GROUP BY page_id")
def same_domain_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = W.extract_links(pages).join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    return links.groupBy("page_id").agg(F.count_if(T.authority(F.col("url")) == T.authority(F.col("page_url"))).alias("same"), F.count("*").alias("n"))


@query(f"SELECT page_id, replace({HOST.format('url')}, '.', '_') || replace(substr({PATH.format('url')}, 1, 50), '/', '_') AS page_key FROM pages")
def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.page_key(F.col("url")).alias("page_key"))


BARE = rf"regexp_replace({sql_code('html')}, '(?is)<(nav|header|footer|aside)\b.*?</(nav|header|footer|aside)>', ' ', 'g')"
TEXT = rf"""bare AS (SELECT page_id, {BARE} AS h FROM pages),
body AS (SELECT page_id, CASE WHEN regexp_extract(h, '(?is)<article\b[^>]*>(.*)</article>', 1) <> '' THEN regexp_extract(h, '(?is)<article\b[^>]*>(.*)</article>', 1) WHEN regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body>', 1) <> '' THEN regexp_extract(h, '(?is)<body\b[^>]*>(.*)</body>', 1) ELSE h END AS h FROM bare),
texts AS (SELECT page_id, {sql_plain("h")} AS text FROM body)"""


@query(with_(TEXT) + " SELECT page_id // 20 AS query_id, string_agg(text, '----' ORDER BY page_id) AS text FROM texts GROUP BY ALL")
def page_text(spark, sf_dir):
    rows = W.page_text(table(spark, sf_dir, "pages")).select(F.floor(F.col("page_id") / 20).alias("query_id"), F.col("page_id").alias("rank"), "text")
    return W.join_texts(rows, "query_id")


@query(with_(CANDS) + " SELECT query_id, url, min(rank) AS rank FROM (SELECT * FROM cands UNION ALL SELECT query_id, rank + 1000, url FROM cands) GROUP BY ALL")
def dedupe_urls(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return W.dedupe_urls(c.unionByName(c.withColumn("rank", F.col("rank") + 1000)))


@query(with_(CANDS) + " SELECT query_id, rank, url FROM cands WHERE query_id % 3 = 0 UNION ALL SELECT query_id, rank, url FROM cands WHERE query_id % 3 <> 0 AND rank % 2 = 0")
def prefer_source(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return W.prefer_source(c.where("query_id % 3 = 0"), c.where("rank % 2 = 0"))


EXPANDED = f"""known AS (SELECT page_id, url, is_leaf FROM leaf), found AS (SELECT c.query_id, c.rank, k.page_id, k.url, k.is_leaf FROM cands c JOIN known k ON k.url = c.url),
picked AS (SELECT f.query_id, f.rank, l.url, row_number() OVER (PARTITION BY f.query_id, f.rank ORDER BY l.link_no) AS sub FROM found f JOIN links l ON l.page_id = f.page_id
  WHERE NOT f.is_leaf AND {HOST.format('l.url')} = {HOST.format('f.url')} AND NOT EXISTS (SELECT 1 FROM cands c WHERE c.query_id = f.query_id AND c.url = l.url)),
expanded AS (SELECT query_id, rank, 0::INTEGER AS sub, url FROM found WHERE is_leaf UNION ALL SELECT p.query_id, p.rank, p.sub::INTEGER, p.url FROM picked p JOIN known k ON k.url = p.url AND k.is_leaf WHERE p.sub <= 3)"""


@query(with_(LEAF, LINKS, CANDS, EXPANDED) + " SELECT * FROM expanded")
def expand_links(spark, sf_dir):
    return W.expand_links(candidates(spark, sf_dir), table(spark, sf_dir, "pages"))


@query(with_(LEAF, LINKS, CANDS, EXPANDED) + " SELECT query_id, rank, sub, url FROM (SELECT *, count(*) OVER (PARTITION BY query_id ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM expanded) WHERE before < 5")
def cap_pages(spark, sf_dir):
    return W.cap_pages(W.expand_links(candidates(spark, sf_dir), table(spark, sf_dir, "pages")))


@query(with_(CANDS) + f" SELECT query_id, rank, url, {HOST.format('url')} AS host, (row_number() OVER (PARTITION BY {HOST.format('url')} ORDER BY rank, url, query_id) - 1)::DOUBLE AS start_s FROM (SELECT DISTINCT query_id, rank, url FROM cands)")
def fetch_slots(spark, sf_dir):
    return W.fetch_slots(candidates(spark, sf_dir).distinct())
