"""HTML listing extraction (S13) with built-in regular-expression functions.

The configured CSS selectors name the fields a listing page carries; here
the page's title, main heading, links and paragraphs are taken with
``regexp_extract`` / ``regexp_extract_all`` so the work stays in the JVM
(whole pages, no Python per row).  A small fixed entity table decodes the
entities the pages use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns and the entity table --------------------------
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
HREF = r"(?is)<a\s[^>]*href=\"([^\"]*)\""
PARAGRAPH = r"(?is)<p[\s>]"
ARTICLE = r"(?is)<article[^>]*>(.*?)</article>"
TAG = r"<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
            ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]
# --- end of fixed values --------------------------------------------------


def unescape(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAG, " "), r"\s+", " "))


def extract_listings(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per page: title, heading, link count and first link,
    paragraph count and the article text length (entities decoded)."""
    h = F.col(html)
    links = F.regexp_extract_all(h, F.lit(HREF), 1)
    text = unescape(strip_tags(F.regexp_extract(h, ARTICLE, 1)))
    return pages.select(
        "page_id", "url",
        unescape(F.trim(F.regexp_extract(h, TITLE, 1))).alias("title"),
        unescape(strip_tags(F.regexp_extract(h, H1, 1))).alias("heading"),
        F.size(links).cast("long").alias("n_links"),
        F.get(links, 0).alias("first_link"),
        F.regexp_count(h, F.lit(PARAGRAPH)).cast("long").alias("n_paragraphs"),
        F.length(text).cast("long").alias("text_chars"))


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """S13 items: one row per link (page, position, href)."""
    links = F.regexp_extract_all(F.col(html), F.lit(HREF), 1)
    return pages.select("page_id", F.posexplode(links).alias("position", "href"))
