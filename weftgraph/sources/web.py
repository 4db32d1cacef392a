"""Links of HTML pages, and a crawl over a table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.functions.text import hrefs, slug


def resolve(url, href):
    """A link against its page: absolute, by host, or by directory."""
    host = F.regexp_extract(url, r"^[a-z]+://[^/]+", 0)
    folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "[^/]*$", "")
    return F.when(href.rlike("^https?://"), href).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(folder, href))


def links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, href, target): every link of every page, resolved."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), F.explode(hrefs(F.col(html_col))).alias("href"))
    return rows.select(id_col, "href", resolve(F.col("_url"), F.col("href")).alias("target"))


def crawl(pages: DataFrame, start: DataFrame, depth: int = 2, max_pages: int = 50, *, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """((url, depth), (parent, child)): breadth first from start (url) over a table of fetched pages.

    Fetching itself is the caller's: pages holds what was fetched, so a link
    whose target is not in it ends there.  max_pages trims by depth, then url.
    """
    from weftgraph.operators.traverse import frontier

    found = links(pages, url_col, url_col, html_col).select(F.col(url_col).alias("src"), F.regexp_replace("target", "#.*$", "").alias("dst"))
    edges = found.join(pages.select(F.col(url_col).alias("dst")), "dst", "left_semi").where("src <> dst").distinct()
    reached = frontier(start.select(F.lit(0).alias("seed"), F.col("url").alias("id")), edges, depth).orderBy("depth", "id").limit(max_pages)
    kept = reached.select(F.col("id").alias("url"), "depth")
    own = kept.select("url")
    return kept, edges.join(own.withColumnRenamed("url", "src"), "src", "left_semi").join(own.withColumnRenamed("url", "dst"), "dst", "left_semi").select(F.col("src").alias("parent"), F.col("dst").alias("child"))


def file_name(url):
    """A file name for a saved page."""
    return F.concat(F.substring(slug(F.regexp_replace(url, "^[a-z]+://", "")), 1, 120), F.lit(".html"))
