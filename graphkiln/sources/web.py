"""Fetched responses as sources: pages and the paged lists of posts of a blog's interface. Fetching itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses after which a request is repeated, so they end nothing.
RETRIED = (429, 503)
TERM = "struct<id:long,name:string>"
POST = f"struct<id:long,link:string,title:struct<rendered:string>,content:struct<rendered:string>,_embedded:struct<`wp:term`:array<array<{TERM}>>>>"


def fetched(responses: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """(url, html, error), one row a url that isn't in ``visited`` (url): the html of status 200, else why there is none.

    responses: url, status (null: no answer), html. Of several responses a good one counts, else the one of the lowest status. Null urls are left out.
    """
    rows = responses.filter("url IS NOT NULL")
    if visited is not None:
        rows = rows.join(visited.select("url").distinct(), "url", "left_anti")
    fine = F.coalesce((F.col("status") == 200) & F.col("html").isNotNull(), F.lit(False))
    best = rows.groupBy("url").agg(F.min(F.struct((~fine).alias("bad"), F.coalesce("status", F.lit(999)).alias("status"), "html")).alias("r"))
    error = F.when(F.col("r.bad"), F.when(F.col("r.status") == 999, "no answer").when(F.col("r.status") == 200, "empty").otherwise(F.concat(F.lit("HTTP "), F.col("r.status").cast("string"))))
    return best.select("url", F.when(~F.col("r.bad"), F.col("r.html")).alias("html"), error.alias("error"))


def posts(responses: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(page, id, link, title, html, categories, tags) of the pages before the first that ends the list.

    responses: page (from 1), status, total_pages (null: unknown), body (JSON array). The list ends at a page with an error, no
    posts or unreadable JSON, behind the stated total or ``max_pages``; statuses that are retried count for nothing.
    """
    rows = responses.filter(~F.coalesce(F.col("status").isin(*RETRIED), F.lit(False)))
    items = F.from_json("body", f"array<{POST}>")
    rows = rows.select("page", "status", "total_pages", items.alias("items"))
    ends = (F.coalesce(F.col("status"), F.lit(0)) != 200) | (F.coalesce(F.size("items"), F.lit(0)) <= 0)
    last = rows.agg(F.min(F.when(ends, F.col("page"))).alias("_end"), F.min(F.when(F.col("total_pages") >= F.col("page"), F.col("total_pages"))).alias("_total"))
    # One row, whatever the number of pages.
    rows = rows.join(F.broadcast(last)).filter("_end IS NULL OR page < _end").filter("_total IS NULL OR page <= _total")
    rows = rows if max_pages is None else rows.filter(F.col("page") <= max_pages)
    post = rows.select("page", F.explode("items").alias("p"))
    terms = lambda k: F.coalesce(F.get("p._embedded.wp:term", F.lit(k)), F.array().cast(f"array<{TERM}>"))
    return post.select("page", "p.id", "p.link", F.col("p.title.rendered").alias("title"), F.col("p.content.rendered").alias("html"), terms(0).alias("categories"), terms(1).alias("tags"))


def term_counts(found: DataFrame) -> DataFrame:
    """(kind, id, name, n): how many posts have each category and tag."""
    kinds = [found.select(F.lit(kind).alias("kind"), F.explode(kind).alias("t")) for kind in ("categories", "tags")]
    return kinds[0].unionByName(kinds[1]).filter("t.id IS NOT NULL").groupBy("kind", "t.id").agg(F.max("t.name").alias("name"), F.count("*").alias("n"))
