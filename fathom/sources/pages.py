"""Pages: links, snippets, one level of following, candidate addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def absolute(link: Column, url: Column) -> Column:
    """A link against its page: absolute, rooted, or beside the page."""
    site = F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(url, r"^([a-z]+://[^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    return F.when(link.rlike("^[a-z]+:"), link).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, F.lit("/"), link))


def links(pages: DataFrame, pattern: str = ".") -> DataFrame:
    """Distinct links (page_id, link) that match."""
    each = pages.select("page_id", "url", F.explode(F.array_distinct(hrefs(F.col("html")))).alias("href"))
    return each.select("page_id", absolute(F.col("href"), F.col("url")).alias("link")).where(F.col("link").rlike(pattern)).distinct()


def follow(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Pages that other pages of the same site link to, themselves not among those that link: one level, each once."""
    to = links(pages)
    host = lambda c: F.parse_url(c, F.lit("HOST"))
    source = to.join(pages.select("page_id", "url"), "page_id").where(host(F.col("link")) == host(F.col("url"))).select("link", "page_id")
    seen = to.select("page_id").distinct()
    reached = pages.select(F.col("page_id").alias("target_id"), F.col("url").alias("link")).join(source, "link")
    new = reached.join(seen.select(F.col("page_id").alias("target_id")), "target_id", "left_anti").groupBy("target_id").agg(F.min("page_id").alias("from_id"), F.count(F.lit(1)).alias("n_links"))
    return new if most is None else new.orderBy("target_id").limit(most)


def frontier(pages: DataFrame, seeds: DataFrame, pattern: str = ".") -> DataFrame:
    """What is one link from the seeds (page_id) on their own sites and was not visited: (link, from_id, n_pages, known_id), each address once.

    Visited is what the seeds' addresses name, fragments aside; ``known_id`` is the smallest page of the table that has the address, if one has it.
    """
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    host = lambda c: F.regexp_extract(c, "^[a-z]+://([^/?#]+)", 1)
    start = pages.join(seeds.select("page_id").distinct(), "page_id", "left_semi")
    each = start.select("page_id", "url", F.explode(F.array_distinct(hrefs(F.col("html")))).alias("href"))
    found = each.select("page_id", "url", bare(absolute(F.col("href"), F.col("url"))).alias("link")).where(F.col("link").rlike(pattern) & (host("link") == host("url")))
    new = found.groupBy("link").agg(F.min("page_id").alias("from_id"), F.count_distinct("page_id").alias("n_pages"))
    new = new.join(start.select(bare("url").alias("link")).distinct(), "link", "left_anti")
    known = pages.groupBy(bare("url").alias("link")).agg(F.min("page_id").alias("known_id"))
    return new.join(known, "link", "left")


def snippets(pages: DataFrame, pattern: str, before: int = 160, after: int = 240, most: int = 40) -> DataFrame:
    """Text around the first matches in each page, tags off and white space squeezed."""
    found = pages.select("page_id", F.slice(F.regexp_extract_all("html", F.lit(f"(?is)(.{{0,{before}}}(?:{pattern}).{{0,{after}}})"), F.lit(1)), 1, most).alias("ss"))
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))
    return found.select("page_id", F.posexplode("ss").alias("i", "s")).select("page_id", "i", clean(F.col("s")).alias("snippet"))


def address_grid(names: DataFrame, bases: list[str], endings: list[str]) -> DataFrame:
    """All addresses of names with two short literal lists."""
    each = names.select("name", F.explode(F.array(*map(F.lit, bases))).alias("base")).select("*", F.explode(F.array(*map(F.lit, endings))).alias("ending"))
    return each.select(F.concat("base", "name", F.lit("."), "ending").alias("url"), "base", "name", "ending")


def probe_outcome(rows: DataFrame, status: str = "status") -> DataFrame:
    """Probes that aren't plainly refused or missing, and whether they succeeded."""
    return rows.where(~F.col(status).isin(403, 404)).withColumn("success", F.col(status).isin(200, 206))
