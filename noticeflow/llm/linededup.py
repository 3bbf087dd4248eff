"""Operator 3, line dedup by site-relative frequency, in DataFrame functions only.

For each site the pages that contain a line are divided by the site's pages; a line beyond `most_percent` on
at least `least_pages` pages is boilerplate there and is dropped from all of the site's pages. Counting is a
partial aggregate per (site, line digest), so a line on a third of all pages leaves each task as one row. The
boilerplate lines reach the pages by broadcast only when their counted number is small; beyond that the pages'
own lines are joined with them and the removals come back per page, so a large site never meets in one task.

With `texts` equal texts of a site count as one page of it, and a page that would lose more than half of its characters
(a near copy of many others) loses no line but those on more than half of the site's pages, or none if that is still
too much: copies are for a later stage to join, and one of them must get there whole.

Defined results: a null site is a site of its own; null text stays null and counts as a page without lines; lines
without a visible character are never dropped; repeated rows are separate pages; an empty table gives no rows;
extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticeflow.llm.shared import aside, cut, only

#: Boilerplate lines up to which all of them are sent to every executor (a few tens of bytes each).
BROADCAST_LINES = 50_000


def _digest(line: Column) -> Column:
    """A line's bucket hash, and 128 bits of its SHA-256: nobody can write a line that passes for another."""
    return F.struct(F.xxhash64(line).alias("a"), F.unhex(F.substring(F.sha2(line, 256), 1, 32)).alias("b"))


def _digests(text: Column) -> Column:
    """The distinct digests of a page's visible lines."""
    visible = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\s]"))
    return F.array_distinct(F.transform(visible, _digest))


def boilerplate(pages: DataFrame, *, site: str = "source", text: str = "text", most_percent: int = 2, least_pages: int = 5, texts: bool = False) -> DataFrame:
    """Per boilerplate line: site, line (digest), pages with it, pages of the site (texts: distinct ones)."""
    narrow = pages.select(F.col(f"`{site}`").alias("site"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    each, own = narrow.select("site", "mark"), narrow.select("site", "mark", F.explode(_digests(F.col("text"))).alias("line"))
    if texts:
        each, own = each.distinct(), own.distinct()
    totals = each.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    lines = own.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages"))
    often = lines.where(F.col("pages") >= least_pages)
    return often.join(totals, often["site"].eqNullSafe(totals["site"])).where(F.col("pages") * 100 > F.col("site_pages") * most_percent).select(often["site"], "line", "pages", "site_pages")


def _buckets(found: DataFrame, name: str) -> DataFrame:
    """Per site its boilerplate lines as an array of buckets by hash, a few lines each: a page's line is looked up in one."""
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("site")) / 8)).cast("int")
    dealt = found.select("site", "line", n.alias("n")).withColumn("bucket", F.pmod("line.a", "n").cast("int"))
    lists = dealt.groupBy("site", "n", "bucket").agg(F.collect_list("line").alias("lines"))
    maps = lists.groupBy("site", "n").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "lines"))).alias("m"))
    empty = F.array().cast(lists.schema["lines"].dataType)
    return maps.select("site", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.col("m")[i], empty)).alias(name))


def drop_boilerplate(pages: DataFrame, *, site: str = "source", text: str = "text", key: str = "doc_id", broadcast_lines: int = BROADCAST_LINES, texts: bool = False, **options) -> DataFrame:
    """The pages with boilerplate lines removed from `text`, and n_lines, n_dropped (long)."""
    columns = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    found = cut(boilerplate(pages, site=site, text=text, texts=texts, **options))
    core = F.col("pages") * 2 > F.col("site_pages")
    few = found.count() <= broadcast_lines
    if few:
        gone = _buckets(found, "gone")
        if texts:
            most = _buckets(found.where(core), "core").withColumnRenamed("site", "_site")
            gone = gone.join(most, F.col("site").eqNullSafe(F.col("_site")), "left").select("site", "gone", "core")
        on = F.col(f"p.`{site}`").eqNullSafe(F.col("g.site"))
        both = pages.alias("p").join(F.broadcast(gone).alias("g"), on, "left")
    else:
        own = pages.select(F.col(f"`{site}`").alias("site"), F.col(f"`{key}`").alias("key"), F.explode(_digests(F.col(f"`{text}`"))).alias("line")).alias("o")
        hits = own.join(found.alias("f"), F.col("o.site").eqNullSafe(F.col("f.site")) & (F.col("o.line") == F.col("f.line")))
        # rows of one key and site share what is dropped: a line is boilerplate for the whole site
        gone = hits.groupBy("o.site", "o.key").agg(F.array(F.collect_set("o.line")).alias("gone"), F.array(F.collect_set(F.when(core, F.col("o.line")))).alias("core"))
        on = F.col(f"p.`{site}`").eqNullSafe(F.col("g.site")) & F.col(f"p.`{key}`").eqNullSafe(F.col("g.key"))
        both = pages.alias("p").join(gone.alias("g"), on, "left")
    lines = F.split(F.col(f"p.`{text}`"), "\n")
    without = lambda c: F.when(F.col(c).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.get(F.col(c), F.pmod(F.xxhash64(x), F.size(c)).cast("int")), _digest(x))))
    left = without("g.gone")
    if texts:
        half = lambda c: F.length(F.array_join(c, "")) * 2 >= F.length(F.array_join(lines, ""))
        left = F.when(half(left), left).when(half(without("g.core")), without("g.core")).otherwise(lines)
    out = both.select(*(F.col(f"p.`{c}`") for c in columns if c != text), lines.alias("_nf_lines"), left.alias("_nf_left"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    made = {text: F.array_join("_nf_left", "\n"), "n_lines": size("_nf_lines"), "n_dropped": size("_nf_lines") - size("_nf_left")}
    return out.select(*(made[c].alias(c) if c == text else F.col(f"`{c}`") for c in columns), made["n_lines"].alias("n_lines"), made["n_dropped"].alias("n_dropped"))


def cleaned(pages: DataFrame, *, site: str = "source", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The pages without their boilerplate lines, in the columns they had; n_chars, if there, follows the text. See `texts`."""
    counted = ["n_chars"] if "n_chars" in pages.columns else []
    rows, back = aside(pages, site, text, key, *counted)
    out = drop_boilerplate(rows, site=site, text=text, key=key, **options)
    return back(out.withColumns({c: F.length(F.col(f"`{text}`")).cast("long") for c in counted}))


#: The same in DuckDB, for documents with source as the site and the default thresholds.
ORACLE = """
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages),
often AS (SELECT source, line, count(DISTINCT r) AS n FROM lines WHERE regexp_matches(line, '[^\\s]') GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
bad AS (SELECT o.source, o.line FROM often o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n * 100 > total * 2),
marked AS (SELECT l.r, l.line, l.pos, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line),
made AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY r)
SELECT p.doc_id, p.source, m.text, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dropped, 0) AS n_dropped FROM pages p LEFT JOIN made m ON p.r = m.r
"""


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, the cleaned text, n_lines and n_dropped per document."""
    return drop_boilerplate(only(docs, "doc_id", "source", "text"), **options)
