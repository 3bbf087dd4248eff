"""Documents (S10-S12, F19, F20, F33, D7, D20, D21, J3, U5, W3): page text, quality, bundles and readiness."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeflow.functions.text import page_signals

#: Elements whose text is not visible.
HIDDEN = {"script", "style", "noscript"}


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN

    def handle_endtag(self, tag):
        self.depth -= tag in HIDDEN and self.depth > 0

    def handle_data(self, data):
        if not self.depth and (text := data.strip()):
            self.parts.append(text)


def visible_text():
    """A UDF for the visible text of HTML, one piece of text per line; null counts as empty."""

    def one(source: str | None) -> str:
        p = _Visible()
        p.feed(source or "")
        p.close()
        return "\n".join(p.parts)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(one)

    return run


def parse_route(media_type):
    """Which way a document's text comes."""
    return F.when(media_type.isin("text/html", "application/pdf"), "native").when(media_type.isin("image/png", "image/jpeg"), "needs_ocr").otherwise("unsupported")


def document_quality(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """per document the pages, those that need OCR, and their reasons prefixed by page, in page order."""
    signals = page_signals(F.col("text"))
    tagged = pages.select(doc, "page_number", signals["status"].alias("status"), F.transform(signals["reasons"], lambda r: F.concat(F.lit("page_"), F.col("page_number").cast("string"), F.lit(":"), r)).alias("reasons"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "reasons")))
    return tagged.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "needs_ocr").alias("weak_pages"), F.flatten(F.transform(ordered, lambda x: x["reasons"])).alias("reasons"))


def trusted_parses(parses: DataFrame, attachment: str = "attachment_id") -> DataFrame:
    """One parse per attachment: recognised text beats native, then the highest parser version."""
    w = W.partitionBy(attachment).orderBy((F.col("parser_kind") == "ocr").desc(), F.col("parser_version").desc())
    return parses.where("status = 'trusted'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def same_claim(field: Column, a: Column, b: Column) -> Column:
    """whether two claims of a field say the same: numbers as decimals, instants as instants, lists as sets, text as it is."""
    items = lambda c: F.array_sort(F.array_distinct(F.from_json(c, "array<string>")))
    number = F.coalesce(a.try_cast("decimal(38,6)") == b.try_cast("decimal(38,6)"), a == b)
    instant = F.coalesce(F.try_to_timestamp(a) == F.try_to_timestamp(b), a == b)
    as_list = F.coalesce(items(a) == items(b), a == b)
    lists = ("regions", "required_certifications", "required_capabilities", "participation_constraints")
    return F.when(field == "estimated_amount", number).when(field.isin("published_at", "closes_at"), instant).when(field.isin(*lists), as_list).otherwise(a == b)


def withhold_conflicts(upstream: DataFrame, attachment: DataFrame, keys: list[str]) -> DataFrame:
    """Attachment claims with conflict flags against upstream ones; amount and currency are withheld together."""
    both = attachment.join(upstream.select(*keys, "field", F.col("value").alias("upstream_value")), [*keys, "field"], "left")
    differ = F.coalesce(~same_claim(F.col("field"), F.col("value"), F.col("upstream_value")), F.lit(False))
    pair = F.when(F.col("field").isin("estimated_amount", "currency"), "budget").otherwise(F.col("field"))
    return both.withColumn("conflict", F.max(differ).over(W.partitionBy(*keys, pair)))


def document_bundle(attachments: DataFrame, parses: DataFrame, version: str = "version_id") -> DataFrame:
    """Trusted, non-blank pages of a version's attachments, one parse each, without repeats, in order."""
    best = trusted_parses(parses)
    pages = attachments.join(best, "attachment_id").select(version, "sha256", "parser_kind", F.explode("pages").alias("page"))
    seen = pages.where(F.trim(F.regexp_replace("page.text", r"(?U)\s+", " ")) != "").select(version, F.struct("sha256", F.col("page.page_number").alias("page_number"), F.col("page.text").alias("text"), "parser_kind").alias("p"))
    return seen.groupBy(version).agg(F.array_sort(F.collect_set("p")).alias("bundle"))


def readiness(versions: DataFrame, attachments: DataFrame) -> DataFrame:
    """Gaps that keep a version from being compared; ready without any. versions: version_id, documents_complete,
    extraction_status; attachments: version_id, status."""
    open_ = attachments.where(~F.col("status").isin("parsed", "unsupported", "parse_failed")).groupBy("version_id").agg(F.count(F.lit(1)).alias("open"))
    gaps = F.array_compact(F.array(F.when(~F.col("documents_complete"), "documents_incomplete"), F.when(F.col("open") > 0, "attachments_pending"), F.when(~F.coalesce(F.col("extraction_status").isin("done", "dead_lettered"), F.lit(False)), "extraction_missing")))
    return versions.join(open_, "version_id", "left").select("version_id", gaps.alias("gaps"), (F.size(gaps) == 0).alias("ready"))
