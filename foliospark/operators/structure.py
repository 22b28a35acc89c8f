"""Chapters and sections of a document.

Candidates are a small part of the lines; only they and page keys enter windows over a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHAPTER, LONG_LINE, NUMBERED, SECTION, roman_value, strip, token_count

DOC = ["document_id"]


def region_lines(regions: DataFrame) -> DataFrame:
    """The non-blank trimmed lines of up to 120 characters, with their region's order and type."""
    ls = regions.select("document_id", "page_number", "reading_order", "type", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return ls.withColumn("line", strip(F.col("raw"))).where(F.col("line") != "").where(F.length("line") <= LONG_LINE).drop("raw")


def explicit_chapters(lines: DataFrame) -> DataFrame:
    m = lines.where(F.col("line").rlike(CHAPTER))
    n = roman_value(F.regexp_extract("line", CHAPTER, 1))
    title = strip(F.regexp_extract("line", CHAPTER, 2))
    return m.select(
        "document_id", "page_number", "reading_order", "line_no", F.lit(0).alias("rule"), n.cast("long").alias("number"),
        F.when(title != "", title).otherwise(F.concat(F.lit("Chapter "), n.cast("string"))).alias("title"),
        F.when(F.col("type").isin("HEADING", "SUBHEADING"), 0.96).otherwise(0.88).alias("confidence"), F.lit("pattern_explicit").alias("detection_method"),
    )


def numbered_chapters(lines: DataFrame) -> DataFrame:
    m = lines.where((F.col("type") == "HEADING") & F.col("line").rlike(NUMBERED) & ~F.lower("line").startswith("section"))
    n = F.regexp_extract("line", NUMBERED, 1)
    m = m.where(n.try_cast("long").between(1, 99)) if hasattr(n, "try_cast") else m.where(F.length(n) < 10).where(n.cast("long").between(1, 99))
    return m.select("document_id", "page_number", "reading_order", "line_no", F.lit(1).alias("rule"), n.cast("long").alias("number"), strip(F.regexp_extract("line", NUMBERED, 2)).alias("title"), F.lit(0.85).alias("confidence"), F.lit("pattern_numbered_heading").alias("detection_method"))


def first_per_page(candidates: DataFrame) -> DataFrame:
    """The first candidate of each page in reading order."""
    w = Window.partitionBy("document_id", "page_number").orderBy("reading_order", "line_no", "rule")
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def chapter_candidates(regions: DataFrame) -> DataFrame:
    ls = region_lines(regions)
    return first_per_page(explicit_chapters(ls).unionByName(numbered_chapters(ls)))


def page_span(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))


def chapter_ranges(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Each candidate up to the page before the next; without any, the whole document is one chapter."""
    w = Window.partitionBy("document_id").orderBy("page_number")
    c = candidates.withColumn("chapter_no", F.row_number().over(w).cast("long")).withColumn("_next", F.lead("page_number").over(w))
    j = page_span(pages).join(c, "document_id", "left")
    none = F.col("page_number").isNull()
    start = F.coalesce("page_number", "first_page")
    end = F.when(none | F.col("_next").isNull(), F.col("last_page")).otherwise(F.greatest(F.col("page_number"), F.col("_next") - 1))
    no = F.coalesce("chapter_no", F.lit(1)).cast("long")
    return j.select(
        "document_id", no.alias("chapter_no"), F.format_string("ch_%03d", no).alias("chapter_id"), F.coalesce("number", F.lit(1)).cast("long").alias("number"),
        F.coalesce("title", F.lit("Introduction / Main Content")).alias("title"), start.alias("page_start"), end.alias("page_end"),
        F.coalesce("confidence", F.lit(0.50)).alias("confidence"), F.coalesce("detection_method", F.lit("fallback_single_chapter")).alias("detection_method"),
    )


def detect_chapters(regions: DataFrame, pages: DataFrame) -> DataFrame:
    return chapter_ranges(chapter_candidates(regions), pages)


def pages_in_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """document_id, page_number and its chapter's fields. As chapters tile a document, this is the last chapter to start at or before the page."""
    fields = ["chapter_no", "chapter_id", "number", "page_start", "page_end"]
    n = chapters.groupBy("document_id").agg(F.count("*").alias("n_chapters"))
    starts = chapters.join(n, "document_id").select("document_id", F.col("page_start").alias("page_number"), F.struct(*fields, "n_chapters").alias("ch"))
    p = pages.select("document_id", "page_number").distinct().join(starts, ["document_id", "page_number"], "left")
    w = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("ch", F.last("ch", ignorenulls=True).over(w)).where("ch is not null").select("document_id", "page_number", "ch.*").where("page_number <= page_end")


def source_pages(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """The page ids of each chapter, in order."""
    page_id = F.concat(F.col("document_id"), F.format_string("_p%04d", "page_number"))
    p = pages_in_chapters(pages, chapters).groupBy("document_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("page_number", page_id.alias("id")))).alias("p"))
    return p.select("document_id", "chapter_id", F.size("p").cast("long").alias("n_pages"), F.array_join(F.transform("p", lambda x: x["id"]), ",").alias("source_pages"))


def section_candidates(regions: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    numeric = F.col("line").rlike(SECTION)
    plain = (F.col("type") == "SUBHEADING") & (token_count(F.col("line")) < 10)
    ls = region_lines(regions).where(numeric | plain).join(pages_in_chapters(pages, chapters), ["document_id", "page_number"])  # only candidates meet their chapter
    number = F.regexp_replace(F.regexp_extract("line", SECTION, 1), r"\s+", "")
    own = number.startswith(F.concat(F.col("number").cast("string"), F.lit("."))) | (F.col("n_chapters") == 1)
    return ls.where(F.when(numeric, own).otherwise(plain)).select("document_id", "chapter_id", "chapter_no", "page_number", "reading_order", "line_no", F.col("line").alias("title"), F.col("page_end").alias("chapter_end"))


def section_ranges(candidates: DataFrame) -> DataFrame:
    """Repeated titles of one page count once; each section ends on the page before the next, but not before its start."""
    one = Window.partitionBy("document_id", "chapter_id", "page_number", "title").orderBy("reading_order", "line_no")
    c = candidates.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    w = Window.partitionBy("document_id", "chapter_id").orderBy("page_number", "reading_order", "line_no")
    no = F.row_number().over(w)
    end = F.coalesce(F.greatest("page_number", F.lead("page_number").over(w) - 1), F.col("chapter_end"))
    return c.select("document_id", "chapter_id", no.cast("long").alias("section_no"), F.concat(F.col("chapter_id"), F.format_string("_s%03d", no)).alias("section_id"), "title", F.col("page_number").alias("page_start"), end.alias("page_end"))


def detect_sections(regions: DataFrame, chapters: DataFrame, pages: DataFrame) -> DataFrame:
    return section_ranges(section_candidates(regions, chapters, pages))


def active_sections(pages: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """For each page of a chapter the first section, in order, that covers it (null if none).

    That is the first to start on the page or else, as starts ascend, the last to start before it.
    """
    at = sections.groupBy("document_id", "chapter_id", F.col("page_start").alias("page_number")).agg(F.min_by("section_id", "section_no").alias("first_id"), F.max_by(F.struct("section_id", "page_end"), "section_no").alias("last_one"))
    p = pages_in_chapters(pages, chapters).select("document_id", "chapter_id", "chapter_no", "page_number").join(at, ["document_id", "chapter_id", "page_number"], "left")
    w = Window.partitionBy("document_id", "chapter_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_b", F.last("last_one", ignorenulls=True).over(w))
    before = F.when(F.col("_b")["page_end"] >= F.col("page_number"), F.col("_b")["section_id"])
    return p.select("document_id", "chapter_id", "chapter_no", "page_number", F.coalesce("first_id", before).alias("section_id"))


def section_number(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, SECTION, 1), r"\s+", "")
