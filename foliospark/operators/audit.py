"""Structural audit of documents: ten categories, one row a document each, and the tables they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import strip

D = "document_id"
OK_MESSAGE = "Document structure is internally consistent and verified."


def _at_least_zero(c: Column, places: int | None = None) -> Column:
    c = F.greatest(F.lit(0.0), c)
    return rounded(c, places) if places is not None else c


def _with_all(documents: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row a document (a table of ids alone has each once), with the parts' columns."""
    out = documents if documents.columns == [D] else documents.select(D).distinct()
    for p in parts:
        out = out.join(p, D, "left")
    return out


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def heading_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy(D).agg(F.count_if(F.col("type") == "HEADING").alias("heading_count"), F.count_if(F.col("type") == "SUBHEADING").alias("subheading_count"))


def heading_hierarchy(documents: DataFrame, regions: DataFrame, chapters: DataFrame) -> DataFrame:
    a = _with_all(documents, heading_counts(regions), chapters.groupBy(D).agg(F.count("*").alias("chapters_detected")))
    a = a.select(D, *[_n(c).alias(c) for c in ("heading_count", "subheading_count", "chapters_detected")])
    return a.withColumn("score", F.when((F.col("chapters_detected") > 0) & (F.col("heading_count") == 0), 0.85).otherwise(1.0))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Values of key that occur more than once in a document."""
    return rows.where(F.col(key).isNotNull()).groupBy(D, key).agg(F.count("*").alias("n")).where("n > 1")


def number_gaps(chapters: DataFrame) -> DataFrame:
    """Neighbouring chapter numbers more than 2 apart, in documents with three numbers or more."""
    w = Window.partitionBy(D).orderBy("number")
    g = chapters.where("number <> 0").select(D, "number", F.lead("number").over(w).alias("next_number"), F.count("*").over(Window.partitionBy(D)).alias("_n"))
    return g.where("_n >= 3 and next_number - number > 2").select(D, "number", "next_number")


def chapter_numbering(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Without a number the scheme is not_detected and the counts are null."""
    c = chapters.where("number <> 0").groupBy(D).agg(F.count("*").alias("total_numbered_chapters"))
    dup = duplicate_ids(chapters.where("number <> 0"), "number").groupBy(D).agg(F.count("*").alias("_dup"))
    gaps = number_gaps(chapters).groupBy(D).agg(F.count("*").alias("_gaps"))
    a = _with_all(documents, c, dup, gaps)
    some = F.col("total_numbered_chapters").isNotNull()
    return a.select(D, F.when(some, "numbered").otherwise("not_detected").alias("scheme"), "total_numbered_chapters", F.when(some, _n("_dup")).alias("duplicate_numbers"), F.when(some, _n("_gaps")).alias("gaps"), F.when(_n("_dup") > 0, 0.85).otherwise(1.0).alias("score"))


def section_numbering(documents: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    n = sections.groupBy(D).agg(F.count("*").alias("total_sections"))
    dup = duplicate_ids(sections, "section_id").groupBy(D).agg(F.count("*").alias("_dup"))
    several = chapters.groupBy(D).agg(F.count("*").alias("_chapters"))
    prefix = F.regexp_extract(strip(F.col("title")), r"^(\d+)\.\d+", 1)
    j = sections.select(D, "chapter_id", "title").join(chapters.select(D, "chapter_id", "number"), [D, "chapter_id"]).join(several, D)
    odd = j.where((F.col("number") != 0) & (F.col("_chapters") > 1) & (prefix != "") & (prefix != F.col("number").cast("string"))).groupBy(D).agg(F.count("*").alias("_odd"))
    a = _with_all(documents, n, dup, odd)
    some = F.col("total_sections").isNotNull()
    score = F.lit(1.0) - F.when(_n("_dup") > 0, 0.15).otherwise(0.0) - F.when(_n("_odd") > 0, 0.10).otherwise(0.0)
    return a.select(D, "total_sections", F.when(some, _n("_dup")).alias("duplicate_sections"), F.when(some, _n("_odd")).alias("unrelated_prefix_count"), rounded(score, 3).alias("score"))


def orphans(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks without a chapter id, and chunks whose chapter does not exist."""
    named = F.coalesce(F.col("chapter_id"), F.lit("")) != ""
    missing = chunks.where(named).join(chapters.select(D, "chapter_id"), [D, "chapter_id"], "left_anti").select(D, "chunk_id", F.lit("invalid_parent").alias("problem"))
    return chunks.where(~named).select(D, "chunk_id", F.lit("orphan").alias("problem")).unionByName(missing)


def parent_child(documents: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    o = orphans(chunks, chapters).groupBy(D).agg(F.count_if(F.col("problem") == "orphan").alias("orphan_chunks"), F.count_if(F.col("problem") == "invalid_parent").alias("invalid_parent_refs"))
    a = _with_all(documents, chunks.groupBy(D).agg(F.count("*").alias("_n")), o)
    size = F.greatest(F.lit(1), _n("_n"))
    score = F.lit(1.0) - F.least(F.lit(0.3), _n("orphan_chunks") / size) - F.least(F.lit(0.4), _n("invalid_parent_refs") / size)
    return a.select(D, _n("orphan_chunks").alias("orphan_chunks"), _n("invalid_parent_refs").alias("invalid_parent_refs"), _at_least_zero(score, 3).alias("score"))


def page_boundaries(documents: DataFrame, pages: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    top = pages.groupBy(D).agg(F.max("page_number").alias("max_page"))
    rows = chapters.select(D, "page_start", "page_end").unionByName(chunks.select(D, "page_start", "page_end"))
    bad = (F.col("page_start") < 1) | (F.col("page_end") > _n("max_page")) | (F.col("page_start") > F.col("page_end"))
    v = rows.join(top, D, "left").groupBy(D).agg(F.count_if(bad).alias("boundary_violations"), F.count("*").alias("_n"))
    a = _with_all(documents, top, v)
    score = F.lit(1.0) - F.least(F.lit(1.0), _n("boundary_violations") / F.greatest(F.lit(1), _n("_n")))
    return a.select(D, _n("boundary_violations").alias("boundary_violations"), _n("max_page").alias("max_page"), rounded(score, 3).alias("score"))


def reading_order(documents: DataFrame, regions: DataFrame, position: str = "region_no") -> DataFrame:
    """Pages whose order indices repeat, and pages whose indices, in the stored order, do not ascend."""
    w = Window.partitionBy(D, "page_number").orderBy(position)
    p = regions.withColumn("_down", (F.col("reading_order") < F.lag("reading_order").over(w)).cast("int"))
    p = p.groupBy(D, "page_number").agg((F.count("reading_order") != F.count_distinct("reading_order")).alias("dup"), (F.coalesce(F.max("_down"), F.lit(0)) > 0).alias("down"))
    a = _with_all(documents, p.groupBy(D).agg(F.count_if("dup").alias("duplicate_order_pages"), F.count_if("down").alias("non_monotonic_pages")))
    return a.select(D, _n("duplicate_order_pages").alias("duplicate_order_pages"), _n("non_monotonic_pages").alias("non_monotonic_pages"), F.when(_n("duplicate_order_pages") > 0, 0.9).otherwise(1.0).alias("score"))


def repeated_headings(regions: DataFrame) -> DataFrame:
    """Lower-cased headings of over 5 characters, and how often they occur in the document."""
    t = F.lower(strip(F.col("text")))
    return regions.where(F.col("type").isin("HEADING", "SUBHEADING") & (F.length(t) > 5)).groupBy(D, t.alias("heading")).agg(F.count("*").alias("occurrences"))


def duplicate_headings(documents: DataFrame, regions: DataFrame) -> DataFrame:
    n = F.col("occurrences")
    h = repeated_headings(regions).groupBy(D).agg(F.count("*").alias("_n"), F.count_if(n.between(2, 5)).alias("legitimate_duplicates"), F.count_if(n > 5).alias("likely_duplicate_errors"))
    a = _with_all(documents, h)
    return a.select(D, rounded(_n("likely_duplicate_errors") / F.greatest(F.lit(1), _n("_n")), 4).alias("duplicate_rate"), _n("legitimate_duplicates").alias("legitimate_duplicates"), _n("likely_duplicate_errors").alias("likely_duplicate_errors"))


def chapter_content(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """EMPTY without chunks, LOW_CONTENT with one chunk of under 50 tokens, else NORMAL."""
    c = chunks.groupBy(D, "chapter_id").agg(F.count("*").alias("n_chunks"), F.max("token_count").alias("_t"))
    j = chapters.select(D, "chapter_id").join(c, [D, "chapter_id"], "left")
    kind = F.when(F.col("n_chunks").isNull(), "EMPTY").when((F.col("n_chunks") == 1) & (F.col("_t") < 50), "LOW_CONTENT").otherwise("NORMAL")
    return j.select(D, "chapter_id", _n("n_chunks").alias("n_chunks"), kind.alias("classification"))


def empty_chapters(documents: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    e = chapter_content(chapters, chunks).groupBy(D).agg(F.count("*").alias("_n"), F.count_if(F.col("classification") == "EMPTY").alias("empty_chapter_count"), F.count_if(F.col("classification") == "LOW_CONTENT").alias("low_content_chapters"))
    a = _with_all(documents, e)
    return a.select(D, rounded(_n("empty_chapter_count") / F.greatest(F.lit(1), _n("_n")), 4).alias("empty_rate"), _n("empty_chapter_count").alias("empty_chapter_count"), _n("low_content_chapters").alias("low_content_chapters"))


def section_bounds(chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Each section against its chapter: VALID, QUESTIONABLE (one page off) or INVALID."""
    c = chapters.select(D, "chapter_id", F.col("page_start").alias("ch_start"), F.col("page_end").alias("ch_end"))
    j = sections.join(c, [D, "chapter_id"])
    out = (F.col("page_start") < F.col("ch_start")) | (F.col("page_end") > F.col("ch_end"))
    far = (F.col("page_end") > F.col("ch_end") + 1) | (F.col("page_start") < F.col("ch_start") - 1)
    return j.select(D, "chapter_id", "section_id", "page_start", "page_end", "ch_start", "ch_end", F.when(out & far, "INVALID").when(out, "QUESTIONABLE").otherwise("VALID").alias("status"))


def cross_boundary(documents: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    s = section_bounds(chapters, sections).groupBy(D).agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "INVALID").alias("invalid"), F.count_if(F.col("status") == "QUESTIONABLE").alias("questionable"))
    a = _with_all(documents, s)
    return a.select(D, _n("checked").alias("checked"), _n("invalid").alias("invalid"), _n("questionable").alias("questionable"), (_n("invalid") / F.greatest(F.lit(1), _n("checked"))).alias("rate"))


def misaligned_chunks(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    c = chapters.select(D, "chapter_id", F.col("page_start").alias("ch_start"), F.col("page_end").alias("ch_end"))
    return chunks.join(c, [D, "chapter_id"]).where("page_start < ch_start or page_end > ch_end").select(D, "chapter_id", "chunk_id", "page_start", "page_end", "ch_start", "ch_end")


def chunk_alignment(documents: DataFrame, chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    a = _with_all(documents, chunks.groupBy(D).agg(F.count("*").alias("total_chunks")), misaligned_chunks(chapters, chunks).groupBy(D).agg(F.count("*").alias("misaligned_chunks")))
    score = F.lit(1.0) - _n("misaligned_chunks") / F.greatest(F.lit(1), _n("total_chunks"))
    return a.select(D, _n("total_chunks").alias("total_chunks"), _n("misaligned_chunks").alias("misaligned_chunks"), _at_least_zero(score, 3).alias("score"))


def details(documents: DataFrame, pages: DataFrame, regions: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a document with a struct for each of the ten categories."""
    ids = documents.select(D).distinct()
    parts = {
        "heading_hierarchy": heading_hierarchy(ids, regions, chapters),
        "chapter_numbering": chapter_numbering(ids, chapters),
        "section_numbering": section_numbering(ids, chapters, sections),
        "parent_child_integrity": parent_child(ids, chapters, chunks),
        "page_boundary_integrity": page_boundaries(ids, pages, chapters, chunks),
        "reading_order": reading_order(ids, regions),
        "duplicate_headings": duplicate_headings(ids, regions),
        "empty_chapters": empty_chapters(ids, chapters, chunks),
        "cross_boundary_sections": cross_boundary(ids, chapters, sections),
        "chunk_alignment": chunk_alignment(ids, chapters, chunks),
    }
    out = ids
    for name, p in parts.items():
        out = out.join(p.select(D, F.struct(*[c for c in p.columns if c != D]).alias(name)), D, "left")
    return out


#: Of each metric the category and its field.
METRICS = {
    "heading_hierarchy": "heading_hierarchy.score", "chapter_numbering": "chapter_numbering.score", "section_numbering": "section_numbering.score",
    "parent_child_integrity": "parent_child_integrity.score", "page_boundary_integrity": "page_boundary_integrity.score", "reading_order": "reading_order.score",
    "duplicate_heading_rate": "duplicate_headings.duplicate_rate", "empty_chapter_rate": "empty_chapters.empty_rate",
    "cross_boundary_section_rate": "cross_boundary_sections.rate", "chunk_alignment": "chunk_alignment.score",
}


def metrics(documents: DataFrame, pages: DataFrame, regions: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ten metrics of each document in one row."""
    return details(documents, pages, regions, chapters, sections, chunks).select(D, *[F.col(at).alias(name) for name, at in METRICS.items()])


def recommendations(m: DataFrame) -> DataFrame:
    """document_id and its recommendations, one a row, in order."""
    said = F.array_compact(F.array(
        F.when(F.col("parent_child_integrity") < 0.9, "Review orphan chunks or sections that lack valid chapter association."),
        F.when(F.col("cross_boundary_section_rate") > 0.05, "Check chapter boundary heuristics as multiple sections extend past their parent chapter."),
        F.when(F.col("empty_chapter_rate") > 0.2, "Multiple empty chapters detected; verify if title/preface pages were classified as chapters."),
    ))
    said = F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(OK_MESSAGE)))
    return m.select(D, F.posexplode(said).alias("position", "recommendation")).withColumn("position", F.col("position").cast("long"))


def issues(documents: DataFrame, pages: DataFrame, regions: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """All issues: document_id, category_no, severity, category, n (what the issue counts)."""
    say = lambda df, no, cond, severity, category, n: df.where(cond).select(D, F.lit(no).cast("long").alias("category_no"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), n.cast("long").alias("n"))
    numbering, secs, parents = chapter_numbering(documents, chapters), section_numbering(documents, chapters, sections), parent_child(documents, chapters, chunks)
    top = pages.groupBy(D).agg(F.max("page_number").alias("max_page"))
    bad = chapters.join(top, D, "left").where("page_start < 1 or page_end > coalesce(max_page, 0) or page_start > page_end")
    parts = [
        say(heading_hierarchy(documents, regions, chapters), 1, F.col("score") < 1, "WARNING", "heading_hierarchy", F.col("chapters_detected")),
        say(numbering, 2, F.col("duplicate_numbers") > 0, "WARNING", "chapter_numbering", F.col("duplicate_numbers")),
        say(numbering, 2, F.col("gaps") > 0, "INFO", "chapter_numbering", F.col("gaps")),
        say(secs, 3, F.col("duplicate_sections") > 0, "WARNING", "section_numbering", F.col("duplicate_sections")),
        say(secs, 3, F.col("unrelated_prefix_count") > 0, "INFO", "section_numbering", F.col("unrelated_prefix_count")),
        say(parents, 4, F.col("orphan_chunks") > 0, "WARNING", "parent_child_integrity", F.col("orphan_chunks")),
        say(parents, 4, F.col("invalid_parent_refs") > 0, "ERROR", "parent_child_integrity", F.col("invalid_parent_refs")),
        say(bad, 5, F.lit(True), "ERROR", "page_boundary", F.col("chapter_no")),
        say(reading_order(documents, regions, "reading_order"), 6, F.col("duplicate_order_pages") > 0, "INFO", "reading_order", F.col("duplicate_order_pages")),
        say(section_bounds(chapters, sections), 9, F.col("status") == "INVALID", "ERROR", "cross_boundary_section", F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _listed(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def _quoted(values: Column) -> Column:
    return _listed(F.transform(values, lambda v: F.concat(F.lit("'"), v.cast("string"), F.lit("'"))))


def messages(made: DataFrame, pages: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """What a report says of each issue: document_id, category_no, position, severity, message. Values within a message ascend. made: details."""

    def say(df: DataFrame, no: int, severity: str, message: Column, position: Column | None = None) -> DataFrame:
        return df.select(D, F.lit(no).cast("long").alias("category_no"), (position if position is not None else F.lit(0)).cast("long").alias("position"), F.lit(severity).alias("severity"), message.alias("message"))

    def count(no: int, severity: str, field: str, before: str, after: str, position: int = 0) -> DataFrame:
        return say(made.where(F.col(field) > 0), no, severity, F.concat(F.lit(before), F.col(field).cast("string"), F.lit(after)), F.lit(position))

    gathered = lambda df, c: df.groupBy(D).agg(F.array_sort(F.collect_list(c)).alias("v"))
    twice = gathered(duplicate_ids(chapters.where("number <> 0"), "number"), F.col("number"))
    gaps = gathered(number_gaps(chapters), F.struct("number", "next_number"))
    pair = lambda v: F.concat(F.lit("("), v["number"].cast("string"), F.lit(", "), v["next_number"].cast("string"), F.lit(")"))
    top = pages.groupBy(D).agg(F.max("page_number").alias("max_page"))
    bad = chapters.join(top, D, "left").where("page_start < 1 or page_end > coalesce(max_page, 0) or page_start > page_end")
    bounds = section_bounds(chapters, sections).where("status = 'INVALID'")
    range_ = F.concat(F.lit("Invalid chapter page range ["), F.concat_ws(", ", "page_start", "page_end"), F.lit("] for '"), F.col("title"), F.lit("'"))
    parts = [
        say(made.where("heading_hierarchy.score < 1"), 1, "WARNING", F.lit("Chapters detected but zero HEADING regions classified on pages.")),
        say(twice, 2, "WARNING", F.concat(F.lit("Duplicate chapter numbers found: "), _quoted(F.col("v")))),
        say(gaps, 2, "INFO", F.concat(F.lit("Chapter numbering has gaps: "), _listed(F.transform("v", pair))), F.lit(1)),
        say(gathered(duplicate_ids(sections, "section_id"), F.col("section_id")), 3, "WARNING", F.concat(F.lit("Duplicate section IDs found: "), _quoted(F.col("v")))),
        count(3, "INFO", "section_numbering.unrelated_prefix_count", "", " section numbers do not match parent chapter prefix", 1),
        count(4, "WARNING", "parent_child_integrity.orphan_chunks", "Found ", " chunks without a parent chapter ID."),
        count(4, "ERROR", "parent_child_integrity.invalid_parent_refs", "Found ", " chunks referencing non-existent chapter IDs.", 1),
        say(bad, 5, "ERROR", range_, F.col("chapter_no")),
        count(6, "INFO", "reading_order.duplicate_order_pages", "Duplicate reading order indices found on ", " pages."),
        say(bounds.groupBy(D).agg(F.count("*").alias("n")).select(D, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("n")), 9, "INFO", F.lit(""), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _assembled(made: DataFrame, said: DataFrame, found: DataFrame) -> DataFrame:
    """made: details; said: recommendations; found: messages. One row a document, these in order as _r and _i."""
    recs = said.groupBy(D).agg(F.array_sort(F.collect_list(F.struct("position", "recommendation"))).alias("_r"))
    issues_ = found.groupBy(D).agg(F.array_sort(F.collect_list(F.struct("category_no", "position", "severity", "message"))).alias("_i"))
    return made.join(recs, D, "left").join(issues_, D, "left")


def _markdown() -> Column:
    score = lambda label, c: F.format_string(f"- **{label}**: %.2f", F.col(f"{c}.score").cast("double"))
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    part = lambda title: [F.lit(""), F.lit(f"## {title}")]
    none = F.array(F.lit("- No structural issues detected."))
    listed = F.transform("_i", lambda i: F.concat(F.lit("- **["), i["severity"], F.lit("]** "), i["message"]))
    lines = [
        F.concat(F.lit("# Structural Validation Report — "), F.col(D)), *part("Structural Summary"),
        score("Parent-Child Integrity", "parent_child_integrity"), score("Page Boundary Integrity", "page_boundary_integrity"), score("Reading Order Score", "reading_order"), score("Chunk Alignment Score", "chunk_alignment"),
        *part("Heading Hierarchy"), count("Headings", "heading_hierarchy.heading_count"), count("Subheadings", "heading_hierarchy.subheading_count"),
        *part("Chapter Numbering"), F.concat(F.lit("- Scheme: `"), F.col("chapter_numbering.scheme"), F.lit("`")), count("Numbered Chapters", "chapter_numbering.total_numbered_chapters"),
        *part("Section Numbering"), count("Total Sections", "section_numbering.total_sections"), count("Duplicate Section IDs", "section_numbering.duplicate_sections"),
        *part("Parent-Child Relationships"), count("Orphan Chunks", "parent_child_integrity.orphan_chunks"), count("Invalid Parent References", "parent_child_integrity.invalid_parent_refs"),
        *part("Page Boundaries"), count("Total Boundary Violations", "page_boundary_integrity.boundary_violations"),
        *part("Reading Order"), count("Non-monotonic Pages", "reading_order.non_monotonic_pages"),
        *part("Duplicate Headings"), count("Likely Duplicate Errors", "duplicate_headings.likely_duplicate_errors"),
        *part("Empty / Near-Empty Chapters"), count("Empty Chapters", "empty_chapters.empty_chapter_count"),
        *part("Cross-Boundary Sections"), count("Total Checked", "cross_boundary_sections.checked"),
        *part("Chunk Alignment"), count("Total Chunks", "chunk_alignment.total_chunks"), count("Misaligned Chunks", "chunk_alignment.misaligned_chunks"),
        *part("Detected Issues"), F.array_join(F.coalesce(listed, none), "\n"),
        *part("Recommendations"), F.array_join(F.transform("_r", lambda r: F.concat(F.lit("- "), r["recommendation"])), "\n"), F.lit(""),
    ]
    return F.array_join(F.array(*lines), "\n")


def reports(made: DataFrame, said: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, name, content: the five JSON reports of each document and the Markdown one."""
    categories = [c for c in made.columns if c != D]
    issues_ = F.transform("_i", lambda i: F.struct(i["severity"].alias("severity"), i["message"].alias("message")))
    issues_ = F.coalesce(issues_, F.array().cast("array<struct<severity:string,message:string>>")).alias("detected_issues")
    scores = F.struct(*[F.col(at).alias(name) for name, at in METRICS.items()]).alias("metrics")
    files = {
        "structural_validation.json": F.to_json(F.struct(D, scores, *categories, issues_, F.transform("_r", lambda r: r["recommendation"]).alias("recommendations"))),
        "chapter_audit.json": F.to_json(F.struct(F.col("chapter_numbering").alias("numbering"), "empty_chapters")),
        "section_audit.json": F.to_json(F.struct(F.col("section_numbering").alias("numbering"), "cross_boundary_sections")),
        "chunk_audit.json": F.to_json("chunk_alignment"),
        "reading_order_audit.json": F.to_json("reading_order"),
        "structural_validation.md": _markdown(),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in files.items()]))
    return _assembled(made, said, found).select(D, each.alias("f")).select(D, "f.name", "f.content")
