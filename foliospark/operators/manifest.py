"""Manifests, processing state and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

D = "document_id"
STATUSES = ("queued", "processing", "completed", "completed_with_errors", "failed")


def page_range(pages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Pages of the inclusive range, with is_partial_run of their document."""
    last = pages.groupBy(D).agg(F.max("page_number").alias("total_pages"))
    lo = F.lit(max(1, start or 1))
    hi = F.least(F.col("total_pages"), F.lit(end)) if end else F.col("total_pages")
    p = pages.join(last, D)
    return p.where(F.col("page_number").between(lo, hi)).withColumn("is_partial_run", (lo > 1) | (hi < F.col("total_pages"))).drop("total_pages")


def not_cached(pages: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Pages still to process: all, if forced; else those that are not cached."""
    return pages if force else pages.join(cached.select(D, "page_number"), [D, "page_number"], "left_anti")


def manifest(pages: DataFrame, failed: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Totals of each document and the names of its processed pages."""
    name = F.format_string("pages/%04d.json", "page_number")
    ps = pages.groupBy(D).agg(F.count("*").alias("processed_pages"), F.max("page_number").alias("page_count"), F.array_sort(F.collect_list(name)).alias("_names"))
    out = ps
    for n, df in (("failed_pages", failed), ("chapters", chapters), ("sections", sections), ("chunks", chunks)):
        out = out.join(df.groupBy(D).agg(F.count("*").alias(n)), D, "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("failed_pages", "chapters", "sections", "chunks")]
    return out.select(D, "page_count", "processed_pages", *zero, F.array_join("_names", ",").alias("pages"))


def percent(done: Column, total: Column, places: int = 2) -> Column:
    return F.when(total > 0, rounded(done / total * 100, places)).otherwise(0.0)


def running_progress(pages: DataFrame) -> DataFrame:
    """Progress after each page, in page order."""
    w = Window.partitionBy(D)
    done, total = F.row_number().over(w.orderBy("page_number")), F.count("*").over(w)
    return pages.select(D, "page_number", done.cast("long").alias("done"), total.alias("total"), percent(done, total, 1).alias("progress"))


def latest_state(log: DataFrame) -> DataFrame:
    """The last record of each document (ties by event_id)."""
    last = log.groupBy(D).agg(F.max_by(F.struct("ts", "event_id", "status", "pages_processed"), F.struct("ts", "event_id")).alias("s"))
    return last.select(D, "s.event_id", "s.status", "s.pages_processed")


def lookup_status(asked: DataFrame, job: DataFrame, memory: DataFrame, manifests: DataFrame) -> DataFrame:
    """Status from the job state, else the in-memory state, else the manifest, else not_found."""
    a = asked.select(D).distinct()
    j = a.join(job.select(D, F.col("status").alias("_j")), D, "left").join(memory.select(D, F.col("status").alias("_m")), D, "left").join(manifests.select(D, "failed_pages"), D, "left")
    made = F.when(F.col("failed_pages").isNotNull(), F.when(F.col("failed_pages") == 0, "completed").otherwise("completed_with_errors"))
    return j.select(D, F.coalesce("_j", "_m", made, F.lit("not_found")).alias("status"), F.when(F.col("_j").isNotNull(), "job").when(F.col("_m").isNotNull(), "memory").when(made.isNotNull(), "manifest").otherwise("none").alias("found_in"))


def performance(timings: DataFrame) -> DataFrame:
    """Milliseconds by stage, and a page's mean (timings: document_id, stage, ms, pages)."""
    t = timings.groupBy(D, "stage").agg(F.round(F.sum("ms"), 2).alias("total_ms"), F.max("pages").alias("_p"))
    return t.select(D, "stage", "total_ms", F.round(F.col("total_ms") / F.greatest(F.lit(1), F.col("_p")), 2).alias("average_page_ms"))


def _summary() -> Column:
    return F.struct("page_count", "processed_pages", "failed_pages", F.col("chapters").alias("chapters_count"), F.col("sections").alias("sections_count"), F.col("chunks").alias("chunks_count"))


def _header() -> list[Column]:
    return [F.lit("TOON_V1").alias("format"), F.col(D), F.concat(F.col(D), F.lit(".pdf")).alias("filename"), F.lit("0.1.0").alias("pipeline_version"), _summary().alias("summary")]


def toon_header(manifests: DataFrame) -> DataFrame:
    """document_id and the part of its payload before the structure: what validation reads."""
    return manifests.select(D, F.to_json(F.struct(*_header())).alias("toon"))


def toon_payload(manifests: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """document_id, filename and the document as one JSON text: summary, structure, chunks and pages."""
    ss = sections.groupBy(D, "chapter_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section_id", "title", "page_start", "page_end"))).alias("sections"))
    cs = chapters.join(ss, [D, "chapter_id"], "left").groupBy(D).agg(F.array_sort(F.collect_list(F.struct("chapter_no", "chapter_id", "number", "title", "page_start", "page_end", "sections"))).alias("chapters_"))
    ks = chunks.groupBy(D).agg(F.array_sort(F.collect_list(F.struct("chapter_id", "chunk_no", "chunk_id", "section_id", "page_start", "page_end", "token_count", "text"))).alias("chunks_"))
    ps = regions.groupBy(D, "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "region_id", "type", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "confidence"))).alias("regions"))
    ps = ps.groupBy(D).agg(F.array_sort(F.collect_list(F.struct("page_number", "regions"))).alias("pages_"))
    j = manifests.join(cs, D, "left").join(ks, D, "left").join(ps, D, "left")
    body = F.struct(*_header(), F.struct(F.col("chapters_").alias("chapters")).alias("structure"), F.col("chunks_").alias("chunks"), F.col("pages_").alias("pages"))
    return j.select(D, F.to_json(body).alias("toon"))


def toon_lines(manifests: DataFrame, chapters: DataFrame, sections: DataFrame, chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """toon_payload by lines: document_id, part, place, line. A document's lines in (part, place) order are one JSON text; none holds more than a chapter's sections, a chunk or a page.

    The first chapter, chunk and page have no comma before them.
    """
    place = lambda name, no: F.struct(name.cast("string").alias("name"), no.cast("long").alias("no")).alias("place")
    none, zero = F.lit(""), F.lit(0)
    of = lambda df, part, at, *fields: df.select(D, F.lit(part).alias("part"), at, F.to_json(F.struct(*fields)).alias("line"))
    ss = sections.groupBy(D, "chapter_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section_id", "title", "page_start", "page_end"))).alias("sections"))
    cs = of(chapters.join(ss, [D, "chapter_id"], "left"), 1, place(none, F.col("chapter_no")), "chapter_no", "chapter_id", "number", "title", "page_start", "page_end", "sections")
    ks = of(chunks, 3, place(F.coalesce("chapter_id", none), F.col("chunk_no")), "chapter_id", "chunk_no", "chunk_id", "section_id", "page_start", "page_end", "token_count", "text")
    ps = regions.groupBy(D, "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "region_id", "type", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "confidence"))).alias("regions"))
    rows = cs.unionByName(ks).unionByName(of(ps, 5, place(none, F.col("page_number")), "page_number", "regions"))
    firsts = rows.groupBy(D, "part").agg(F.min("place").alias("_first"))
    rows = rows.join(firsts, [D, "part"]).select(D, "part", "place", F.when(F.col("place") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line"))).alias("line"))
    head = F.to_json(F.struct(*_header()))
    head = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"structure":{"chapters":['))
    frame = F.array(*[F.struct(F.lit(part).alias("part"), place(none, zero), line.alias("line")) for part, line in ((0, head), (2, F.lit(']},"chunks":[')), (4, F.lit('],"pages":[')), (6, F.lit("]}")))])
    return rows.unionByName(manifests.select(D, F.inline(frame)))


def validate_toon(toons: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether each payload names its document and its summary equals the manifest's counts."""
    kind = "format string, document_id string, summary struct<page_count:bigint,chapters_count:bigint,sections_count:bigint,chunks_count:bigint>"
    t = toons.select(D, F.from_json("toon", kind).alias("t"))
    j = t.join(manifests, D, "left")
    s = F.col("t.summary")
    valid = (F.col("t.document_id") == F.col(D)) & (s["page_count"] == F.col("page_count")) & (s["chapters_count"] == F.col("chapters")) & (s["sections_count"] == F.col("sections")) & (s["chunks_count"] == F.col("chunks"))
    return j.select(D, F.coalesce(valid, F.lit(False)).alias("valid"), s["page_count"].alias("pages"), s["chapters_count"].alias("chapters"), s["sections_count"].alias("sections"), s["chunks_count"].alias("chunks"))
