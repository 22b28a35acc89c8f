"""Lines from words, regions from blocks, tables and images, and their reading order. All per page."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.geometry import clamp_box
from ..functions.numbers import rounded
from ..functions.text import CAPTION, EQUATION, PAGE_NUMBER, starts, strip, table_text, tokens

PAGE = ["document_id", "page_number"]
FURNITURE = ("HEADER", "FOOTER", "PAGE_NUMBER")
LINE_TOLERANCE = 3.5


def gathered(words: DataFrame) -> DataFrame:
    """One row a page: its words."""
    return words.groupBy(*PAGE).agg(F.collect_list(F.struct(*[c for c in words.columns if c not in PAGE])).alias("words"))


def cluster_pages(pages: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Pages with the number of its visual line in each of their words: sorted by (top, x0), a word opens a line unless it is within tolerance of the line's first word.

    As tops ascend, a word's line follows from its top alone: the fold runs over a page's distinct tops (in Arrow), and words look theirs up. A page's
    words stay in its row, which bounds them.
    """

    def lines(tops: pa.Array) -> pa.Array:
        values, offsets = tops.values, tops.offsets.to_numpy()
        top, number = values.to_numpy(zero_copy_only=False), np.zeros(len(values), np.int32)
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            distinct, of = np.unique(top[lo:hi], return_inverse=True)
            anchor, n, at = -1e9, 0, []
            for t in distinct.tolist():
                if t - anchor > tolerance:
                    anchor, n = t, n + 1
                at.append(n)
            number[lo:hi] = np.array(at, np.int32)[of]
        return pa.ListArray.from_arrays(tops.offsets, pa.array(number, mask=values.is_null().to_numpy(zero_copy_only=False)))

    fields = pages.schema["words"].dataType.elementType.names
    made = F.arrow_udf(lines, ArrayType(IntegerType()))(F.transform("words", lambda x: x["top"].cast("double")))
    word = lambda x: F.struct(*[x["w"][c].alias(c) for c in fields], x["n"].alias("line_no"))
    return pages.select(*PAGE, "words", made.alias("_no")).select(*PAGE, F.transform(F.arrays_zip(F.col("words").alias("w"), F.col("_no").alias("n")), word).alias("words"))


def cluster_lines(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """cluster_pages for words that come one a row."""
    return cluster_pages(gathered(words), tolerance).select(*PAGE, F.inline("words"))


def _line_block(lines: DataFrame) -> DataFrame:
    """One block a line (PAGE, line_no, ws: its words, sorted by x0, top, word_ordinal): words joined by x0, outer box, mean of the sizes that are set (else 10), the first word's font."""
    of = lambda c: F.transform("ws", lambda x: x[c])
    sized = F.filter(of("size"), lambda v: v > 0)
    mean = F.when(F.size(sized) > 0, F.aggregate(sized, F.lit(0.0), lambda a, v: a + v) / F.size(sized)).otherwise(10.0)
    return lines.select(
        *PAGE, "line_no", F.array_join(of("text"), " ").alias("text"), F.round(F.array_min(of("x0")), 2).alias("x0"), F.round(F.array_min(of("top")), 2).alias("y0"), F.round(F.array_max(of("x1")), 2).alias("x1"), F.round(F.array_max(of("bottom")), 2).alias("y1"),
        F.round(mean, 2).alias("avg_font_size"), F.get("ws", F.lit(0))["fontname"].alias("fontname"), F.size("ws").cast("long").alias("word_count"),
    )


def _of_line(x: Callable[[str], Column]) -> list[Column]:
    """A word's fields for _line_block, those of its order first."""
    return [x("x0").alias("x0"), x("top").alias("top"), x("word_ordinal").alias("word_ordinal"), x("text").alias("text"), F.coalesce(x("fontname"), F.lit("Unknown")).alias("fontname"), x("x1").alias("x1"), x("bottom").alias("bottom"), x("size").cast("double").alias("size")]


def line_blocks(words: DataFrame) -> DataFrame:
    """The blocks of words that come one a row, with line_no."""
    return _line_block(words.groupBy(*PAGE, "line_no").agg(F.sort_array(F.collect_list(F.struct(*_of_line(F.col)))).alias("ws")))


def page_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of pages from cluster_pages: words are sorted by line, and each line is a slice of them."""
    p = pages.select(*PAGE, F.sort_array(F.transform("words", lambda x: F.struct(x["line_no"].alias("line_no"), *_of_line(lambda c: x[c])))).alias("_w"))
    p = p.select(*PAGE, "_w", F.transform("_w", lambda x: x["line_no"]).alias("_no"))
    firsts = F.transform(F.sequence(F.lit(1), F.element_at("_no", -1)), lambda n: F.array_position("_no", n).cast("int"))
    p = p.where(F.size("_no") > 0).select(*PAGE, "_w", firsts.alias("_at"))
    end = lambda i: F.coalesce(F.get("_at", i + 1), F.size("_w") + 1)
    return _line_block(p.select(*PAGE, F.inline(F.transform("_at", lambda a, i: F.struct((i + 1).alias("line_no"), F.slice("_w", a, end(i) - a).alias("ws"))))))


def _upper_median(sizes: Column) -> Column:
    """Upper median of the positive sizes, 10 without any. sizes: aggregates or a window over them."""
    s = F.array_sort(sizes)
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(10.0))


def _positive() -> Column:
    return F.when(F.col("avg_font_size") > 0, F.col("avg_font_size"))


def median_font(blocks: DataFrame) -> DataFrame:
    """Upper median of a page's positive sizes, 10 without any."""
    return blocks.groupBy(*PAGE).agg(_upper_median(F.collect_list(_positive())).alias("median_font_size"))


def region_type(text: Column, y0: Column, y1: Column, height: Column, font: Column, median: Column) -> Column:
    t = strip(text)
    number = t.rlike(PAGE_NUMBER) & (F.length(t) < 12)
    equation = (F.length(t) < 80) & t.rlike(EQUATION) & t.contains("(") & t.contains(")") & (t.contains("=") | t.contains("+"))
    return (
        F.when(y0 < height * 0.08, F.when(number, "PAGE_NUMBER").otherwise("HEADER"))
        .when(y1 > height * 0.92, F.when(number, "PAGE_NUMBER").otherwise("FOOTER"))
        .when(t.rlike(CAPTION), "CAPTION")
        .when(font >= median * 1.5, "HEADING")
        .when(font >= median * 1.25, "SUBHEADING")
        .when(equation, "EQUATION")
        .otherwise("BODY")
    )


def outside_tables(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Boxes whose centre is in no table of their page (an anti join on the page)."""
    t = tables.select(F.col("document_id").alias("_d"), F.col("page_number").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("document_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")) & cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))
    return boxes.join(t, inside, "left_anti")


def classify_blocks(blocks: DataFrame, height: float = 792.0) -> DataFrame:
    """Blocks that are not blank, with their region type."""
    m = blocks.withColumn("median_font_size", _upper_median(F.collect_list(_positive()).over(Window.partitionBy(*PAGE))))
    return m.where(strip(F.col("text")) != "").withColumn("type", region_type(F.col("text"), F.col("y0"), F.col("y1"), F.lit(height), F.col("avg_font_size"), F.col("median_font_size")))


def detect_regions(blocks: DataFrame, tables: DataFrame, images: DataFrame, height: float = 792.0) -> DataFrame:
    """Tables, then blocks outside tables, then images outside tables, numbered in that order on each page."""
    box = ("x0", "y0", "x1", "y1")
    shape = lambda kind, o, t, text, conf, font: [*PAGE, F.lit(kind).alias("kind"), o.cast("long").alias("ord"), t.alias("type"), text.alias("text"), *box, F.lit(conf).alias("confidence"), font.cast("double").alias("font_size")]
    none = F.lit(None)
    ts = tables.select(*shape(0, F.col("y0"), F.lit("TABLE"), table_text(F.col("data")), 0.98, none))
    bs = outside_tables(classify_blocks(blocks, height), tables).select(*shape(1, F.col("ord"), F.col("type"), strip(F.col("text")), 0.95, F.col("avg_font_size")))
    fs = outside_tables(images, tables).select(*shape(2, F.col("y0"), F.lit("FIGURE"), F.lit("[Figure Image]"), 0.90, none))
    w = Window.partitionBy(*PAGE).orderBy("kind", "ord")
    r = ts.unionByName(bs).unionByName(fs).withColumn("region_no", F.row_number().over(w).cast("long"))
    return r.select(*PAGE, "region_no", F.format_string("r%03d", "region_no").alias("region_id"), "type", "text", *box, "confidence", "font_size")


def reading_order(regions: DataFrame, width: float = 612.0, height: float = 792.0, strict: bool = True) -> DataFrame:
    """Regions with reading_order from 1 on each page: header zone, body, footer zone.

    A body with regions of up to 0.65 of the width on either side of the middle has two columns: wide regions cut it into bands, and each
    band is read left column first. strict leaves out column regions that start beside a wide one (between its top and bottom); otherwise
    they go to the band after it.
    """
    t, y0, y1, x0, x1 = (F.col(c) for c in ("type", "y0", "y1", "x0", "x1"))
    zone = F.when(t.isin("HEADER", "PAGE_NUMBER") & (y0 < 0.15 * height), 0).when(t.isin("FOOTER", "PAGE_NUMBER") & (y1 > 0.85 * height), 2).otherwise(1)
    narrow, centre = (x1 - x0) <= width * 0.65, (x0 + x1) / 2
    r = regions.withColumn("zone", zone)
    page = Window.partitionBy(*PAGE)
    body = F.col("zone") == 1
    two = (F.max((body & narrow & (centre < width / 2 - width * 0.05)).cast("int")).over(page) == 1) & (F.max((body & narrow & (centre > width / 2 + width * 0.05)).cast("int")).over(page) == 1)
    r = r.withColumn("two", two & body)
    r = r.withColumn("kind", F.when(~F.col("two"), 0).when(~narrow, 2).when(centre < width / 2, 0).otherwise(1))
    spans = F.array_sort(F.collect_list(F.when(F.col("two") & (F.col("kind") == 2), F.struct("y0", "x0", "region_no", "y1"))).over(page))
    r = r.withColumn("spans", spans)
    # The band of a column region: the first wide region that starts below it, if the one before ends above it.
    above = F.size(F.filter("spans", lambda s: s["y0"] <= F.col("y0")))
    before_ends = F.coalesce(F.get("spans", above - 1)["y1"], F.lit(0.0))
    own = F.array_position(F.transform("spans", lambda s: s["region_no"]), F.col("region_no")).cast("int") - 1
    r = r.withColumn("band", F.when(~F.col("two"), 0).when(F.col("kind") == 2, own).otherwise(above))
    if strict:
        r = r.where(~F.col("two") | (F.col("kind") == 2) | (F.col("y0") >= before_ends))
    order = Window.partitionBy(*PAGE).orderBy("zone", "band", "kind", "y0", "x0", "region_no")
    return r.select(*[c for c in regions.columns], F.row_number().over(order).cast("long").alias("reading_order"))


def normalize(regions: DataFrame, width: float = 612.0, height: float = 792.0, source: str = "pdfplumber") -> DataFrame:
    """Boxes clamped to the page, and provenance rebuilt from the clamped box."""
    box = clamp_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(width), F.lit(height))
    r = regions.withColumns(dict(zip(("x0", "y0", "x1", "y1"), box, strict=True)))
    p = F.struct("document_id", "page_number", "region_id", F.array("x0", "y0", "x1", "y1").alias("bbox"), F.lit(source).alias("source"), F.lit(source).alias("extraction_method"), "confidence")
    return r.withColumn("provenance", p)


def word_boxes(lines: DataFrame) -> DataFrame:
    """Approximate boxes of a line's words: the line's width shared by character, one for each space."""
    toks = tokens(F.col("text"))
    unit = (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length(strip(F.col("text"))))
    w = lines.select(*PAGE, "ord", "x0", "y0", "y1", unit.alias("unit"), toks.alias("word"))
    w = w.select(*PAGE, "ord", "x0", "y0", "y1", "unit", F.posexplode(F.arrays_zip("word", starts(F.col("word")).alias("at"))).alias("i", "w")).select(*PAGE, "ord", "x0", "y0", "y1", "unit", "i", "w.*")
    unit, at = F.col("unit"), F.col("at")
    return w.where("word <> ''").select(*PAGE, "ord", F.col("i").cast("long").alias("i"), "word", rounded(F.col("x0") + unit * at, 2).alias("x0"), rounded(F.col("x0") + unit * (at + F.length("word")), 2).alias("x1"), "y0", "y1")


def line_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Contour boxes (x, y, w, h) large enough for a line, padded by 2 inside the image, in (y, x) order."""
    b = boxes.where("w > 10 and h > 6")
    pad = b.select("image", "x", "y", F.greatest(F.lit(0), F.col("x") - 2).alias("px0"), F.greatest(F.lit(0), F.col("y") - 2).alias("py0"), F.least(F.lit(width), F.col("x") + F.col("w") + 2).alias("px1"), F.least(F.lit(height), F.col("y") + F.col("h") + 2).alias("py1"))
    return pad.withColumn("line_no", F.row_number().over(Window.partitionBy("image").orderBy("y", "x")).cast("long"))
