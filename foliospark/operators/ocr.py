"""Blocks, words and pages from the line boxes of scanned pages, with and without a recogniser's predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import strip, tokens
from .layout import PAGE

BASELINE_FONT, RECOGNISER_FONT = "BaselineOCRFont", "CRNN_OCR"
BASELINE_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.85, 0.90


def numbered_lines(boxes: DataFrame) -> DataFrame:
    """Boxes (page, x, y, w, h) large enough for a line, numbered from 1 in (y, x) order on their page."""
    order = Window.partitionBy(*PAGE).orderBy("y", "x", "w", "h")
    return boxes.where("w > 10 and h > 6").withColumn("line_no", F.row_number().over(order).cast("long"))


def _box(x: Column, y: Column, w: Column, h: Column, fx: Column, fy: Column) -> list[Column]:
    return [F.round(x * fx, 2).alias("x0"), F.round(y * fy, 2).alias("y0"), F.round((x + w) * fx, 2).alias("x1"), F.round((y + h) * fy, 2).alias("y1")]


def _size(h: Column, fy: Column) -> Column:
    return F.round(h * fy * 0.75, 2)


def baseline_blocks(lines: DataFrame, factor_x: float, factor_y: float) -> DataFrame:
    """A placeholder block for each numbered line."""
    fx, fy = F.lit(factor_x), F.lit(factor_y)
    text = F.concat(F.lit("[Scanned text line "), F.col("line_no").cast("string"), F.lit("]"))
    return lines.select(
        *PAGE, "line_no", text.alias("text"), *_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), fx, fy), _size(F.col("h"), fy).alias("avg_font_size"),
        F.lit(BASELINE_FONT).alias("fontname"), F.size(tokens(text)).cast("long").alias("word_count"), F.lit(BASELINE_CONFIDENCE).alias("confidence"),
    )


def baseline_words(lines: DataFrame, word_boxes: DataFrame, factor_x: float, factor_y: float) -> DataFrame:
    """Word boxes (page, line_no, wx, wy, ww, wh within their line) wider than 4, numbered by wx, on the page."""
    fx, fy = F.lit(factor_x), F.lit(factor_y)
    j = word_boxes.where("ww > 4").join(lines.select(*PAGE, "line_no", "x", "y"), [*PAGE, "line_no"])
    no = F.row_number().over(Window.partitionBy(*PAGE, "line_no").orderBy("wx", "wy", "ww", "wh")).cast("long")
    box = _box(F.col("x") + F.col("wx"), F.col("y") + F.col("wy"), F.col("ww"), F.col("wh"), fx, fy)
    return j.select(*PAGE, "line_no", no.alias("word_no"), F.concat(F.lit("word_"), no.cast("string")).alias("text"), *box, F.lit(BASELINE_FONT).alias("fontname"), _size(F.col("wh"), fy).alias("size"))


def recognised_blocks(lines: DataFrame, predictions: DataFrame, factor_x: float, factor_y: float) -> DataFrame:
    """Numbered lines with their predictions (page, line_no, text, confidence); a blank text is numbered as its line."""
    fx, fy = F.lit(factor_x), F.lit(factor_y)
    said = strip(F.col("said"))
    j = lines.join(predictions.select(*PAGE, "line_no", F.col("text").alias("said"), "confidence"), [*PAGE, "line_no"])
    return j.select(
        *PAGE, "line_no", F.when(said != "", said).otherwise(F.concat(F.lit("[Line "), F.col("line_no").cast("string"), F.lit("]"))).alias("text"),
        *_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), fx, fy), _size(F.col("h"), fy).alias("avg_font_size"), F.lit(RECOGNISER_FONT).alias("fontname"),
        F.size(tokens(said)).cast("long").alias("word_count"), "confidence",
    )


def ocr_pages(pages: DataFrame, blocks: DataFrame, method: str) -> DataFrame:
    """Each page's method, mean confidence (1 without lines, where a recogniser looked) and text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    mean = F.coalesce(rounded(F.avg("confidence"), 4), F.lit(UNKNOWN_CONFIDENCE)) if method == "cnn_ocr" else F.lit(BASELINE_CONFIDENCE)
    b = blocks.groupBy(*PAGE).agg(mean.alias("_c"), text.alias("_t"), F.count("*").alias("_n"))
    none = F.lit(1.0 if method == "cnn_ocr" else BASELINE_CONFIDENCE)
    return pages.select(*PAGE).join(b, PAGE, "left").select(*PAGE, F.lit(method).alias("method"), F.coalesce("_c", none).alias("confidence"), F.coalesce("_t", F.lit("")).alias("raw_text"), F.coalesce("_n", F.lit(0)).cast("long").alias("detected_regions"))


def dispatch(pages: DataFrame, model_loaded: bool, backend: str = "baseline") -> DataFrame:
    """Pages (kind: what was handed over) with the method that reads them, or the error of one that is no image."""
    image = F.col("kind") == "image"
    method = "cnn_ocr" if model_loaded and backend == "cnn_ocr" else "baseline_ocr"
    return pages.select("*", F.when(image, method).alias("method"), F.when(~image, F.concat(F.lit("an image array is expected, not "), "kind")).alias("error"))
