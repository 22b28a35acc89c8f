"""Page quality, routing and document profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import character_counts, quality_features

ROUTES = ("DIGITAL_TEXT", "POOR_TEXT_LAYER", "SCANNED_OR_IMAGE_ONLY")
METHODS = ("pdfplumber", "cnn_ocr", "baseline_ocr")


def route(score: Column, chars: Column, threshold: float = 0.70) -> Column:
    return F.when((chars > 0) & (score >= threshold), ROUTES[0]).when(chars > 0, ROUTES[1]).otherwise(ROUTES[2])


def page_quality(pages: DataFrame, threshold: float = 0.70) -> DataFrame:
    """One row a page: features, score and route. Null text counts as empty."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    keys = ["document_id", "page_number", "width", "height", "image_count"]
    p = pages.select(*keys, *[c.alias(n) for n, c in character_counts(text).items()])
    p = p.select(*keys, *[c.alias(n) for n, c in quality_features(F.col("image_count")).items()])
    r = route(F.col("text_quality_score"), F.col("text_character_count"), threshold)
    return p.select("*", (F.col("text_character_count") > 0).alias("text_layer_available"), r.alias("route"), (r == ROUTES[0]).alias("should_use_text_layer"))


def extraction_method(route_col: Column) -> Column:
    return F.when(route_col == ROUTES[0], METHODS[0]).when(route_col == ROUTES[1], METHODS[1]).otherwise(METHODS[2])


def _counts(quality: DataFrame, value: Column, names: tuple[str, ...]) -> DataFrame:
    return quality.groupBy("document_id").agg(*[F.count_if(value == n).alias(n.lower()) for n in names])


def routing_counts(quality: DataFrame) -> DataFrame:
    return _counts(quality, F.col("route"), ROUTES)


def extraction_counts(quality: DataFrame) -> DataFrame:
    return _counts(quality, extraction_method(F.col("route")), METHODS)


def profile(quality: DataFrame) -> DataFrame:
    """One row a document: page counts by route, pages with images, mean characters and words, distinct sizes."""
    n = F.count("*")
    return quality.groupBy("document_id").agg(
        n.alias("page_count"),
        F.count_if(F.col("route") == ROUTES[0]).alias("text_layer_pages"),
        F.count_if(F.col("route") == ROUTES[1]).alias("poor_text_pages"),
        F.count_if(F.col("route") == ROUTES[2]).alias("zero_text_pages"),
        F.count_if(F.col("image_count") > 0).alias("image_pages"),
        rounded(F.sum("text_character_count") / n, 2).alias("average_chars_per_page"),
        rounded(F.sum("word_count") / n, 2).alias("average_words_per_page"),
    )


def page_dimensions(quality: DataFrame) -> DataFrame:
    """document_id and its pages' sizes in page order."""
    d = quality.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "width", "height"))).alias("d"))
    return d.select("document_id", F.transform("d", lambda x: F.struct(x["width"].alias("width"), x["height"].alias("height"))).alias("page_dimensions"))
