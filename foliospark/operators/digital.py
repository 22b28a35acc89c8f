"""The parts of a digital page (words, characters, tables, images) put inside the page and rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp_box


def _boxed(df: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    box = clamp_box(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names], F.col("width").cast("double"), F.col("height").cast("double"))
    return df.withColumns(dict(zip(names, box, strict=True)))


def _some(size: Column) -> Column:
    """A size to two places; zero counts as none."""
    return F.when(size != 0, F.round(size.cast("double"), 2))


def page_words(words: DataFrame) -> DataFrame:
    """Words or characters with text, x0, top, x1, bottom, size, and the width and height of their page."""
    return _boxed(words, ("x0", "top", "x1", "bottom")).withColumns({"text": F.coalesce("text", F.lit("")), "size": _some(F.col("size"))})


def page_tables(tables: DataFrame) -> DataFrame:
    """Tables with data (rows of cells): the box, how many rows, and the first row's cells."""
    t = _boxed(tables, ("x0", "y0", "x1", "y1"))
    rows = F.coalesce(F.size("data"), F.lit(0))
    return t.withColumns({"rows": F.greatest(F.lit(0), rows).cast("long"), "cols": F.when(rows > 0, F.size(F.get("data", F.lit(0)))).otherwise(0).cast("long")})


def page_images(images: DataFrame) -> DataFrame:
    """Images with their box and its extent."""
    i = _boxed(images, ("x0", "top", "x1", "bottom"))
    extent = lambda a, b: F.round(F.greatest(F.lit(0.0), F.col(b) - F.col(a)), 2)
    return i.withColumns({"image_width": extent("x0", "x1"), "image_height": extent("top", "bottom")})


def page_counts(words: DataFrame, tables: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """How many words, tables and images each page has."""
    kinds = [df.select(*keys, F.lit(k).alias("_k")) for k, df in (("word", words), ("table", tables), ("image", images))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy(*keys).agg(*[F.count_if(F.col("_k") == k).alias(f"{k}_count") for k in ("word", "table", "image")])
