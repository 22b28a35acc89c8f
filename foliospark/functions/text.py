"""Column expressions over text. Built-in functions, but for the places of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .numbers import rounded

#: Patterns of the document model.
PAGE_NUMBER = r"(?i)^(?:page\s*)?(\d+|[ivxlcdm]+)(?:\s*(?:of|/|-)\s*\d+)?$"
CAPTION = r"(?i)^(?:figure|fig\.|table|chart|diagram)\s*\d+[\.:]"
EQUATION = r"(\b[a-zA-Z]\s*=\s*[\w\d\+\-\*/\(\)]+|\(\d+\.\d+\)|\bint\b|\bsum\b)"
CHAPTER = r"(?i)^(?:c\s*h\s*a\s*p\s*t\s*e\s*r|p\s*a\s*r\s*t)\s*(\d+|[ivxlcdm]+)(?:[\.:\s-]+(.*))?$"
NUMBERED = r"^(\d+)\s+([A-Z][A-Za-z0-9\s,\.:\-_/]+)$"
SECTION = r"^(\d+\s*\.\s*\d+(?:\s*\.\s*\d+)?)\s*(.*)$"
LONG_LINE = 120


#: White space of Unicode, as a character class.
SPACE_KIND = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """c without white space at its ends."""
    return F.trim(c, F.lit(SPACES))


def tokens(c: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(c, f"[{SPACE_KIND}]+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    """How many tokens there are. Between the ends no part of a split is empty; F.regexp_count takes several times as long."""
    inner = strip(c)
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, f"[{SPACE_KIND}]+"))).cast("long")


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 16))


def roman_value(c: Column) -> Column:
    """Digits as they are; else roman letters: each counts minus where a larger one follows; other letters count 0; at least 1."""
    letters = F.split(F.lower(strip(c)), "")
    values = F.transform(F.filter(letters, lambda x: x != ""), lambda x: F.coalesce(F.when(x == "i", 1).when(x == "v", 5).when(x == "x", 10).when(x == "l", 50).when(x == "c", 100).when(x == "d", 500).when(x == "m", 1000), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("after"))
    total = F.aggregate(F.reverse(values), start, lambda acc, v: F.struct((acc["total"] + F.when(v >= acc["after"], v).otherwise(-v)).alias("total"), v.alias("after")))["total"]
    return F.when(strip(c).rlike(r"^\d+$"), strip(c).cast("int")).otherwise(F.when(total > 0, total).otherwise(1))


def character_counts(text: Column) -> dict[str, Column]:
    """Characters of a text, those left when one kind is removed by runs, and words. To be columns of their own before quality_features reads them."""
    left = lambda kind: F.length(F.regexp_replace(text, f"[{kind}]+", ""))
    return {
        "_n": F.length(text),
        "_unprintable": left(r"\x20-\x7E\t\n\r\x0B\x0C"),
        "_ungarbled": left(r"\x00-\x08\x0B\x0C\x0E-\x1F\uFFFD"),
        "_solid": left(SPACE_KIND),
        "_words": token_count(text),
    }


def quality_features(images: Column) -> dict[str, Column]:
    """Text-layer quality of a page from its character_counts: counts, ratios (rounded to 3 places) and the score."""
    n, words = F.col("_n"), F.col("_words")
    size = n.cast("double")
    printable, garbage, blank = (n - F.col("_unprintable")) / size, (n - F.col("_ungarbled")) / size, (n - F.col("_solid")) / size
    mean = F.when(words > 0, F.col("_solid") / words).otherwise(0.0)
    score = (
        F.lit(1.0)
        - F.when(printable < 0.95, (F.lit(0.95) - printable) * 2).otherwise(0.0)
        - F.when(garbage > 0.01, F.least(F.lit(1.0), garbage * 10)).otherwise(0.0)
        - F.when((mean < 2.2) | (mean > 25), 0.35).otherwise(0.0)
        - F.when((n < 150) & (images > 0), 0.30).otherwise(0.0)
        - F.when((blank > 0.40) | ((n > 50) & (blank < 0.05)), 0.25).otherwise(0.0)
    )
    some = n > 0
    return {
        "text_character_count": n.cast("long"),
        "word_count": words.cast("long"),
        "printable_ratio": F.when(some, rounded(printable, 3)).otherwise(0.0),
        "whitespace_ratio": F.when(some, rounded(blank, 3)).otherwise(0.0),
        "garbage_ratio": F.when(some, rounded(garbage, 3)).otherwise(1.0),
        "text_quality_score": F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rounded(score, 3)))).otherwise(0.0),
    }


def table_text(data: Column) -> Column:
    """Cells joined by ' | ', rows by newlines; null cells are empty, empty rows left out; without text '[Table]'."""
    rows = F.transform(F.filter(data, lambda r: F.size(r) > 0), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "))
    joined = F.array_join(rows, "\n")
    return F.when(joined != "", joined).otherwise("[Table]")


def _starts(toks: pa.Array) -> pa.Array:
    """For each list of tokens the places of their first characters in the list joined by one space; none for a null list."""
    values = pc.fill_null(toks.values, "")
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    offsets = toks.offsets.to_numpy()
    at = np.zeros(len(values), np.int32)
    at[offsets[0] : offsets[-1]] = ends[offsets[0] : offsets[-1]] - np.repeat(ends[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(toks.offsets, pa.array(at))


def _starts_of_each(lists: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(lists.offsets, _starts(lists.values))


def starts(toks: Column) -> Column:
    """For each token its first character's place in the tokens joined by one space. In Arrow: a fold that carries an array copies it with every token."""
    return F.arrow_udf(_starts, ArrayType(IntegerType()))(toks)


def starts_of_each(lists: Column) -> Column:
    """starts for an array of token arrays."""
    return F.arrow_udf(_starts_of_each, ArrayType(ArrayType(IntegerType())))(lists)
