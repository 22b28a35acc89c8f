"""SimHash fingerprints and the search within a Hamming radius.

Terms are pairs of neighbouring words (a first word pairs with nothing before it), hashed to 64 bits, and weigh the square of
their length, up to 256: long words are rare. Each term votes with its weight on every bit; a bit is set if more than half
of the weight votes for it. Votes are summed two to a long (32 bits each), so a text may hold 2**31 / 256 terms.

A text without words has fingerprint 0. Equal texts have equal fingerprints.

`search` finds all fingerprints within radius r exactly: the bits are cut into r + 3 blocks; a pair within r differs in at most r
blocks, so some 3 blocks agree; one table for each choice of 3 blocks is joined on the chosen blocks and verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, shuffle_partitions

PAIR_MASK = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Array of struct(b: word, a: the word before it)."""
    words = F.split(text, SPACE)
    return F.arrays_zip(words.alias("b"), F.concat(F.array(F.lit("")), F.slice(words, 1, F.size(words) - 1)).alias("a"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fp (long) of each row. keys must tell rows apart; no exchange is added if texts is dealt by some of them."""
    t = texts.select(*keys, F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    a, b = F.col("t")["a"], F.col("t")["b"]
    size = F.least(F.lit(16), F.length(a) + F.length(b))
    t = t.select(*keys, F.xxhash64(a, b).alias("h"), F.when(F.length(b) == 0, 0).otherwise(size * size).cast("long").alias("w"))
    lanes = [F.sum(F.col("w") * F.shiftrightunsigned("h", i).bitwiseAND(F.lit(PAIR_MASK))).alias(f"l{i}") for i in range(32)]
    v = t.groupBy(*keys).agg(F.sum("w").alias("total"), *lanes)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"l{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"l{i}", 32)
        fp = fp.bitwiseOR(F.shiftleft((2 * low > F.col("total")).cast("long"), i)).bitwiseOR(F.shiftleft((2 * high > F.col("total")).cast("long"), i + 32))
    return v.select(*keys, fp.alias("fp"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _range_bucket(x: Column, bounds: list) -> Column:
    """Index of the last bound <= x (bounds[0] <= every x), by binary search."""
    steps = [1 << k for k in range((len(bounds) - 1).bit_length() - 1, -1, -1)] or [0]
    held = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s < len(bounds)) & (F.get(held, lo + s) <= x), lo + s).otherwise(lo))


def next_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in ascending id order, dealt by ranges of the id, each with the text of the next (after the last: the first).

    Columns: _b (range), _n (order in it), _own (false: a copy of the next range's first row, kept to look ahead), doc_id, text, next_text.
    Whole-number ids are in their own order, others in that of their text. Ranges start at ids that occur: approximate percentiles, or, of
    texts, the ids that are least by a hash. Rows of one id share a range. The first row of a range is also sent to the range before. Null ids
    come first; equal ids are ordered by a hash of their text; null text counts as empty. Empty in, empty out.
    """
    spark = docs.sparkSession
    parts = max(1, min(4096, 4 * shuffle_partitions(spark)))
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    o = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))) if whole else F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.select(o.alias("_o"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = F.percentile_approx("_o", [i / parts for i in range(parts)], 20 * parts) if whole else F.lit(None)
    lo, inner = d.agg(F.min("_o"), marks).first()
    if not whole:
        inner = [r["_o"] for r in d.select("_o").distinct().orderBy(F.xxhash64("_o"), "_o").limit(parts).collect()]
    bounds = sorted({lo, *(inner or [])}) if lo is not None else [0 if whole else ""]
    d = d.withColumn("_k", _range_bucket(F.col("_o"), bounds))
    starts = F.get(F.lit(bounds), F.col("_k")) == F.col("_o")
    here = F.struct(F.col("_k").alias("_b"), F.lit(0).alias("_late"))
    ahead = F.struct(F.when(F.col("_k") == 0, len(bounds) - 1).otherwise(F.col("_k") - 1).alias("_b"), F.lit(1).alias("_late"))
    d = d.withColumn("_p", F.explode(F.when(starts, F.array(here, ahead)).otherwise(F.array(here)))).select("_p.*", "_o", "doc_id", "text")
    w = Window.partitionBy("_b").orderBy("_late", "_o", "_x")
    d = d.withColumn("_x", F.xxhash64("text"))
    return d.select("_b", F.row_number().over(w).alias("_n"), (F.col("_late") == 0).alias("_own"), "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter is replaced by the start of the next document's."""
    d = next_document(docs, id_col, text_col)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), k))
    d = d.select("_b", "_n", "_own", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    d = d.withColumn("edited_sha256", F.when(F.col("_own"), F.sha2(F.encode("edited", "UTF-8"), 256)))
    both = F.when(F.col("_own"), F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("s")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("s")))).otherwise(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("s"))))
    keys = ["_b", "_n", "_own", "doc_id", "n_chars", "edited_sha256"]
    fps = fingerprints(d.select(*keys, F.explode(both).alias("_e")).select(*keys, "_e.v", "_e.s"), [*keys, "v"], "s")
    one = fps.groupBy(*keys).agg(F.max(F.when(F.col("v") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("v") == 1, F.col("fp"))).alias("efp"))
    one = one.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("_b").orderBy("_n"))).where("_own")
    return one.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def block_tables(fps: DataFrame, radius: int, id_col: str) -> DataFrame:
    """One row for each table: id, fp, table, key (the chosen blocks, the others 0)."""
    blocks = radius + 3
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), 3):
        m = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select(id_col, "fp", F.explode(keys).alias("_k")).select(id_col, "fp", "_k.table", "_k.key")


def search(queries: DataFrame, corpus: DataFrame, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    """For each query (id, fp): the distinct corpus fingerprints within radius, and how many corpus rows hold each. Exact.

    Equal fingerprints count once on both sides, so large groups of copies do not multiply; a hot key is split by AQE's skew join.
    Null fingerprints match nothing.
    """
    held = corpus.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.count("*").alias("n_rows"))
    asked = queries.where(F.col("fp").isNotNull()).select(F.col("fp")).distinct()
    left = block_tables(asked.withColumn("_q", F.col("fp")), radius, "_q").select("_q", "table", "key")
    right = block_tables(held, radius, "n_rows").select("fp", "n_rows", "table", "key")
    hits = left.join(right, ["table", "key"]).where(F.bit_count(F.col("_q").bitwiseXOR(F.col("fp"))) <= radius).select("_q", "fp", "n_rows").distinct()
    return queries.select(F.col(id_col), F.col("fp").alias("_q")).join(hits, "_q").select(id_col, F.col("fp").alias("near_fp"), F.bit_count(F.col("_q").bitwiseXOR(F.col("fp"))).alias("distance"), "n_rows")
