"""Text recognition: greedy decoding, error rates, training history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import tokens

#: The default vocabulary, the blank first.
VOCABULARY = ["<blank>", " ", *"0123456789", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"abcdefghijklmnopqrstuvwxyz", *".,;:!?'\"()[]{}-_", *"+*/=%<>×÷±≈≠≤≥°∞√∑∫∂∇", *"αβγδεθλμπσφωΩΔ"]


def encode(text: Column, vocabulary: list[str] = VOCABULARY) -> Column:
    """Indices of the text's characters; unknown ones are left out."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    at = F.transform(chars, lambda c: F.array_position(F.lit(vocabulary), c).cast("int") - 1)
    return F.filter(at, lambda i: i >= 0)


def valid_length(width: Column) -> Column:
    """Time steps that an image of this width gives: one for 4 pixels, one at least."""
    return F.greatest(F.lit(1), F.floor(width / 4))


def zipped(refs: DataFrame, hyps: DataFrame) -> DataFrame:
    """References and predictions of the same position; what has no partner is left out."""
    return refs.join(hyps, "position")


def greedy_decode(steps: DataFrame, vocabulary: list[str] = VOCABULARY, blank: int = 0, widths: DataFrame | None = None) -> DataFrame:
    """sample, text, confidence and tokens from logits a time step: best class (lowest index of equals), repeats collapsed, blanks dropped.

    widths (sample, width of its image): time steps from valid_length on are padding and do not count.
    """
    if widths is not None:
        steps = steps.join(widths.select("sample", valid_length(F.col("width")).alias("_valid")), "sample").where(F.col("t") < F.col("_valid"))
    best = F.array_max("logits")
    p = F.lit(1.0) / F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - best.cast("double")))
    s = steps.select("sample", "t", (F.array_position("logits", best) - 1).cast("int").alias("idx"), p.alias("p"))
    before = F.lag("idx", 1, blank).over(Window.partitionBy("sample").orderBy("t"))
    s = s.withColumn("_keep", (F.col("idx") != blank) & (F.col("idx") != before))
    kept = F.array_sort(F.collect_list(F.when(F.col("_keep"), F.struct("t", "idx"))))
    d = s.groupBy("sample").agg(kept.alias("k"), F.coalesce(rounded(F.avg(F.when(F.col("_keep"), F.col("p"))), 4), F.lit(0.0)).alias("confidence"))
    letter = lambda x: F.coalesce(F.get(F.lit(vocabulary), x["idx"]), F.lit(""))
    return d.select("sample", F.array_join(F.transform("k", letter), "").alias("text"), "confidence", F.array_join(F.transform("k", lambda x: x["idx"].cast("string")), ",").alias("tokens"))


def mean_confidence(lines: DataFrame) -> DataFrame:
    """A page's confidence: the mean of its lines', 0.90 without any."""
    return lines.groupBy("document_id", "page_number").agg(F.coalesce(rounded(F.avg("confidence"), 4), F.lit(0.90)).alias("confidence"))


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays, by one row of the table at a time."""
    n = F.size(b)

    def row(prev: Column, x: Column) -> Column:
        first = F.array(prev[0] + 1)
        return F.aggregate(F.sequence(F.lit(1), n), first, lambda acc, j: F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, F.get(prev, j) + 1, F.get(prev, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1)))))

    start = F.sequence(F.lit(0), n)
    return F.when(n == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, start, row), -1))


def error_rates(pairs: DataFrame) -> DataFrame:
    """Corpus character and word error rates: all edits over all reference length, 5 places. Texts are not stripped."""
    ref, hyp = tokens(F.col("ref")), tokens(F.col("hyp"))
    p = pairs.select(F.levenshtein("ref", "hyp").alias("ce"), F.length("ref").alias("cl"), token_distance(ref, hyp).alias("we"), F.size(ref).alias("wl"))
    return p.agg(F.count("*").alias("samples"), rounded(F.sum("ce") / F.greatest(F.lit(1), F.sum("cl")), 5).alias("cer"), rounded(F.sum("we") / F.greatest(F.lit(1), F.sum("wl")), 5).alias("wer"))


def character_errors(pairs: DataFrame) -> DataFrame:
    return pairs.select("path", F.levenshtein("ref", "hyp").cast("long").alias("edits"), F.length("ref").cast("long").alias("ref_length"))


def history(epochs: DataFrame, target: float) -> DataFrame:
    """Each epoch with the best CER so far, whether it improves on it strictly, and whether training has stopped before it.

    One run's epochs (run, epoch, loss, cer, wer); training stops after the first epoch at or below target.
    """
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.min("cer").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return epochs.select("run", "epoch", "loss", "cer", "wer", F.min("cer").over(w).alias("best_cer"), F.coalesce(F.col("cer") < before, F.lit(True)).alias("is_best"), F.coalesce(before <= target, F.lit(False)).alias("stopped"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The first epoch of least CER of each run."""
    return epochs.groupBy("run").agg(F.min_by(F.struct("epoch", "cer", "wer"), F.struct("cer", "epoch")).alias("b")).select("run", "b.*")
