"""Mixing sources to target weights by pivotal dependent rounding.

A source with target t and size s repeats each of its documents t / s times: the whole part is certain, the
fraction is a copy probability. Units duel: two fractions p, q become p + q and 0 (if p + q < 1, the
winner drawn by p : q) or 1 and p + q - 1 (else), which keeps every unit's expectation and all sums. Blocks of
about FAN_IN units of one source and like size duel in turn; what stays fractional goes up a tree of hash blocks, then over the size
strata of the source, largest first, and one last unit a source is drawn.

A unit is a distinct (id, source, text): rows that repeat are counted before anything is dealt by them, so that a row repeated without
bound is one unit whose mass is its count times the rate. Block keys derive from the row's content, so reruns agree, and a
source of any size is split over many blocks.
Rows: null text has size 0 and is never taken; repeated rows share their unit's copies evenly, to within one; null is a source of its own, ordered
last; ids may be of any type that groups; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, uniform

FAN_IN = 64
#: Rows (source, size stratum) up to this many are sent to all executors; more are joined by shuffle.
BROADCAST_STRATA = 100_000
#: Equal rows made by one task.
RUN = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_key(doc_id: Column, text: Column, seed: int = 17) -> Column:
    """What tells units apart; equal for rows of the same id (as text) and text."""
    return F.xxhash64(F.lit(seed), doc_id.cast("string"), doc_id.isNull(), F.coalesce(text, F.lit("")))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size -> and target. One row a source in and out.

    Targets are in proportion to the weights and sum to share x all sizes; those above most x size stop there
    and the excess goes to the others by weight (water filling, solved by one ordered prefix sum).
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", cycle).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    s = s.withColumn("_k", F.row_number().over(order))
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_left", F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_capped")) / F.col("_left"))
    s = s.withColumn("_at", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_k", "_level"))).over(everything))
    free = F.col("_w") * F.col("_at")["_level"]
    return s.select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), free)).alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Units (array of struct h, p, ..) duel in turn. Returns struct(at, p: the unit that stays fractional; out: index and copy 0 or 1 of the others)."""
    kind = "struct<at:int,p:double,out:array<struct<at:int,copy:int>>>"
    hash_of = lambda i: F.get(units, i)["h"]

    def settle(acc: Column, x: Column) -> Column:
        p, q = acc["p"], F.get(units, x)["p"]
        u, total = uniform(F.lit(seed), F.lit(level), hash_of(acc["at"]), hash_of(x)), p + q
        small = total < 1.0
        # small: cur stays (and x is 0) with p : total. Else: cur is 1 (and x stays) with (1 - q) : (2 - total).
        stays = F.when(small, F.when(total > 0, u < p / total).otherwise(F.lit(False))).otherwise(u >= (1.0 - q) / (2.0 - total))
        gone = F.struct(F.when(stays, x).otherwise(acc["at"]).alias("at"), F.when(small, 0).otherwise(1).alias("copy"))
        return F.struct(F.when(stays, acc["at"]).otherwise(x).alias("at"), F.when(small, total).otherwise(total - 1.0).alias("p"), F.concat(acc["out"], F.array(gone)).alias("out")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), units[0]["p"].alias("p"), F.expr("cast(array() as array<struct<at:int,copy:int>>)").alias("out")).cast(kind)
    return F.aggregate(F.when(F.size(units) > 1, F.sequence(F.lit(1), F.size(units) - 1)).otherwise(F.expr("cast(array() as array<int>)")), start, settle)


def _duels(units: DataFrame, keys: list[str], order: list[Column], level: int, seed: int, n: int) -> tuple[DataFrame, DataFrame]:
    """One level: what stays fractional of each group (keys and unit), and the settled units with their copy. n: about how many units."""
    held = [c for c in units.columns if c not in keys]
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*held).alias("u")))), lambda x: x["u"])
    done = units.groupBy(*keys).agg(sorted_.alias("_u")).withColumn("_f", _fold(F.col("_u"), level, seed))
    unit = lambda i: F.get(F.col("_u"), i)
    stays = F.struct(*[(F.col("_f")["p"] if c == "p" else unit(F.col("_f")["at"])[c]).alias(c) for c in held])
    gone = F.transform(F.col("_f")["out"], lambda x: F.struct(unit(x["at"]).alias("u"), x["copy"].alias("copy")))
    done = cut(done.select(*keys, stays.alias("_cur"), gone.alias("_out")), 8 * n)  # a unit weighs as much as some eight narrow rows
    return done.select(*keys, "_cur.*"), done.select(*keys, F.inline("_out")).select(*keys, "u.*", "copy")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row a unit: doc_id, source, size, source_size, target, n_rows (rows that are this unit), copies (of all of them), unit (unit_key)."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), unit_key(F.col("doc_id"), F.col("text"), seed).alias("h"))
    rows = cut(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n")).withColumn("stratum", F.floor(F.log2(F.greatest("size", F.lit(1))) * 6).cast("int")))
    strata = cut(rows.groupBy("source", "stratum").agg(F.sum(F.col("size") * F.col("n")).alias("_size"), F.count("*").alias("_units")), 1)
    targets = source_targets(strata.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    targets = cut(targets.select(F.col("source").alias("_s"), "source_size", "target"), 1)
    found = strata.join(targets, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("stratum").alias("_t"), "source_size", "target", F.ceil(F.col("_units") / FAN_IN).alias("_blocks"))
    found = cut(found, 1)
    most_blocks, n_strata, n_units = strata.agg(F.max(F.ceil(F.col("_units") / FAN_IN)), F.count("*"), F.sum("_units")).first()
    if not n_strata:
        most_blocks = n_units = 0
    small = F.broadcast(found) if n_strata <= BROADCAST_STRATA else found  # else a shuffled join, whose skew AQE splits

    mass = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = rows.join(small, F.col("source").eqNullSafe(F.col("_s")) & (F.col("stratum") == F.col("_t"))).withColumn("_m", mass)
    whole = whole.withColumn("base", F.floor("_m").cast("long")).withColumn("p", F.col("_m") - F.floor("_m"))
    certain = (F.col("size") == 0) | (F.col("p") <= 0)
    units = whole.where(~certain).select("source", "stratum", "_blocks", "source_size", "target", "h", "p", "doc_id", "size", "n", "base")
    shown = ["doc_id", "source", "size", "source_size", "target", F.col("n").alias("n_rows")]

    settled, level, blocks, left = [], 0, most_blocks, n_units
    tree = ["source", "stratum", "_blocks", "source_size", "target"]
    while blocks:
        level += 1
        units = units.withColumn("_blk", F.pmod(F.xxhash64(F.lit(level), "h"), F.col("_blocks")))
        units, out = _duels(units, [*tree, "_blk"], [F.col("h"), F.col("doc_id")], level, seed, left)
        settled.append(out)
        units = units.drop("_blk").withColumn("_blocks", F.ceil(F.col("_blocks") / FAN_IN))
        left = -(-left // FAN_IN) + n_strata
        blocks = 0 if blocks == 1 else -(-blocks // FAN_IN)
    if n_strata:
        units, out = _duels(units.drop("_blocks"), ["source", "source_size", "target"], [-F.col("stratum"), F.col("h"), F.col("doc_id")], level + 1, seed, left)
        settled.append(out)
    last = units.withColumn("copy", F.when(uniform(F.lit(seed), F.lit("last"), "h") < F.col("p"), 1).otherwise(0))
    columns = [*shown, (F.col("base") + F.col("copy")).alias("copies"), F.col("h").alias("unit")]
    drawn = last.select(*columns)
    for s in settled:
        drawn = drawn.unionByName(s.select(*columns))
    fixed = whole.where(certain).select(*shown, F.when(F.col("size") == 0, 0).otherwise(F.col("base")).cast("long").alias("copies"), F.col("h").alias("unit"))
    return drawn.unionByName(fixed)


def per_row(units: DataFrame) -> DataFrame:
    """The units of mix, one row for each row of the input: copies are its own, the unit's shared evenly to within one.

    A unit of over RUN rows is first dealt as runs of rows, so that no task makes them all.
    """
    one = lambda df: df.select("*", F.explode(F.sequence(F.col("_from"), F.col("_to"))).alias("_i"))
    few = units.where(F.col("n_rows") <= RUN).select("*", F.lit(1).cast("long").alias("_from"), F.col("n_rows").alias("_to"))
    many = units.where(F.col("n_rows") > RUN).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / RUN))).alias("_run"))
    many = many.select("*", (F.col("_run") * RUN + 1).alias("_from"), F.least(F.col("n_rows"), (F.col("_run") + 1) * RUN).alias("_to")).repartition("unit", "_run").drop("_run")
    share = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("_i") <= F.pmod("copies", "n_rows")).cast("long")
    return one(few).unionByName(one(many)).withColumn("copies", share.cast("int")).drop("_i", "_from", "_to", "n_rows")
