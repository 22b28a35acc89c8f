"""Operators as pipeline stages: documents in, documents out, the decision applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, minhash, mixing, sharding, toxicity
from .common import cut, matched, table
from .queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS, SHARDS, TOXIC_FOLD

#: Row keys up to this many are sent to all executors; more are joined by shuffle. As a hashed table they take many times their 8 bytes in the driver.
BROADCAST_IDS = 500_000


def _renamed(docs: DataFrame) -> DataFrame:
    """docs under names of its own: doc_id, text and source as they are, every column again as _d0, _d1, .., so that no name can clash."""
    return docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(docs.columns)])


def _restored(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return keyed.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)])


def _keyed(docs: DataFrame) -> DataFrame:
    """_renamed docs with _row, which tells rows apart by id and text; equal for rows of the same id (or none) and text."""
    return _renamed(docs).withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _without(keyed: DataFrame, rejected: DataFrame, docs: DataFrame) -> DataFrame:
    """docs without the rows whose _row is rejected."""
    rows = cut(rejected.select("_row").distinct())
    return _restored(keyed.join(matched(rows, rows.count(), BROADCAST_IDS), "_row", "left_anti"), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", *TOXIC_FOLD)
    keyed = _keyed(docs)
    return _without(keyed, toxicity.score(keyed, model, "_row").where("score >= 0.5").withColumnRenamed("doc_id", "_row"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): that of the least id, one without an id only if none has one.

    Of repeated rows of that id and text one stays. Rows without words are in no group and all stay.
    """
    keyed = _keyed(docs)
    ordered = keyed.withColumn("_node", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("_row").alias("row")))
    groups = cut(minhash.groups(ordered, 5, "_node").select(F.col("doc_id.row").alias("_row"), "n_shingles", "kept"))
    again = cut(groups.where("kept and n_shingles > 0").groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select("_row"))
    left = _without(keyed, groups.where(~F.col("kept")), docs)
    if again.isEmpty():
        return left
    more = _keyed(left)
    one = _restored(more.join(again, "_row", "left_semi").dropDuplicates(["_row"]), docs)
    return _without(more, again, docs).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    keyed = _keyed(docs)
    return _without(keyed, decontaminate.find(keyed, table(spark, sf_dir, "benchmark"), "_row").where("contaminated").withColumnRenamed("doc_id", "_row"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows of one id and text share their copies: each has the whole part, one of them the rest."""
    taken = mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST).where("copies > 0")
    taken = taken.select(F.col("unit").alias("_u"), F.col("source").alias("_s"), F.floor(F.col("copies") / F.col("n_rows")).alias("_each"), F.pmod("copies", "n_rows").alias("_rest"))
    rows = _renamed(docs).withColumns({"_k": mixing.unit_key(F.col("doc_id"), F.col("text")), "_from": F.col("source").cast("string")}).drop("doc_id", "text", "source")
    rows = rows.join(taken, (F.col("_k") == F.col("_u")) & F.col("_from").eqNullSafe(F.col("_s")))
    times = lambda df, n: df.where(F.col(n) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    once = rows.where("_rest > 0").dropDuplicates(["_u", "_s"])
    return _restored(times(rows, "_each"), docs).unionByName(_restored(times(once, "_rest"), docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each row with its shard, slot, size and checksum (repeated copies differ in slot)."""
    root = sharding.tree(SHARDS)
    return sharding.place(docs, root, sharding.grow(root, SHARDS))
