"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, minhash, mixing, pii, quality, sharding, simhash, suffixes, toxicity
from .common import table

#: Production parameters.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [5.0, 2.0, 1.0], 1.5, 2.0
SHARDS = 16
#: (folds, the one held out) by crc32 of the id as text.
QUALITY_FOLD, TOXIC_FOLD = (4, 2), (5, 0)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def simhash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 against all: fingerprints within 3 bits, and how many documents hold each."""
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.xxhash64("text"))
    fps = simhash.fingerprints(docs, ["doc_id", "text_hash"]).select("doc_id", "fp")
    found = simhash.search(fps.where("doc_id % 50 = 0"), fps, 3)
    return found.select("doc_id", simhash.hexed(F.col("near_fp")).alias("near_fingerprint"), F.col("distance").cast("long").alias("distance"), "n_rows")


def op2_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels, "quality", *QUALITY_FOLD))
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), *QUALITY_FOLD).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels, "toxic", *TOXIC_FOLD))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id"), *TOXIC_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_offending"), F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["from"], s["to"])), ",").alias("offending"),
    )


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.per_row(mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sharding.tree(SHARDS)
    return sharding.assign(table(spark, sf_dir, "documents"), root, sharding.grow(root, SHARDS))


def op6_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), words=4)


def op7_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, simhash_search, op2_rule_quality, op3_noisy_or_toxicity, op4_pivotal_mix, op5_hash_tree_shards, op6_tensored_minhash, op7_two_stage_suffixes, op8_winnowing, op9_pii_transducer, op10_license_scan)}
ORACLES: dict[str, str] = {
    "op6_tensored_minhash": r"""
with recursive low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) as i from low)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select reach.doc_id, links.y from reach join links on reach.r = links.x),
least as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from least left join sizes using (doc_id)
""",
    "op8_winnowing": r"""
with low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sized as (select item_id, w, least(len(w), 10) as n from item where len(w) > 0),
windows as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
lengths as (select distinct n from windows),
places as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as i from low, lengths)),
hits as (select doc_id, i, p.n, item_id from places p join windows v on p.win = v.win and p.n = v.n),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select l.doc_id, cast(len(l.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low l left join words using (doc_id) left join items using (doc_id)
""",
}
