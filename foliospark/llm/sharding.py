"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A key descends from the root: at each level every child draws
-ln(u) / weight, u a hash of (child, key), and the least draw wins. A child's share is its weight's share,
and a key's draw at a node does not depend on its siblings, so a change of weight in one subtree moves
only keys that enter or leave that subtree.

`grow` adds a shard as a new subtree (its own region) and leaves every older weight as it is: keys
move into the new shard only.

Rows: null ids draw as one key; repeated ids share a shard; null text has size 1 and the checksum of no bytes;
an empty table gives no rows. `assign` carries no other columns of the input, `place` all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, uniform


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def _parent(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def tree(shards: int, per_rack: int = 4, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards in order, per_rack to a rack, racks_per_region to a region."""
    w = weights or {}
    leaves = [Node(f"s{i}", w.get(i, 1.0), (), i) for i in range(shards)]
    racks = [_parent(f"k{i // per_rack}", leaves[i : i + per_rack]) for i in range(0, shards, per_rack)]
    regions = [_parent(f"r{i // racks_per_region}", racks[i : i + racks_per_region]) for i in range(0, len(racks), racks_per_region)]
    return _parent("root", regions)


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """root with one more shard, in a region and rack of its own."""
    leaf = Node(f"s{shard}", weight, (), shard)
    region = _parent(f"r-s{shard}", [_parent(f"k-s{shard}", [leaf])])
    return _parent(root.name, [*root.children, region])


def descend(node: Node, *key: Column) -> Column:
    """The shard that the key reaches below node."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(node.children[0], *key)
    draws = [F.struct((-F.ln(uniform(F.lit(c.name), *key)) / F.lit(float(c.weight))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    best = F.array_min(F.array(*draws))["i"]
    out = descend(node.children[-1], *key)
    for i in range(len(node.children) - 2, -1, -1):
        out = F.when(best == i, descend(node.children[i], *key)).otherwise(out)
    return out


def _shards(node: Node) -> int:
    return sum(map(_shards, node.children)) if node.children else 1


COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _drawn(docs: DataFrame, root: Node, grown: Node | None, id_col: str, text_col: str, more: list[Column]) -> DataFrame:
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"),
        descend(root, key.cast("string")).cast("int").alias("shard"), (descend(grown, key.cast("string")) if grown else F.lit(None)).cast("int").alias("grown_shard"), *more,
    )
    buckets = -(-4 * shuffle_partitions(docs.sparkSession) // _shards(root))
    return rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))


def _slotted(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """rows with their slot: a prefix sum over small hash buckets of each shard plus the rank within the bucket, so that no task holds a whole shard."""
    counts = narrow.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # about four rows a shuffle partition, one a shard at least
    rank = Window.partitionBy("shard", "_b").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("_rn", F.row_number().over(rank)).join(offsets, ["shard", "_b"]).withColumn("slot", (F.col("_off") + F.col("_rn") - 1).cast("long"))


def assign(docs: DataFrame, root: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COLUMNS: size (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless in each shard), grown_shard."""
    rows = cut(_drawn(docs, root, grown, id_col, text_col, []))
    return _slotted(rows, rows).select("doc_id", *COLUMNS)


def place(docs: DataFrame, root: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with COLUMNS of assign, dealt by shard. A column of docs of one of these names gives way to the new one."""
    kept = [c for c in docs.columns if c not in COLUMNS]
    rows = _drawn(docs, root, grown, id_col, text_col, [F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(kept)])
    out = _slotted(rows, _drawn(docs, root, grown, id_col, text_col, []))
    return out.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(kept)], *COLUMNS)
