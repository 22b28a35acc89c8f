"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of a benchmark item; an item with fewer words is one window. Both sides keep the least GRAM-word hash
of every SPAN - GRAM + 1 neighbouring ones, so two texts that share SPAN words share a kept hash. Kept hashes of documents that occur among the
items' are extended: the windows that hold them are looked up, and their words are hit. Windows of short items are looked up as they are.

A benchmark of up to `broadcast_bytes` of text is indexed once, as sorted arrays of some three times its bytes, and sent to the executors; beyond, windows
that hold a kept hash are joined by shuffle (`distributed=True`), with the same result. There, items are listed once for each distinct combination of windows'
owner sets, so that a window of all documents and items does not make rows of all pairs.

Null and empty texts have no words and no hits; items without words are ignored; a null item_id counts as the empty string; repeated items and
rows count once for each distinct id or each row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .kernels import ALNUM, U, Words, map_texts, winnow

SPAN, GRAM = 10, 5
#: A word before its letters are lowered.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def item_windows(texts: list[bytes]) -> dict[str, list]:
    """For each item: its window hashes, their length in words, and the kept hashes (none for short items)."""
    w = Words(texts, ALNUM)
    long, inside = w.grams(SPAN)
    gram, _ = w.grams(GRAM)
    windows, sizes, kept = [], [], []
    for i in range(len(texts)):
        a, b = w.bounds[i], w.bounds[i + 1]
        n = int(b - a)
        if n >= SPAN:
            windows.append(np.unique(_signed(long[a : b - SPAN + 1])))
            kept.append(np.unique(_signed(gram[a : b - GRAM + 1][winnow(gram[a : b - GRAM + 1], SPAN - GRAM + 1)])))
        else:
            short = [w.grams(n)[0][a]] if n else []
            windows.append(_signed(np.array(short, U)))
            kept.append(np.zeros(0, np.int64))
        sizes.append(min(n, SPAN))
    return {"windows": windows, "size": sizes, "kept": kept}


class Found:
    """Windows found in one block of texts: arrays of word position, length in words and window hash."""

    def __init__(self, w: Words, kept: np.ndarray | None, short: dict[int, np.ndarray]) -> None:
        """kept: sorted kept hashes of the items, or None for all that the texts keep themselves. short: by length the sorted hashes, or lengths only."""
        pos, size, value = [], [], []
        gram, inside = w.grams(GRAM)
        long, whole = w.grams(SPAN)
        if len(long):
            at = winnow(np.where(inside, gram, U(2**64 - 1)), SPAN - GRAM + 1)
            at = at[inside[at]]
            if kept is not None:
                at = at[_in(_signed(gram[at]), kept)]
            starts = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
            starts = starts[(starts >= 0) & (starts < len(long))]
            starts = starts[whole[starts]]
            pos.append(starts)
            size.append(np.full(len(starts), SPAN))
            value.append(_signed(long[starts]))
        for n, hashes in short.items():
            g, ok = w.grams(n)
            if len(g):
                starts = np.flatnonzero(ok & _in(_signed(g), hashes))
                pos.append(starts)
                size.append(np.full(len(starts), n))
                value.append(_signed(g[starts]))
        empty = [np.zeros(0, np.int64)]
        self.pos, self.size, self.value = (np.concatenate(x or empty) for x in (pos, size, value))


def _in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _covered(starts: np.ndarray, sizes: np.ndarray) -> int:
    """Words in the union of the windows; starts ascend."""
    ends = starts + sizes
    before = np.maximum.accumulate(np.r_[starts[0], ends[:-1]])
    return int(np.maximum(0, ends - np.maximum(starts, before)).sum())


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20, distributed: bool | None = None) -> DataFrame:
    """One row a document: doc_id and COLUMNS."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text"))
    if distributed is None:
        distributed = (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes
    items = map_texts(bench, item_windows, "windows array<long>, size int, kept array<long>", "item_id", "text", "item_id")
    return _joined(docs, items, id_col, text_col) if distributed else _indexed(docs, items, id_col, text_col)


class Index:
    """Items as sorted arrays: kept hashes; hashes of short windows by length; windows, and for each its owners as ranks among the sorted ids."""

    def __init__(self, items: pa.Table) -> None:
        """items: item_id, windows, size, kept."""
        flat = lambda name: (items.column(name).combine_chunks(), np.diff(items.column(name).combine_chunks().offsets.to_numpy()))
        (windows, lengths), (kept, _) = flat("windows"), flat("kept")
        value, size = windows.flatten().to_numpy(), np.repeat(items.column("size").to_numpy(), lengths)
        self.short = {int(n): np.unique(value[size == n]) for n in np.unique(size[size < SPAN])}
        self.ids = sorted(set(items.column("item_id").to_pylist()))
        rank = {s: i for i, s in enumerate(self.ids)}
        owner = np.repeat(np.array([rank[s] for s in items.column("item_id").to_pylist()], np.int32), lengths)
        pairs = np.lexsort((owner, value))
        value, owner = value[pairs], owner[pairs]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, bool)
        value, self.owners = value[new], owner[new]
        self.windows, self.first = np.unique(value, return_index=True)
        self.first = np.r_[self.first, len(value)]
        self.kept = np.unique(kept.flatten().to_numpy())


def _indexed(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(Index(items.where("size > 0").toArrow()))  # bounded: find() has checked the benchmark's bytes

    def run(texts: list[bytes]) -> dict[str, list]:
        x = index.value
        w = Words(texts, ALNUM)
        f = Found(w, x.kept, x.short)
        real = np.flatnonzero(_in(f.value, x.windows))
        real = real[np.argsort(f.pos[real], kind="stable")]
        pos, size, win = f.pos[real], f.size[real], np.searchsorted(x.windows, f.value[real])
        cuts = np.searchsorted(pos, w.bounds)
        rows = []
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            hit, own = 0, []
            if b > a:
                hit = _covered(pos[a:b], size[a:b])
                ranks = np.unique(np.concatenate([x.owners[x.first[k] : x.first[k + 1]] for k in np.unique(win[a:b])]))
                own = [x.ids[k] for k in ranks.tolist()]
            rows.append((int(w.bounds[i + 1] - w.bounds[i]), hit, len(own), _digest(own), hit > 0))
        return dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True))

    return map_texts(docs, run, COLUMNS, id_col, text_col)


def _joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """By shuffle, over distinct texts: windows that hold a kept hash of the text meet the items' windows on their hash."""
    sizes = sorted(r["size"] for r in items.where(f"size between 1 and {SPAN - 1}").select("size").distinct().collect())  # at most SPAN - 1 rows
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.struct(F.xxhash64(text), F.crc32(F.encode(text, "UTF-8")), F.length(text)).cast("string").alias("_key"), text.alias("text"))

    def run(texts: list[bytes]) -> dict[str, list]:
        w = Words(texts, ALNUM)
        pos, size, value = [], [], []
        f = Found(w, None, {})
        parts = [(f.pos, f.size, f.value)]
        for n in sizes:
            g, ok = w.grams(n)
            at = np.flatnonzero(ok)
            parts.append((at, np.full(len(at), n), _signed(g[at])))
        pos, size, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(pos, kind="stable")
        pos, size, value = pos[order], size[order], value[order]
        cuts = np.searchsorted(pos, w.bounds)
        out = [[{"pos": int(p - w.bounds[i]), "size": int(n), "value": int(v)} for p, n, v in zip(pos[a:b], size[a:b], value[a:b], strict=True)] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        return {"found": out}

    distinct = keyed.dropDuplicates(["_key"])
    found = map_texts(distinct, run, "found array<struct<pos:int,size:int,value:long>>", "_key", "text", "_key")
    windows = items.where("size > 0").select("item_id", "size", F.explode("windows").alias("value")).distinct()
    # the items of each window as one number, and for each such set one window that has it
    owned = windows.groupBy("value", "size").agg(F.count("*").alias("k"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), "item_id").cast("decimal(38,0)")).alias("t"))
    owned = cut(owned.select("value", "size", F.xxhash64("k", "s", "t").alias("set")))
    some = owned.groupBy("set").agg(F.min(F.struct("value", "size")).alias("w")).select("set", "w.value", "w.size")
    hits = cut(found.select("_key", F.inline("found")).join(owned, ["value", "size"]).select("_key", "pos", "size", "set"))
    words = hits.select("_key", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("word")).distinct().groupBy("_key").agg(F.count("*").alias("n_hit"))
    mixes = hits.groupBy("_key").agg(F.array_sort(F.collect_set("set")).alias("sets")).withColumn("mix", F.xxhash64("sets"))  # a text's own
    items_of = mixes.groupBy("mix").agg(F.first("sets").alias("sets")).select("mix", F.explode("sets").alias("set")).join(some, "set").join(windows, ["value", "size"])
    named = items_of.select("mix", "item_id").distinct().groupBy("mix").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("_ids"))  # what one digest is of
    ids = F.array_join(F.coalesce("_ids", F.array().cast("array<string>")), ",")
    digests = named.select("mix", "n_items", F.sha2(F.encode(ids, "UTF-8"), 256).alias("items_sha256"))
    per = distinct.select("_key", F.regexp_count("text", F.lit(ALNUM_WORD)).cast("long").alias("n_words")).join(words, "_key", "left").join(mixes.select("_key", "mix"), "_key", "left").join(digests, "mix", "left")
    out = keyed.select("doc_id", "_key").join(per, "_key")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
