"""Removal of long repeated byte strings by two-stage suffix sorting.

A byte goes if it is covered by a SPAN-byte string that starts anywhere else too, in the same text or another.

Dealing. Every SPAN-byte window is owned by its anchor, the last least one of its hashed GRAM-byte strings; equal windows have equal anchors at equal
places. Windows of one anchor are neighbours, and the text from the first to the end of the last is the anchor's context. So windows that may be
equal meet by their anchor's hash, at about 1.2 anchors for 100 bytes.

Settling. Anchors that occur once drop out. Contexts that occur twice or more are repeated as a whole. A window has SIDE or more bytes
of its own on one side of its anchor, so a context can only share windows with others of the same anchor that agree with it on the SIDE bytes to the
left or on those to the right. Such contexts of one anchor are suffix-sorted together: suffixes smaller than their successor are sorted directly, the rest is induced by scans over the
first-byte buckets, and neighbours in the order whose common prefix reaches SPAN are repeated. Only windows that a context owns count.
Anchors with over HOT distinct contexts are settled by grouping window hashes instead, so that no task holds them all.

Whole copies of a text are one text here (repeated as a whole, where it has SPAN bytes). Null texts are empty; texts below SPAN bytes lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, undealt
from .kernels import _BYTE, BLOCK, U, mix

SPAN, GRAM = 200, 32
SIDE = (SPAN - GRAM) // 2
HOT = 20_000
CHUNK = 1 << 20
_C = np.random.default_rng(77).integers(0, 2**63, 8, dtype=np.uint64) * U(2) + U(1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (32) bytes from each position on, by doubling."""
    h = _BYTE[x]
    for i, k in enumerate((1, 2, 4, 8, 16)):
        h = h[: len(h) - k] * _C[i] + h[k:]
    return mix(h)


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w."""
    n = len(v)
    pad = -n % w
    p = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(p, axis=1).ravel()[:n]
    tail = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(tail[: n - w + 1], head[w - 1 :])


def _hash_of(h: np.ndarray, lo: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hash of the bytes lo..end (GRAM or more) from the gram hashes that cover them."""
    out = seed.copy()
    for k in range(0, int((end - lo).max(initial=0)), GRAM):
        live = np.flatnonzero(lo + k < end)
        out[live] = mix(out[live] * _C[6] + h[np.minimum(lo[live] + k, end[live] - GRAM)])
    return out


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All anchors of the texts: d (text's index), lo (first owned window in the text), n (owned windows), fp (anchor's hash), ctx (context's hash),
    sides (32-bit hashes of the SIDE bytes left and right of the anchor; 0 where the context has fewer)."""
    names = ("d", "lo", "n", "fp", "ctx", "sides")
    x = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - SPAN + 1, 0)
    if not windows.sum():
        return dict.fromkeys(names, np.zeros(0, np.int64))
    h = gram_hashes(x)
    bits = U(max(20, len(x).bit_length()))
    room = (U(1) << bits) - U(1)
    keyed = ((h >> bits) << bits) | (room - np.arange(len(h), dtype=np.uint64))
    at = (room - (sliding_least(keyed, SPAN - GRAM + 1) & room)).astype(np.int64)  # the anchor of each window
    doc = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(doc)) + np.repeat(first - (np.cumsum(windows) - windows), windows)
    own = at[start]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])
    p, lo, n = own[new], start[new], np.diff(np.r_[new, len(start)])
    end = lo + n + SPAN - 1  # of the context
    ctx = _hash_of(h, lo, end, mix((p - lo).astype(np.uint64) * _C[5] + (end - lo).astype(np.uint64)))
    sides = []
    for a, b, ok in ((p - SIDE, p, p - SIDE >= lo), (p + GRAM, p + GRAM + SIDE, p + GRAM + SIDE <= end)):
        v = np.zeros(len(p), U)
        v[ok] = (_hash_of(h, a[ok], b[ok], np.zeros(int(ok.sum()), U)) >> U(32)) | U(1)
        sides.append(v)
    d = doc[new]
    return dict(zip(names, (d, lo - first[d], n, h[p].view(np.int64), ctx.view(np.int64), (sides[0] << U(32) | sides[1]).view(np.int64)), strict=True))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct context of an anchor in a text. spans: where it stands, if more than once."""
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts = batch.column(2).to_pylist()
        a = 0
        while a < len(texts):
            b, total = a, 0
            while b < len(texts) and (b == a or total + len(texts[b]) <= BLOCK):
                total += len(texts[b])
                b += 1
            f = anchors(texts[a:b])
            d, lo, n = f["d"], f["lo"], f["n"]
            key = mix(f["fp"].view(np.uint64) * _C[7] + f["ctx"].view(np.uint64)) + mix(d.astype(np.uint64))
            _, at, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            spans: list[list | None] = [None] * len(at)
            often = np.flatnonzero(times[back] > 1)
            for i in often[np.lexsort((lo[often], back[often]))].tolist():
                g, x, y = int(back[i]), int(lo[i]), int(lo[i] + n[i] + SPAN - 1)
                own = spans[g]
                if own is None:
                    spans[g] = [[x, y]]
                elif x <= own[-1][1]:
                    own[-1][1] = y
                else:
                    own.append([x, y])
            cols = [t1[a:b][d[at]], t2[a:b][d[at]], lo[at].astype(np.int32), n[at].astype(np.int32), f["fp"][at], f["ctx"][at], f["sides"][at]]
            listed = pa.array([None if s is None else [{"a": x, "b": y} for x, y in s] for s in spans], spans_type)
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), listed], ["t1", "t2", "lo", "n", "fp", "ctx", "sides", "spans"])
            a = b


def _words(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, zeros after the end."""
    k = np.concatenate([x, np.zeros(SPAN + 16, np.uint8)]).astype(np.uint64)
    for s, b in ((1, 8), (2, 16), (4, 32)):
        k = (k[: len(k) - s] << U(b)) | k[s:]
    return k


def suffix_order(x: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """All suffixes of x in the order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(x)
    k = _words(x)
    # A suffix is small if it is below its successor: its byte, or the first other byte after its run, decides. The last one is not.
    change = np.flatnonzero(x[1:] != x[:-1])
    up = np.zeros(n, bool)
    if len(change):
        nxt = np.searchsorted(change, np.arange(n))
        inner = nxt < len(change)
        c = change[nxt[inner]]
        up[np.flatnonzero(inner)] = x[c] < x[c + 1]
    small = np.flatnonzero(up)
    # 1. Sort the small ones directly, 8 bytes at a time; only ties go on.
    order = small[np.argsort(k[small], kind="stable")]
    if len(order):
        v = k[order]
        group = np.cumsum(np.r_[False, v[1:] != v[:-1]])
        tied = np.flatnonzero(np.r_[False, group[1:] == group[:-1]] | np.r_[group[1:] == group[:-1], False])
        g = group[tied]
        d = 8
        while len(tied) and d < depth:
            p = order[tied]
            v = k[np.minimum(p + d, len(k) - 1)]
            s = np.lexsort((v, g))
            order[tied] = p[s]
            v = v[s]
            same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
            g = np.cumsum(np.r_[False, ~same])
            keep = np.r_[False, same] | np.r_[same, False]
            tied, g = tied[keep], g[keep]
            d += 8
    cuts = np.searchsorted(x[order], np.arange(257))
    # 2. Scan the buckets by first byte; what stands before a placed suffix, if it is not small, goes to the front of its own bucket.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[x[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        cur = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        placed = []
        while len(cur):
            placed.append(cur)
            before = cur - 1
            before = before[before >= 0]
            cur = before[x[before] == c]
        placed.append(order[cuts[c] : cuts[c + 1]])
        bucket = np.concatenate(placed)
        if len(bucket):
            out.append(bucket)
            before = bucket - 1
            before = before[before >= 0]
            before = before[x[before] > c]
            if len(before):
                first = x[before]
                s = np.argsort(first, kind="stable")
                before, first = before[s], first[s]
                at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
                for part, b in zip(np.split(before, at[1:]), first[at].tolist(), strict=True):
                    waiting[b].append(part)
    return np.concatenate(out)


def common_prefix(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Length in whole 8-byte steps of the common prefixes of suffixes a and b, up to most."""
    k = _words(x)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for d in range(0, most, 8):
        live = live[k[np.minimum(a[live] + d, len(k) - 1)] == k[np.minimum(b[live] + d, len(k) - 1)]]
        out[live] += 8
    return out


def repeated_windows(contexts: list[bytes], owned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of owned windows that occur twice in the contexts: context's index, first window, last window."""
    x = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    first = np.cumsum(sizes) - sizes
    mine = np.zeros(len(x) + 1, np.int64)
    np.add.at(mine, first, 1)
    np.add.at(mine, first + owned, -1)
    mine = np.cumsum(mine[:-1]) > 0
    order = suffix_order(x)
    order = order[mine[order]]
    hit = np.flatnonzero(common_prefix(x, order[:-1], order[1:]) >= SPAN)
    marked = np.zeros(len(x) + 1, bool)
    marked[order[hit]] = True
    marked[order[hit + 1]] = True
    edge = np.diff(np.r_[False, marked].astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1  # windows of neighbouring contexts never touch: each context ends unowned
    which = np.searchsorted(first, a, "right") - 1
    return which, a - first[which], b - first[which]


def _sorted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: fp, ctx, n, context. Whole anchors are settled about CHUNK bytes at a time."""
    fps: list[int] = []
    ctxs: list[int] = []
    ns: list[int] = []
    texts: list[bytes] = []
    size = 0

    def settle(upto: int) -> pa.RecordBatch:
        w, a, b = repeated_windows(texts[:upto], np.array(ns[:upto], np.int64))
        f, c = np.array(fps[:upto], np.int64)[w], np.array(ctxs[:upto], np.int64)[w]
        return pa.RecordBatch.from_arrays([pa.array(f), pa.array(c), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["fp", "ctx", "a", "b"])

    for batch in batches:
        for fp, ctx, n, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size > CHUNK and fps[-1] != fp:
                yield settle(len(fps))
                fps, ctxs, ns, texts, size = [], [], [], [], 0
            if fps and fps[-1] == fp and ctxs[-1] == ctx:  # sent twice
                continue
            fps.append(fp)
            ctxs.append(ctx)
            ns.append(n)
            texts.append(t)
            size += len(t)
    if texts:
        yield settle(len(fps))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp, ctx, n, context -> one row a window: its hash and place."""
    for batch in batches:
        for fp, ctx, n, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            marks = [hashlib.blake2b(t[i : i + SPAN], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array([fp] * n, pa.int64()), pa.array([ctx] * n, pa.int64()), pa.array(range(n), pa.int32())], ["win", "fp", "ctx", "i"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t1, t2, text, wanted [(fp, ctx, lo, n)] -> fp, ctx, n, context; copies of a text follow each other and count once."""
    last = None
    for batch in batches:
        t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        fp, ctx, ns, out, held = [], [], [], [], 0
        for i in range(len(t1)):
            if (t1[i], t2[i]) == last:
                continue
            last = (t1[i], t2[i])
            text = batch.column(2)[i].as_py()
            for w in batch.column(3)[i].as_py():
                fp.append(w["fp"])
                ctx.append(w["ctx"])
                ns.append(w["n"])
                out.append(text[w["lo"] : w["lo"] + w["n"] + SPAN - 1])
                held += len(out[-1])
            if held > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(ctx, pa.int64()), pa.array(ns, pa.int32()), pa.array(out, pa.binary())], ["fp", "ctx", "n", "context"])
                fp, ctx, ns, out, held = [], [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(ctx, pa.int64()), pa.array(ns, pa.int32()), pa.array(out, pa.binary())], ["fp", "ctx", "n", "context"])


def _removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Bytes removed, maximal runs, and the hash of what stays."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    h, at = hashlib.sha256(), 0
    for a, b in runs:
        h.update(text[at:a])
        at = b
    h.update(text[at:])
    return sum(b - a for a, b in runs), len(runs), h.hexdigest()


def _removal_rows(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                got.append((len(text), *_removed(text, [(s["a"], s["b"]) for s in batch.column(2)[i].as_py()])))
            cols = list(zip(*got, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(cols[k], pa.int64()) for k in range(3)], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _meet(texts: DataFrame, keys: DataFrame, how: str, n: int, most: int) -> DataFrame:
    """Semi or anti join on the text's key; the keys are broadcast if there are at most `most` of them."""
    return texts.join(F.broadcast(keys) if n <= most else keys, ["t1", "t2"], how)


def repeated_spans(texts: DataFrame, broadcast_keys: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """texts: t1, t2 (a text's key), data (bytes). Returns t1, t2, spans (array of a, b: bytes to remove) of the texts that lose any."""
    spark = texts.sparkSession
    long = texts.where(F.octet_length("data") >= SPAN)
    rows = long.select("t1", "t2", "data").mapInArrow(_anchor_rows, "t1 long, t2 long, lo int, n int, fp long, ctx long, sides long, spans array<struct<a:int,b:int>>")
    place = F.xxhash64("t1", "t2", "lo")
    often = F.max(F.col("spans").isNotNull())
    met = rows.groupBy("fp").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.min("ctx").alias("c"), F.max("ctx").alias("d"), often.alias("o")).where("p <> q or o").select("fp", (F.col("c") != F.col("d")).alias("several"))
    met = cut(met).select(undealt("fp").alias("fp"), "several")
    found = cut(rows.join(met, "fp"))  # copies of a text give equal rows
    kinds = cut(found.groupBy("fp", "ctx").agg(F.max("several").alias("several"), F.max("sides").alias("sides"), ((F.min(place) != F.max(place)) | often).alias("whole"), F.min(F.struct("t1", "t2", "lo", "n")).alias("at")))
    several = kinds.where("several")
    left, right = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))
    agree = [several.select("fp", side.alias("_s")).where("_s <> 0").groupBy("fp", "_s").agg(F.count("*").alias("_k")).where("_k > 1").select("fp", "_s", F.lit(i).alias("_i")) for i, side in enumerate((left, right))]
    both = F.explode(F.array(F.struct(left.alias("_s"), F.lit(0).alias("_i")), F.struct(right.alias("_s"), F.lit(1).alias("_i"))))
    meeting = several.select("fp", "ctx", both.alias("_b")).select("fp", "ctx", "_b.*").join(agree[0].unionByName(agree[1]), ["fp", "_s", "_i"]).select("fp", "ctx").distinct()
    open_ = several.join(meeting, ["fp", "ctx"], "left_semi").select("fp", "ctx", "whole", "at.*")
    open_ = cut(open_)

    # Contexts of the open anchors, cut from one text each.
    wanted = open_.groupBy("t1", "t2").agg(F.collect_list(F.struct("fp", "ctx", "lo", "n")).alias("wanted"))  # bounded by the text
    keys = open_.select("t1", "t2").distinct()
    n_keys = keys.count()
    spans = []
    if n_keys:
        held = _meet(long, keys, "left_semi", n_keys, broadcast_keys) if n_keys <= broadcast_keys else long
        contexts = held.join(wanted, ["t1", "t2"]).select("t1", "t2", "data", "wanted").mapInArrow(_cut_contexts, "fp long, ctx long, n int, context binary")
        hot_fps = cut(open_.groupBy("fp").agg(F.count("*").alias("k")).where(F.col("k") > hot).select(undealt("fp").alias("fp")))
        n_hot = hot_fps.count()
        if n_hot:
            contexts = cut(contexts)
        usual = contexts.join(hot_fps, "fp", "left_anti") if n_hot else contexts
        marks = usual.repartition(4 * shuffle_partitions(spark), "fp").sortWithinPartitions("fp", "ctx").mapInArrow(_sorted_contexts, "fp long, ctx long, a int, b int")
        if n_hot:
            windows = cut(contexts.join(hot_fps, "fp", "left_semi").mapInArrow(_window_rows, "win binary, fp long, ctx long, i int").distinct())
            again = windows.groupBy("win").agg(F.count("*").alias("k")).where("k > 1").select("win")
            marks = marks.unionByName(windows.join(again, "win").select("fp", "ctx", F.col("i").alias("a"), F.col("i").alias("b")))
        alone = open_.where(~F.col("whole")).select("fp", "ctx", "t1", "t2", "lo")
        spans.append(marks.join(alone, ["fp", "ctx"]).select("t1", "t2", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + SPAN).alias("b")))
    whole = kinds.where("whole").select("fp", "ctx")
    once = F.array(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("n") + SPAN - 1).alias("b")))
    spans.append(found.join(whole, ["fp", "ctx"]).select("t1", "t2", F.inline(F.coalesce("spans", once))).distinct())
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    copied = long.groupBy("t1", "t2").agg(F.count("*").alias("k"), F.max(F.octet_length("data")).alias("b")).where("k > 1").select("t1", "t2", F.lit(0).alias("a"), F.col("b").cast("int").alias("b"))
    return out.unionByName(copied).groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # bounded by the text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the bytes that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.encode(text, "UTF-8").alias("data"))
    spans = cut(repeated_spans(texts, broadcast_keys, hot))
    keys = spans.select("t1", "t2")
    n = keys.count()
    size = F.octet_length("data").cast("long")
    clean = _meet(texts, keys, "left_anti", n, broadcast_keys).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))
    hit = _meet(texts, keys, "left_semi", n, broadcast_keys) if n <= broadcast_keys else texts
    run, schema = _removal_rows(docs.schema[id_col].dataType.simpleString())
    return clean.unionByName(hit.join(spans, ["t1", "t2"]).select("doc_id", "data", "spans").mapInArrow(run, schema))
