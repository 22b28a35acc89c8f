"""Near-duplicate groups by MinHash with tensored banding, verified on full shingle sets.

Two collections of SIDE partial keys (each of PER minhashes) are computed; every pair of one key from either is the key of one
of SIDE x SIDE tables, so 2 x SIDE x PER minhashes serve all tables. A pair of similarity s meets in some table with
probability (1 - (1 - s^PER)^SIDE)^2: 0.9993 at 0.8, 0.99999 at 0.9.

1. Texts with the same set form one class; only classes go on (copies never multiply).
2. Keys held by two classes or more keep their members; for these classes alone the sets are made again, with a signature of WIDE
   further minhashes, four bits each, and the LOW least hashes.
3. Three rounds look for links, each after contracting those found so far, so a group of n like members costs about n
   verifications, not n^2, and no candidate between components goes unchecked:
   star: each class against the least member of the cells that it shares most of, if these are STRONG cells or more;
   best: in the cells that still hold several components, everyone outside the cell's main component against the likeliest of another;
   all: in those, all pairs of different components. Where one is likely like more than FEW members of a component, it is
   checked against the whole component, by blocks that hold their sets: so the failing pairs of a large group do not become rows.
   The last two compare signatures and sizes within a cell, then the least hashes of each pair once. What passes is verified on full sets.
4. Components of the verified links; a class's documents share its component.

A cell of over CELL members is dealt as blocks: the main component's rows against the others', which are few, so that rows are not
multiplied by the cell's size. Both filters (AGREE of WIDE; NEAR of the LOW least of the union) pass a pair of similarity 0.8 with
probability 1 - 8e-6. Intermediate tables are written below the checkpoint folder and removed when no later step reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, matched, release, shuffle_partitions, sized
from .components import components
from .kernels import PLAIN, U, Words, map_texts, mix

SIDE, PER = 8, 2
HASHES = 2 * SIDE * PER
WIDE, AGREE = 128, 84
LOW, NEAR = 256, 174
CELL = 4096
STRONG = 8
#: From more likely members than this on, a component is checked as a whole; by blocks of SETS members.
FEW, SETS = 4, 256
#: Tables of a few longs a row are sent to all executors up to so many rows: several are in the driver's memory at once, each up to three times.
BROADCAST_ROWS = 100_000
_RNG = np.random.default_rng(606)
_A = _RNG.integers(0, 2**63, HASHES + WIDE, dtype=np.uint64) * U(2) + U(1)
_B = _RNG.integers(0, 2**63, HASHES + WIDE, dtype=np.uint64)
_TAG = _RNG.integers(0, 2**63, 2 * SIDE, dtype=np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of all words as one shingle if they are fewer; none without words."""
    w = Words(texts, PLAIN)
    g, _ = w.grams(k)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        n = int(b - a)
        if n >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(np.array([int.from_bytes(hashlib.blake2b(w.hash[a:b].tobytes(), digest_size=8).digest(), "little")] if n else [], U))
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minhashes(sets: list[np.ndarray], first: int, count: int) -> np.ndarray:
    """One row a set (none empty), one column for each of the hash functions from first on."""
    if not sets:
        return np.zeros((0, count), U)
    flat, offsets = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    return mix(np.stack([np.minimum.reduceat(flat * a + b, offsets) for a, b in zip(_A[first : first + count], _B[first : first + count], strict=True)], axis=1))


def partial_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two collections of SIDE keys, each from PER minhashes of its own."""
    least = minhashes(sets, 0, HASHES)
    keys = np.repeat(_TAG[None, :], len(least), axis=0)
    for j in range(PER):
        keys = mix(keys ^ least[:, j::PER])
    return keys


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row a set (none empty): WIDE minhashes of four bits, two to a byte."""
    w = (minhashes(sets, HASHES, WIDE) & U(15)).astype(np.uint8)
    return w[:, ::2] | (w[:, 1::2] << 4)


def low_hashes(s: np.ndarray) -> bytes:
    """The LOW least of the set's hashes, cut to 32 bits; fewer only if they are all."""
    return np.unique((mix(s) >> U(32)).astype(np.uint32))[:LOW].tobytes()


def near(a: np.ndarray, b: np.ndarray, whole: bool) -> bool:
    """Whether two sets of least hashes allow a similarity of 0.8; whole: both hold their whole set."""
    if whole:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common >= 79 * (len(a) + len(b) - common)
    least = np.sort(np.concatenate([a, b]))
    twice = least[1:] == least[:-1]
    rank = np.cumsum(np.r_[True, ~twice])  # place among the distinct
    return int(twice[rank[1:] <= LOW].sum()) >= NEAR


def sketch(texts: list[bytes], k: int) -> dict[str, list]:
    sets = shingle_sets(texts, k)
    keys = partial_keys([s for s in sets if len(s)])
    out: dict[str, list] = {"n": [], "cls": [], "keys": []}
    i = 0
    for s in sets:
        out["n"].append(len(s))
        if len(s):
            out["cls"].append(digest(s))
            out["keys"].append(keys[i].view(np.int64))
            i += 1
        else:
            for c in ("cls", "keys"):
                out[c].append(None)
    return out


def _cells(mode: str):
    """Pairs of each cell whose signatures and sizes agree. Rows come sorted by cell; a cell may span batches.

    Columns: cell, cid, comp, n, half, table, signature; in the last round also partial keys. A cell of two halves compares across them only;
    half is 2 for a cell with itself, 1 for the side that asks. In the last round a pair comes from the first table in which it meets only, and a
    row may be one of a class (a) and a whole component (b).
    """

    def pairs(cid, comp, n, half, table, sig, keys=None) -> Iterator[tuple[int, np.ndarray, bool]]:
        """x with members (their places) or, true, with components (their ids)."""
        if half[0] != 2:
            ask, answer = np.flatnonzero(half == 1), half == 0
        else:
            _, of, count = np.unique(comp, return_inverse=True, return_counts=True)
            main = of == np.argmax(count)
            ask, answer = np.flatnonzero(~main), np.ones(len(cid), bool)
        for x in ask:
            ok = answer & (comp != comp[x])
            if half[0] == 2 and mode == "all":
                ok &= main | (np.arange(len(cid)) > x)
            j = np.flatnonzero(ok)
            j = j[5 * np.minimum(n[x], n[j]) >= 4 * np.maximum(n[x], n[j])]
            agree = (sig[j] == sig[x]).sum(axis=1)
            j, agree = j[agree >= AGREE], agree[agree >= AGREE]
            if mode == "best":
                if len(j):
                    yield x, j[[np.argmax(agree)]], False
                continue
            same = keys[j] == keys[x]
            j = j[SIDE * np.argmax(same[:, :SIDE], axis=1) + np.argmax(same[:, SIDE:], axis=1) == table[x]]
            if len(j):
                ids, of_j, count = np.unique(comp[j], return_inverse=True, return_counts=True)
                yield x, j[count[of_j] <= FEW], False
                yield x, ids[count > FEW], True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def emit(cols: list) -> pa.RecordBatch:
            cell, cid, rest = cols[0], cols[1], cols[2:]
            cuts = np.flatnonzero(np.diff(cell)) + 1
            a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(cell)].tolist(), strict=True):
                if hi - lo > 1:
                    ids = cid[lo:hi]
                    for x, j, whole in pairs(ids, *[r[lo:hi] for r in rest]):
                        y = j if whole else ids[j]
                        a.append(np.full(len(j), ids[x]) if whole else np.minimum(ids[x], y))
                        b.append(y if whole else np.maximum(ids[x], y))
                        c.append(np.full(len(j), int(whole)))
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b), np.concatenate(c)]), axis=1)
            return pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "whole": pa.array(found[2].astype(bool), pa.bool_())})

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            packed = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, WIDE // 2)
            now.append(np.concatenate([packed & 15, packed >> 4], axis=1))
            if mode == "all":
                now.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint32).reshape(-1, 2 * SIDE))
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield emit([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield emit(held)

    return run


def _tested(test):
    """Rows a, b of those (a, b, x, y) whose x and y pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([test(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _likely(x: bytes, y: bytes) -> bool:
    return near(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), max(len(x), len(y)) < 4 * LOW)


def _linked(x: bytes, y: bytes) -> bool:
    s, t = np.frombuffer(x, U), np.frombuffer(y, U)
    common = len(s) + len(t) - len(np.union1d(s, t))
    return 100 * common >= 80 * (len(s) + len(t) - common)


def _blocks_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: cell, cid, half, n, signature, shingles. Of each class of half 1 the first class of half 0 that it links with."""

    def settle(rows: list[tuple]) -> list[tuple[int, int]]:
        main, odd = [r for r in rows if r[2] == 0], [r for r in rows if r[2] == 1]
        if not main or not odd:
            return []
        n, sig = np.array([r[3] for r in main]), np.frombuffer(b"".join(r[4] for r in main), np.uint8).reshape(-1, WIDE // 2)
        low, high = sig & 15, sig >> 4
        out = []
        for _, cid, _, size, mark, held in odd:
            own = np.frombuffer(mark, np.uint8)
            agree = (low == (own & 15)).sum(axis=1) + (high == (own >> 4)).sum(axis=1)
            j = np.flatnonzero((agree >= AGREE) & (5 * np.minimum(n, size) >= 4 * np.maximum(n, size)))
            if not len(j):
                continue
            s, flat = np.frombuffer(held, U), np.frombuffer(b"".join(main[k][5] for k in j), U)
            same = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
            common = np.add.reduceat(same, np.cumsum(n[j]) - n[j], dtype=np.int64)
            hit = j[100 * common >= 80 * (n[j] + size - common)]
            if len(hit):
                other = main[hit[0]][1]
                out.append((min(cid, other), max(cid, other)))
        return out

    held: list[tuple] = []
    for batch in batches:
        got = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if held and held[0][0] != row[0]:
                got += settle(held)
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])
    got = settle(held)
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])


def _against_components(asks: DataFrame, comp: DataFrame, sets: DataFrame, parts: int, small) -> DataFrame:
    """asks: a (class), b (component). Links between the class and any member of the component, one for each block of members at most.

    A component's members and those that ask for it are dealt as blocks of about SETS, whose pairs meet in a cell.
    """
    asked = asks.groupBy("b").agg(F.ceil(F.count("*") / SETS).cast("int").alias("n_odd"))
    size = comp.groupBy("comp").agg(F.ceil(F.count("*") / SETS).cast("int").alias("n_main")).select(F.col("comp").alias("b"), "n_main")
    shape = small(asked.join(small(size), "b"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j: F.xxhash64("b", i, j)
    mine = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    main = comp.withColumnRenamed("comp", "b").join(shape, "b").withColumn("_i", mine("n_main")).select("cid", F.lit(0).alias("half"), F.explode(F.transform(upto(F.col("n_odd")), lambda j: cell(F.col("_i"), j))).alias("cell"))
    odd = asks.withColumnRenamed("a", "cid").join(shape, "b").withColumn("_j", mine("n_odd")).select("cid", F.lit(1).alias("half"), F.explode(F.transform(upto(F.col("n_main")), lambda i: cell(i, F.col("_j")))).alias("cell"))
    rows = main.unionByName(odd).join(sets, "cid").select("cell", "cid", "half", "n", "sig", "shingles")
    return rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_blocks_linked, "a long, b long")


def _passing(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """Pairs a, b whose members' column passes the test. The side with more repeats (a) is joined last, so that AQE may split its hot keys."""
    held = lambda name, as_: sets.select(F.col("cid").alias(name), F.col(column).alias(as_))
    return pairs.join(held("b", "_y"), "b").join(held("a", "_x"), "a").select("a", "b", "_x", "_y").mapInArrow(_tested(test), "a long, b long")


def groups(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links of similarity 0.8 or more), kept.

    Null and empty texts have no shingles, link with nothing and are kept. Rows of one id with different texts are nodes of their own that
    share the id. Null ids never name a component unless nothing else does; rows whose component has no id are kept.
    broadcast_rows: tables of a few longs a row are sent to all executors up to so many rows (none: BROADCAST_ROWS); more are joined by shuffle.
    """
    spark = docs.sparkSession
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    with Scratch(spark) as kept, Scratch(spark, passing=True) as scratch:
        rows = kept.write(map_texts(docs, lambda t: sketch(t, words), "n long, cls binary, keys array<long>", id_col, text_col))
        classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("keys").alias("keys"))
        classes = kept.write(classes.withColumn("cid", F.monotonically_increasing_id()))

        left, right = F.slice("keys", 1, SIDE), F.slice("keys", SIDE + 1, SIDE)
        cells = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.xxhash64(a, b))))
        bands = classes.select("cid", F.posexplode(cells).alias("t", "key")).select("cid", F.col("t").cast("short").alias("t"), F.xxhash64("t", "key").alias("key"))
        shared = bands.groupBy("key").agg(F.min("cid").alias("lo"), F.count("*").alias("size")).where("size > 1")
        members = scratch.write(bands.join(matched(shared), "key"))
        lead = F.max(F.when(F.col("lo") != F.col("cid"), F.struct("c", (-F.col("lo")).alias("lo")))).alias("lead")
        active = members.groupBy("cid", "lo").agg(F.count("*").alias("c")).groupBy("cid").agg(lead).join(matched(classes.select("cid", "cls", "first_id")), "cid")
        active = scratch.write(active)
        n_active = active.count()
        merged = None
        if n_active:
            small = lambda df: matched(df, n_active, broadcast_rows)
            sets = scratch.write(_sets(docs, active, words, id_col, text_col, small))
            if sets.count() > n_active:  # rows of one id and text
                sets = scratch.write(sets.dropDuplicates(["cid"]))
            release(spark)
            merged = _merged(spark, scratch, kept, members, active, sets, small, broadcast_rows, n_active)
    release(spark)
    by_class = classes.select("cls", "cid", "first_id")
    if merged is not None:
        mine = by_class.select("cid", "first_id").join(small(merged), "cid")
        least = mine.groupBy("comp").agg(F.min("first_id").alias("_least"))
        named = mine.join(least, "comp").select("cid", "_least")
        by_class = by_class.join(named, "cid", "left").withColumn("first_id", F.coalesce("_least", "first_id"))
    out = rows.select("doc_id", "n", "cls").join(by_class.select("cls", F.col("first_id").alias("component_id")), "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _merged(spark, scratch: Scratch, kept: Scratch, members: DataFrame, active: DataFrame, sets: DataFrame, small, broadcast_rows: int, n_active: int) -> DataFrame | None:
    """cid and comp of the classes that have a link; None if no class has."""
    comp = tested = None
    parts = 4 * shuffle_partitions(spark)
    large = not members.where(F.col("size") > CELL).isEmpty()
    for mode in ("star", "best", "all"):
        links = None
        if mode == "star":
            pairs = active.where(F.col("lead.c") >= STRONG).select((-F.col("lead.lo")).alias("a"), F.col("cid").alias("b"))
        else:
            signed = sets.select("cid", "n", "sig", *["pk"] * (mode == "all"))
            release(spark)
            seen = scratch.write(_candidates(scratch, members, signed, comp, mode, parts, small, broadcast_rows, large))
            pairs = scratch.write(seen.where("not whole").select("a", "b").join(tested, ["a", "b"], "left_anti"))
            asks = seen.where("whole").select("a", "b").distinct()
            if comp is not None and not asks.isEmpty():
                links = scratch.write(_against_components(asks, comp, sets, parts, small))
        n_pairs = pairs.count()
        tested = pairs if tested is None else tested.unionByName(pairs)
        if mode != "star" and n_pairs:
            pairs = _passing(pairs, sets, "low", _likely)
        found = scratch.write(_passing(pairs, sets, "shingles", _linked)) if n_pairs else links
        if n_pairs and links is not None:
            found = found.unionByName(links)
        if found is None:
            continue  # a later round may still hold untested pairs
        n_pairs = max(n_pairs, found.count())
        if found.isEmpty():
            continue
        if comp is None:
            comp = scratch.write(components(found).withColumnRenamed("node", "cid"), n_pairs)
            continue
        # contracted: the components of the components that the new links join
        to = lambda c, name: comp.select(F.col("cid").alias(c), F.col("comp").alias(name))  # noqa: E731, B023
        ends = found.join(small(to("a", "_a")), "a", "left").join(small(to("b", "_b")), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = scratch.write(components(sized(ends, n_pairs)), n_pairs)
        old = comp.join(small(joined.select(F.col("node").alias("comp"), F.col("comp").alias("_to"))), "comp", "left").select("cid", F.coalesce("_to", "comp").alias("comp"))
        new = joined.join(small(comp.select(F.col("cid").alias("node"))), "node", "left_anti").select(F.col("node").alias("cid"), "comp")
        comp = scratch.write(old.unionByName(new), n_active)
    return None if comp is None else kept.write(comp)


def _candidates(scratch: Scratch, members: DataFrame, signed: DataFrame, comp: DataFrame | None, mode: str, parts: int, small, broadcast_rows: int, large: bool) -> DataFrame:
    """Distinct pairs (a < b), alike by signature and size, of classes that share a cell and are in different components. large: some cell has over CELL members."""
    m = members
    if comp is None:
        m = m.withColumn("comp", F.col("cid"))
    else:
        of = lambda c, name: small(comp.select(F.col("cid").alias(c), F.col("comp").alias(name)))
        m = m.join(of("cid", "_c"), "cid", "left").withColumn("comp", F.coalesce("_c", "cid")).drop("_c")
        lead = m.join(of("lo", "_l"), "lo", "left").withColumn("_l", F.coalesce("_l", "lo"))
        open_ = scratch.write(lead.where("comp <> _l").select("key").distinct())  # a cell with a member outside its least member's component
        m = m.join(matched(open_, open_.count(), broadcast_rows), "key")
    rows = m.where(F.col("size") <= CELL).select(F.col("key").alias("cell"), "cid", "comp", F.lit(2).alias("half"), "t")
    if large:  # written, as the blocks read them three times and would plan all of the joins above as often
        rows = rows.unionByName(_blocks(scratch.write(m.where(F.col("size") > CELL))))
    rows = rows.join(matched(signed), "cid").select("cell", "cid", "comp", "n", "half", "t", *[c for c in signed.columns if c not in ("cid", "n")])
    found = rows.repartition(parts, "cell").sortWithinPartitions("cell", "cid").mapInArrow(_cells(mode), "a long, b long, whole boolean")
    return found.distinct() if mode == "best" else found


def _blocks(large: DataFrame) -> DataFrame:
    """Cells of over CELL members as cells of bounded size that hold all pairs of different components together.

    A cell's main component (of most members) never meets itself: its blocks meet the blocks of the others, and these meet each other.
    """
    side = CELL // 2
    counts = large.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("_m"), F.sum("c").alias("_all"))
    m = large.join(main, "key")
    own = F.col("comp") == F.col("_m")["comp"]
    n_main, n_odd = F.ceil(F.col("_m")["c"] / side).cast("int"), F.ceil((F.col("_all") - F.col("_m")["c"]) / side).cast("int")
    m = m.select("key", "cid", "comp", "t", own.alias("own"), n_main.alias("n_main"), n_odd.alias("n_odd")).where("n_odd > 0")
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("own"), F.col("n_main")).otherwise(F.col("n_odd"))).cast("int")
    m = m.withColumn("_blk", mine)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    put = lambda kind, i, j, half: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("cell"), half.cast("int").alias("half"))
    as_main = F.transform(upto(F.col("n_odd")), lambda j: put("main", F.col("_blk"), j, F.lit(0)))
    as_odd = F.transform(upto(F.col("n_main")), lambda i: put("main", i, F.col("_blk"), F.lit(1)))
    odd = F.transform(upto(F.col("n_odd")), lambda j: put("odd", F.least("_blk", j), F.greatest("_blk", j), F.when(j == F.col("_blk"), 2).when(F.col("_blk") < j, 0).otherwise(1)))
    return m.select("cid", "comp", "t", F.explode(F.when(F.col("own"), as_main).otherwise(F.concat(as_odd, odd))).alias("_p")).select("_p.cell", "cid", "comp", "_p.half", "t")


def _sets(docs: DataFrame, active: DataFrame, words: int, id_col: str, text_col: str, small) -> DataFrame:
    """cid, n, signature, partial keys, least hashes and sorted shingle hashes of each active class, made again from the text of its first document.

    Ids may repeat with other texts, so the class is checked on the digest; repeated rows give repeated rows.
    """
    wanted = active.select(F.col("first_id").alias("_id"), F.col("cls").alias("_cls"), "cid")
    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("text")).join(small(wanted), F.col("_d").eqNullSafe(F.col("_id")))
    texts = texts.select(F.struct("cid", F.col("_cls").alias("cls")).alias("_d"), "text")

    def run(t: list[bytes]) -> dict[str, list]:
        sets = shingle_sets(t, words)
        full = [s for s in sets if len(s)]
        sig, pk = iter(signatures(full)), iter(partial_keys(full).astype(np.uint32))
        return {"found": [digest(s) for s in sets], "n": [len(s) for s in sets], "sig": [next(sig).tobytes() if len(s) else None for s in sets], "pk": [next(pk).tobytes() if len(s) else None for s in sets], "low": [low_hashes(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    made = map_texts(texts, run, "found binary, n long, sig binary, pk binary, low binary, shingles binary", "_d", "text", "_d")
    return made.where("found = _d.cls").select("_d.cid", "n", "sig", "pk", "low", "shingles")
