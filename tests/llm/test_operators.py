"""The ten operators against brute force on small inputs, and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, licenses, minhash, mixing, pii, quality, sharding, simhash, suffixes, toxicity
from foliospark.llm.components import components

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside.
CLASH = ("_b", "n", "h", "fp", "cls", "size", "score", "spans", "t1", "key", "copies", "unit", "cid", "_t")


def docs(spark, texts, source="s", ids=None):
    rows = [(i if ids is None else ids[k], t, "en", source if isinstance(source, (str, type(None))) else source[k], len(t or "")) for k, (i, t) in enumerate(zip(range(len(texts)), texts, strict=True))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return d.select("*", *[F.lit("x").alias(c) for c in CLASH])


LONG = "alpha beta gamma delta " * 4000
ODD = [None, "", " ", "\n\n", "one", "a b c d", "a b c d", "é ü ß … 漢字 🙂 x", LONG, "The quick, brown fox. " * 30, None, ""]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# 1 SimHash


def brute_edited(texts):
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 4
        nxt = texts[(i + 1) % len(texts)]
        out.append(t[: len(t) - k] + nxt[:k])
    return out


def test_simhash_edits_match_brute_force(spark, sample):
    rows = sorted((r["doc_id"], r["text"] or "") for r in sample.select("doc_id", "text").collect())
    want = brute_edited([t for _, t in rows])
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(sample).collect()}
    assert len(got) == len(rows)
    own = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(sample, ["doc_id"]).collect()}
    for (i, t), e in zip(rows, want, strict=True):
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == f"{own[i] & (2**64 - 1):016x}"
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.15


def spark_hash(*strings):
    h = 42
    for x in strings:
        h = xxhash.xxh64_intdigest(x.encode(), seed=h)
    return h


def brute_fingerprint(text):
    """Every term votes on all 64 bits, one by one."""
    words = re.split(r"[\x20\x09-\x0D]+", text)
    votes, total = [0] * 64, 0
    for a, b in zip(["", *words], words):  # noqa: B905
        if b:
            w, h = min(16, len(a) + len(b)) ** 2, spark_hash(a, b)
            total += w
            for k in range(64):
                votes[k] += w * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * votes[k] > total)


def test_fingerprints_match_brute_force(spark, sample):
    texts = [r["text"] for r in sample.limit(40).collect()] + ODD
    d = docs(spark, texts)
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(d, ["doc_id"]).collect()}
    assert got == {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    rows = simhash.edited_fingerprints(d).collect()
    for r, e in zip(sorted(rows, key=lambda r: r["doc_id"]), brute_edited([t or "" for t in texts]), strict=True):
        own, edited, after = got[r["doc_id"]], brute_fingerprint(e), got[(r["doc_id"] + 1) % len(texts)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{own:016x}", f"{edited:016x}")
        assert (r["near_edited"], r["near_next"]) == (1 - (own ^ edited).bit_count() / 64, 1 - (own ^ after).bit_count() / 64)


def test_simhash_takes_ids_of_other_types(spark):
    d = docs(spark, ["b b", "a a", "c c"]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = sorted(simhash.edited_fingerprints(d).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == ["d0", "d1", "d2"]


def test_simhash_odd_rows(spark):
    got = sorted(simhash.edited_fingerprints(docs(spark, ODD)).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for t in ODD]
    assert [r["n_chars"] for r in got] == [len(t) for t in texts]
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(e.encode()).hexdigest() for e in brute_edited(texts)]
    by = {}
    for r, t in zip(got, texts, strict=True):
        assert by.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1
    assert by[""] == "0" * 16
    assert simhash.edited_fingerprints(docs(spark, [])).count() == 0
    one = simhash.edited_fingerprints(docs(spark, ["abcdefgh"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def test_simhash_search_finds_all_within_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), r)) for b in base for r in (1, 2, 3, 4)] + base[:5]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    d = spark.createDataFrame(list(enumerate(signed)) + [(9999, None)], "doc_id bigint, fp bigint")
    got = {(r["doc_id"], r["near_fp"]) for r in simhash.search(d.where("doc_id % 50 = 0"), d, 3).collect()}
    want = {(i, s) for i in range(0, len(fps), 50) for f, s in zip(fps, signed, strict=True) if bin(fps[i] ^ f).count("1") <= 3}
    assert got == want


# 2 quality


def test_rules_compile_to_what_they_hold(spark, sample):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.4)).astype(float)
    m = quality.fit(x, y)
    z = m.bias + sum(w * r.holds(x) for w, r in m.rules)
    assert ((1 / (1 + np.exp(-z)) >= 0.5) == y).mean() > 0.97 and 0 < len(m.rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{s} double" for s in quality.STATS))
    got = [r[0] for r in df.select(quality.compile_rules(m)).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z[:50])))


def test_quality_held_out_and_odd_rows(spark, labels):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ls = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = quality.train(d, ls)
    held = quality.score(d, m).join(ls, "doc_id").where(quality.held_out(F.col("doc_id"), 4, 2)).select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in held]) > 0.9
    odd = quality.score(docs(spark, ODD), m).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    none = quality.train(d, ls.limit(0))
    assert none.rules == [] and quality.score(docs(spark, []), none).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    assert quality.train(d, nulls).rules == []


def test_held_out_is_crc32(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"] for r in d.where(quality.held_out(F.col("doc_id"), 4, 2)).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


# 3 toxicity


def test_toxicity_learns_words_and_locates_sentences(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}x" for _ in range(300)]
    texts, marks = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            sentences[2] += " vexgrump" + rng.choice(["er", "ing", "ed"])
        texts.append(". ".join(sentences) + ".")
        marks.append(int(bad))
    d = docs(spark, texts)
    ls = spark.createDataFrame([(i, 1, y) for i, y in enumerate(marks)] + [(7, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    m = toxicity.train(d, ls)
    got = {r["doc_id"]: r for r in toxicity.score(d, m).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, y in enumerate(marks))
    s = got[0]["sentences"]
    assert len(s) == 1 and "vexgrump" in texts[0][s[0]["from"] : s[0]["to"]]
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, ODD), m).collect()}
    assert odd[0] == odd[1] == 0.0 and all(0 <= v <= 1 for v in odd.values())
    assert toxicity.train(d, ls.where("toxic = 0")).weights == {}
    assert toxicity.score(docs(spark, []), m).count() == 0


@pytest.mark.parametrize("train", [toxicity.train, quality.train])
def test_training_takes_one_row_an_id(spark, train):
    many = [f"good words number {i % 7} here." for i in range(6000)]
    d = docs(spark, [*many, *[f"bad nastyword {i}." for i in range(30)]], ids=[5] * 6000 + list(range(100, 130)))
    ls = spark.createDataFrame([(5, 0, 0)] + [(i, i % 2, i % 2) for i in range(100, 130)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.training_rows(d, ls, "toxic", 5, 0, 10).collect()
    assert len(rows) <= 10
    every = toxicity.training_rows(d, ls, "toxic", 5, 9, 1000).collect()
    assert len(every) == 31 and sum(r["text"].startswith("good") for r in every) == 1
    train(d, ls, max_rows=10)


def test_training_sentences_are_bounded():
    index = {f: i for i, f in enumerate(toxicity.stems("nasty") + toxicity.stems("awful"))}
    got = toxicity._bags([b"nasty. awful nasty. plain. nasty"] * 2, index, 2)
    assert got["sentences"] == [4, 4] and [len(b) for b in got["bags"]] == [2, 2]
    assert got["bags"][0][0] == sorted(index.values())


def brute_toxicity(model, text):
    """Noisy-or over the sentences, feature by feature."""
    clean = 1.0
    for part in re.split(r"[.!?\n]+", text.lower()):
        words = set(part.split())
        if words:
            z = model.bias + sum(w for f, w in model.weights.items() if any(f in toxicity.stems(x) for x in words))
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_toxicity_scores_match_noisy_or(spark, sample, labels):
    m = toxicity.train(sample, labels)
    assert m.weights
    got = {r["doc_id"]: r["score"] for r in toxicity.score(sample, m).collect()}
    for r in sample.limit(60).collect():
        assert abs(got[r["doc_id"]] - brute_toxicity(m, r["text"] or "")) < 1e-9


# 4 mixing


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return capped | target
        capped |= {s: most * sizes[s] for s in over}


def test_mixing_targets_and_counts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    d = d.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("source")))
    a = mixing.per_row(mixing.mix(d, [5.0, 2.0, 1.0])).toPandas()
    b = mixing.per_row(mixing.mix(d.repartition(7), [5.0, 2.0, 1.0])).toPandas()
    key = ["doc_id", "copies"]
    assert a[key].sort_values(key, ignore_index=True).equals(b[key].sort_values(key, ignore_index=True))
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in d.collect()}
    assert a.set_index("doc_id")["size"].to_dict() == words
    a["src"] = a["source"].where(a["source"].notna(), None)
    sizes = Counter()
    for s, n in zip(a["src"], a["size"], strict=True):
        sizes[None if s != s else s] += n
    want = brute_targets(dict(sizes), [5.0, 2.0, 1.0], 1.5, 2.0)
    for s, t in want.items():
        rows = a[a["src"].isna()] if s is None else a[a["src"] == s]
        assert np.allclose(rows["target"], t)
        assert abs((rows["size"] * rows["copies"]).sum() - t) <= max(0.05 * t, rows["size"].max())
        # duels keep the sum of the copies' expectations
        own = sizes[s]
        assert abs(rows["copies"].sum() - (rows["size"] > 0).sum() * t / own) < 1 + 1e-6 if own else rows["copies"].sum() == 0
    assert a["copies"].between(0, 2).all()


def test_mixing_odd_rows(spark):
    odd = docs(spark, ODD, source=[None, "a", "b", None, "a", "b", "b", "a", "c", "c", None, "a"])
    got = mixing.per_row(mixing.mix(odd, [5.0, 2.0, 1.0])).collect()
    assert len(got) == len(ODD) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    named = mixing.mix(odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), [5.0, 2.0, 1.0])
    assert {r["doc_id"] for r in named.collect()} == {f"d{i}" for i in range(len(ODD))}
    assert mixing.mix(docs(spark, []), [5.0]).count() == 0


def test_mixing_repeated_rows_are_one_unit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 50)
    same = docs(spark, ["x y z"] * 301 + ["u v"], ids=[1] * 301 + [None])
    units = mixing.mix(same, [1.0])
    assert sorted(r["n_rows"] for r in units.collect()) == [1, 301]
    rows = mixing.per_row(units).collect()
    assert len(rows) == 302 and {r["copies"] for r in rows} <= {1, 2}
    assert abs(sum(r["copies"] for r in rows) - 453) <= 1


# 5 sharding


def brute_shard(node, key):
    """Descends by the least of -ln(u) / weight."""
    while node.children:
        u = [((spark_hash(c.name, key) >> 11) + 0.5) * 2.0**-53 for c in node.children]
        draws = [(-math.log(x) / c.weight, i) for i, (x, c) in enumerate(zip(u, node.children, strict=True))]
        node = node.children[min(draws)[1] if len(draws) > 1 else 0]
    return node.shard


def test_shards_match_brute_force_descent(spark, sample):
    for root in (sharding.tree(16), sharding.tree(11, 3, 2, {4: 3.0, 7: 0.5})):
        grown = sharding.grow(root, 99, 2.0)
        for r in sharding.assign(sample, root, grown).collect():
            assert (r["shard"], r["grown_shard"]) == (brute_shard(root, str(r["doc_id"])), brute_shard(grown, str(r["doc_id"])))


def test_place_keeps_the_rows(spark):
    d = docs(spark, ODD, ids=[None, 1, 1, 2, 3, 4, 4, None, 6, 7, 8, 9])
    got = sharding.place(d, sharding.tree(4))
    assert got.columns == [c for c in d.columns if c not in sharding.COLUMNS] + list(sharding.COLUMNS)
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in d.collect())
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    narrow = sharding.assign(d, sharding.tree(4)).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in narrow) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)


def test_sharding_growth_and_slots(spark, sample):
    root = sharding.tree(16)
    got = sharding.assign(sample, root, sharding.grow(root, 16)).toPandas()
    assert len(got) == sample.count()
    assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == 16)).all() and got["shard"].between(0, 15).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in sample.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.bytes == len(texts[r.doc_id]) + 1 for r in got.rename(columns={"size": "bytes"}).itertuples())


def test_sharding_weights_and_confined_moves(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = sharding.tree(8), sharding.tree(8, weights={1: 3.0})
    both = ids.select("doc_id", sharding.descend(a, F.col("doc_id")).alias("x"), sharding.descend(b, F.col("doc_id")).alias("y")).toPandas()
    assert abs((both["y"] == 1).mean() - 0.3) < 0.02 and abs((both["x"] == 1).mean() - 0.125) < 0.02
    moved = both[both["x"] != both["y"]]
    assert (moved["y"] < 4).all()  # only into the rack whose weight grew


def test_sharding_odd_rows(spark):
    root = sharding.tree(16)
    got = sharding.assign(docs(spark, ODD, ids=[None, 1, 1, None, 2, 3, 3, 4, 5, 6, 7, 8]), root).collect()
    assert len(got) == len(ODD) and all(r["grown_shard"] is None and r["law"] == "key" for r in got)
    assert sharding.assign(docs(spark, []), root).count() == 0


# 6 MinHash


def brute_groups(rows, k):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_copies(n=120, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(220)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    passage = " ".join(base[:60])
    out += [f"u{rng.randrange(10**6)} {passage} " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(n)]
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_groups_match_brute_force(spark, sample, k):
    rows = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies())] + [(2000, "A b C"), (2001, "a B c"), (2002, ""), (2003, None), (2004, "a b")]
    d = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    got = {r["doc_id"]: r for r in minhash.groups(d, k).collect()}
    want = brute_groups(rows, k)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_minhash_small_cells_give_the_same(spark, monkeypatch):
    d = docs(spark, near_copies())
    want = {(r["doc_id"], r["component_id"]) for r in minhash.groups(d, 5).collect()}
    monkeypatch.setattr(minhash, "CELL", 16)
    assert {(r["doc_id"], r["component_id"]) for r in minhash.groups(d, 5, broadcast_rows=0).collect()} == want


def test_minhash_plans_blocks_for_large_cells_only(spark, monkeypatch):
    d, calls, blocks = docs(spark, near_copies(30)), [], minhash._blocks
    monkeypatch.setattr(minhash, "_blocks", lambda large: calls.append(1) or blocks(large))
    want = {(r["doc_id"], r["component_id"]) for r in minhash.groups(d, 5).collect()}
    assert not calls
    monkeypatch.setattr(minhash, "CELL", 8)
    assert {(r["doc_id"], r["component_id"]) for r in minhash.groups(d, 5).collect()} == want and calls


def test_minhash_sends_few_rows_to_all_executors(spark, monkeypatch):
    d, sent, broadcast = docs(spark, near_copies(30)), [], minhash.F.broadcast
    want = {(r["doc_id"], r["component_id"]) for r in minhash.groups(d, 5).collect()}
    monkeypatch.setattr(minhash.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 10)
    assert {(r["doc_id"], r["component_id"]) for r in minhash.groups(d, 5).collect()} == want
    assert all(n <= 10 for n in sent)


def test_minhash_odd_rows(spark):
    got = minhash.groups(docs(spark, ODD, ids=[None, 1, 1, 2, 3, 4, 4, None, 6, 7, 8, 9]), 5).collect()
    assert len(got) == len(ODD) and all(r["kept"] is not None for r in got)
    assert minhash.groups(docs(spark, []), 5).count() == 0


def pair_behind_decoys():
    """Two sets of words of similarity 0.8, and unlike sets that are in every table cell where the two meet."""
    rng = np.random.default_rng(3)
    sets, names = [], [f"w{i}" for i in range(400)]
    hashes = np.array([s[0] for s in minhash.shingle_sets([w.encode() for w in names], 1)])
    for _ in range(20_000):
        x = rng.permutation(400)[:20]
        sets += [np.sort(hashes[x[:18]]), np.sort(hashes[x[2:]])]
    keys = minhash.partial_keys(sets)
    same = keys[::2] == keys[1::2]
    left, right = same[:, : minhash.SIDE].sum(1), same[:, minhash.SIDE :].sum(1)
    k = int(np.argmax((left > 0) & (right > 0) & (left + right <= 4)))
    assert left[k] and right[k] and left[k] + right[k] <= 4
    pair = [sets[2 * k], sets[2 * k + 1]]
    held = [f for t in np.flatnonzero(same[k]) for f in range(t * minhash.PER, (t + 1) * minhash.PER)]
    values = [minhash.minhashes([s], 0, minhash.HASHES)[0, held] for s in (*pair, *[np.array([h]) for h in hashes])]
    least, each = values[0], np.array(values[2:])
    core = [i for i in range(400) if (each[i] == least).any()]
    # words that would take over none of the pair's minimums
    free = [i for i in range(400) if hashes[i] not in pair[0] and hashes[i] not in pair[1] and (minhash.minhashes([np.sort(np.append(pair[0], hashes[i]))], 0, minhash.HASHES)[0, held] == least).all()]
    decoys = [core + list(rng.permutation(free)[: 20 - len(core)]) for _ in range(12)]
    got = minhash.partial_keys([np.sort(hashes[d]) for d in decoys])
    assert (got[:, same[k]] == keys[2 * k][same[k]]).all()
    word = dict(zip(hashes.tolist(), names, strict=True))
    return [" ".join(word[h] for h in s.tolist()) for s in pair], [" ".join(names[i] for i in d) for d in decoys]


def test_minhash_goes_on_after_a_round_without_pairs(spark):
    pair, decoys = pair_behind_decoys()
    texts = decoys + pair
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(docs(spark, texts), 1).collect()}
    assert got == brute_groups(list(enumerate(texts)), 1)
    assert got[len(texts) - 1][1] == len(texts) - 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 100), (103, 103)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(40)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {k: parent[k] for k in got} == got and got[50] == 0


# 7 suffixes


def brute_removed(texts):
    seen = Counter(t[j : j + 200] for t in texts for j in range(len(t) - 199))
    out = []
    for t in texts:
        m = np.zeros(len(t) + 1, int)
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                m[j] += 1
                m[j + 200] -= 1
        m = np.cumsum(m)[:-1] > 0
        starts = int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
        out.append((len(t), int(m.sum()), starts, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def test_suffix_order_is_lexicographic():
    rng = random.Random(1)
    for trial in range(30):
        x = [rng.randrange(1, rng.choice([2, 3, 200])) for _ in range(rng.randrange(1, 300))]
        x = np.array((x + x[: len(x) // 2] + x if trial % 3 == 0 else x) + [0], np.uint8)
        b = x.tobytes()
        got = suffixes.suffix_order(x)
        assert sorted(got.tolist()) == list(range(len(b)))
        assert [b[i : i + 200] for i in got] == sorted(b[i : i + 200] for i in range(len(b)))


@pytest.mark.parametrize("kw", [{}, {"hot": 1, "broadcast_keys": 0}])
def test_repeats_match_brute_force(spark, kw):
    rng = random.Random(9)
    part = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    p = [part(260), part(199), part(200), part(700)]
    texts = ["", None, part(50), p[0], p[0] + part(90), part(300) + p[1] + part(20), p[1], p[2], part(10) + p[2] + part(10), "The " * 200, "x" * 500, part(40) + p[3] + part(40) + p[3], p[3][100:500] + part(60)]
    texts += ["copy " * 60 + p[0]] * 3 + ["y" + p[0] + str(i) * 150 for i in range(8)]
    got = sorted(suffixes.remove_repeats(docs(spark, texts), **kw).collect(), key=lambda r: r["doc_id"])
    want = brute_removed([(t or "").encode() for t in texts])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want


def test_repeats_odd_rows(spark):
    got = suffixes.remove_repeats(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


# 8 decontamination


def brute_hits(texts, items):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    win = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in win:
                    hit |= set(range(j, j + n))
                    own |= win[tuple(w[j : j + n])]
        out.append((len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("distributed", [False, True])
def test_decontamination_matches_brute_force(spark, distributed):
    rng = random.Random(4)
    item = lambda n: " ".join(f"q{rng.randrange(50)}" for _ in range(n))
    items = [(1, item(40)), (2, item(10)), (3, item(3)), (4, "Tie"), (5, ""), (6, None), (10, item(14)), (11, item(9))]
    items += [(12, items[0][1])]
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    texts = [filler(30), filler(20) + ", " + items[0][1][:60].upper() + " " + filler(9), items[1][1], filler(5) + " " + items[2][1] + "! " + filler(5), "x tie y", items[7][1] + " " + items[6][1], "a,b;c", *ODD, items[0][1]]
    d = docs(spark, texts)
    got = sorted(decontaminate.find(d, spark.createDataFrame(items, "item_id bigint, text string"), distributed=distributed).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got] == brute_hits(texts, items)
    none = decontaminate.find(d, spark.createDataFrame([], "item_id bigint, text string"), distributed=distributed).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] for r in none)
    assert decontaminate.find(docs(spark, []), spark.createDataFrame(items, "item_id bigint, text string"), distributed=distributed).count() == 0


# 9 PII


def brute_pii(s):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_plain_spans_match_the_patterns():
    rng = random.Random(8)
    alphabet = "ab1290.@+-_% ()x\n"
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        assert pii.plain(s) == brute_pii(s), s
    s = "mail a.b@c-d.org, 10.0.0.1 and 300.1.1.1; 4111 1111 1111 1111 or +1 (555) 555-1234"
    assert pii.plain(s) == brute_pii(s) and all(pii.plain(s).values())


@pytest.mark.parametrize(
    ("s", "kind", "what"),
    [
        ("write to joe.doe [at] example [dot] com now", "email", "joe.doe [at] example [dot] com"),
        ("write to joe at example dot com now", "email", "joe at example dot com"),
        ("joe＠example．com", "email", "joe＠example．com"),
        ("jоe＠example.com", "email", "jоe＠example.com"),
        ("call +four nine three zero one two three four five six seven today", "phone", "+four nine three zero one two three four five six seven"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("192​.168.0.1", "ip", "192​.168.0.1"),
    ],
)
def test_pii_disguises(s, kind, what):
    base, added = pii.spans(s)
    found = [s[a:b] for a, b in base[kind] + added[kind]]
    assert found == [what]
    assert base == pii.plain(s)


@pytest.mark.parametrize("around", ["host is {} now", "mail joe@example.com, host is {} now", "{}"])
@pytest.mark.parametrize(
    "what",
    ["10 dot 0 dot 0 dot 1", "192 DOT 168  dot 0 dot 254", "10.0 dot 0.1", "10 dot zero dot 0 dot one", "one nine two dot one six eight dot 0 dot 1", "one dot two dot three dot 4", "10 point 0 point 0 point 1", "１０ dot 0 dot 0 dot 1"],
)
def test_pii_spelled_dots_do_not_need_an_at(what, around):
    s = around.format(what)
    base, added = pii.spans(s)
    assert [s[a:b] for a, b in added["ip"]] == [what]
    assert base == pii.plain(s) and not base["ip"]


def test_pii_dots_between_words_are_left():
    for s in ("a dot b dot c dot d", "connect the dot 1 to dot 2", "see 999 dot 0 dot 0 dot 1", "version 1 dot 2 dot 3"):
        assert not any(pii.spans(s)[1].values())
    for s in ("1 dot " * 40_000, "one " * 50_000, "one dot " * 30_000, "1 point one " * 20_000):
        pii.spans(s)


def test_pii_base_digest_over_documents(spark, sample):
    got = {r["doc_id"]: r for r in pii.scan(sample).collect()}
    for r in sample.collect():
        want = brute_pii(r["text"] or "")
        line = ",".join(f"{k}:{a}:{b}" for k in ("email", "ip", "card", "phone") for a, b in want[k])
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [g[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [len(want[k]) for k in ("email", "ip", "card", "phone")]
        assert {x for x in line.split(",") if x} <= set(g["spans"].split(","))


def test_pii_long_and_odd(spark):
    for s in ("1" * 200_000, "a" * 200_000, "a." * 100_000, "1." * 100_000, "+1" * 50_000, "@" * 50_000):
        pii.spans(s)
    got = pii.scan(docs(spark, [*ODD, "x@y.zz", "x@y.zz"])).collect()
    assert [r["n_email"] for r in sorted(got, key=lambda r: r["doc_id"])][-2:] == [1, 1]
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[0]["spans"] == ""
    assert pii.scan(docs(spark, [])).count() == 0


# 10 licences


def test_licences_match_brute_force(spark, sample):
    extra = ["MIT License", "the mit-license; Apache\tLicense General public LICENSE mit license", "mit", "license mit", "mit x license", licenses.TEMPLATES["bsd"][0].upper(), licenses.TEMPLATES["mit"][0] + " but not all", "Licensed under CC BY-NC 4.0.", *ODD]
    texts = [r["text"] for r in sample.collect()] + extra
    got = sorted(licenses.scan(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(got, texts, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    own = [r["labels"] for r in got[-len(extra) :]]
    assert own[5] == "bsd" and own[6] == "mit" and own[7] == "cc-by-nc"


def brute_notices(text, need=0.6):
    """Labels and score of the notices: every place that an anchor votes for is tried."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, score = set(), 0.0
    for name, posts in licenses.anchors().items():
        votes = Counter(i - p for i, x in enumerate(w) for a, p in posts if a == x)
        if not votes:
            continue
        best = max(votes.values())
        place = min(p for p, n in votes.items() if n == best)
        template, keys = licenses.TEMPLATES[name]
        own = template.split()

        def stands(key):
            k = key.split()
            at = next(i for i in range(len(own)) if own[i : i + len(k)] == k)
            return any(w[j : j + len(k)] == k and abs(j - place - at) <= licenses.SLACK for j in range(len(w)))  # noqa: B023

        if best >= max(2, math.ceil(need * len(posts))) and all(map(stands, keys)):
            labels.add(name.split("/")[0])
            score = max(score, best / len(posts))
    return labels, score


def test_licence_notices_match_brute_force(spark):
    rng = random.Random(12)
    texts = [*ODD]
    for name, (t, keys) in licenses.TEMPLATES.items():
        w = t.split()
        pad = lambda n: [f"x{rng.randrange(99)}" for _ in range(n)]
        texts += [t, " ".join(pad(30) + w + pad(5)), " ".join(w[: len(w) // 2]), " ".join(w[::-1]), " ".join(w[: len(w) // 2] + pad(3) + w[len(w) // 2 :]), " ".join(w + pad(40) + w)]
        texts += [keys[0], " ".join(x for x in w if x not in keys[-1].split()) + " ".join(pad(60)) + keys[-1]]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_notices(t)
        base = {x for x in got[i]["base_labels"].split(",") if x}
        assert got[i]["labels"] == ",".join(sorted(labels | base)), t
        assert abs(got[i]["score"] - (1.0 if base else score)) < 1e-9
    assert all(name.split("/")[0] in got[len(ODD) + 8 * k]["labels"].split(",") for k, name in enumerate(licenses.TEMPLATES))


def test_licences_empty(spark):
    assert licenses.scan(docs(spark, [])).count() == 0
