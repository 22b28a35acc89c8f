"""Stages take effect and keep the columns of documents."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from foliospark.llm import mixing, sharding, stages, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        assert docs.columns == columns if i < len(corpus_pipeline.STAGES) - 1 else docs.columns == [*columns, *sharding.COLUMNS]
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]
    assert corpus_pipeline.run(spark, SF).count() == counts[5]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


#: Names that the stages use inside.
CLASH = ("_row", "_u", "_c", "_i", "_s", "_d0", "_d1", "_k", "_from", "_each", "_rest", "unit", "copies", "component_id", "score", "shard", "slot", "size")


def sentence(seed, n=60):
    return " ".join(f"{'bcdfghklmn'[(seed + j) % 10]}{'aeiou'[j % 5]}{seed}x{j}" for j in range(n))


#: Ids that repeat with other texts, and rows without one; 'nastyword' is toxic, LEAK is in the benchmark.
A, B, C, D, E, LEAK = (sentence(s) for s in (1, 2, 3, 4, 5, 6))
ROWS = [
    (1, A), (1, B), (1, f"{C} nastyword"), (2, D), (2, f"{D} more"), (3, D), (4, f"{E} {LEAK}"), (4, sentence(7)), (5, sentence(8)), (5, sentence(8)),
    (None, sentence(9)), (None, sentence(9)), (None, f"{sentence(10)} nastyword"), (None, f"{LEAK} {sentence(11)}"), (None, A), (6, ""), (6, None), (None, None),
]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_deduplicated(rows):
    """Of each row its group (links of similarity 0.8) and shingles; of each group the least id, none last."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 10 * len(a & b) >= 8 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(group[i], []).append((d is None, d or 0))
    return group, sets, {g: min(x) for g, x in least.items()}


def brute_leaks(t, items):
    w, held = (t or "").split(), {tuple(v[i : i + 10]) for v in (x.split() for x in items) for i in range(len(v) - 9)}
    return any(tuple(w[i : i + 10]) in held for i in range(len(w) - 9))


def test_stages_decide_by_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *_: toxicity.Model(-6.0, {f: 12.0 for f in toxicity.stems("nastyword")}))
    spark.createDataFrame([(1, LEAK)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])

    def rows(d):
        assert d.columns == docs.columns and d.where(" or ".join(f"{c} <> 'x'" for c in CLASH)).count() == 0
        return Counter((r["doc_id"], r["text"]) for r in d.collect())

    assert rows(stages.drop_toxic(spark, docs, str(tmp_path))) == Counter(r for r in ROWS if "nastyword" not in (r[1] or ""))
    assert rows(stages.drop_contaminated(spark, docs, str(tmp_path))) == Counter(r for r in ROWS if not brute_leaks(r[1], [LEAK]))

    got = rows(stages.drop_near_duplicates(spark, docs, str(tmp_path)))
    group, sets, least = brute_deduplicated(ROWS)
    assert not got - Counter(ROWS)
    for g in set(group):
        members = [r for r, x in zip(ROWS, group, strict=True) if x == g]
        kept = [r for r in got.elements() if r in members]
        if sets[g]:
            assert len(kept) == 1 and (kept[0][0] is None, kept[0][0] or 0) == least[g]
    assert Counter({r: n for r, n in got.items() if not shingles(r[1])}) == Counter(r for r in ROWS if not shingles(r[1]))


def test_mixing_stage_gives_whole_copies(spark):
    rows = [(i % 6 if i % 7 else None, f"{sentence(i % 5, 9)}", "en", ["a", "b", None][i % 3], 0) for i in range(60)] + [(900, "", "en", "a", 0), (901, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *[F.lit("x").alias(c) for c in CLASH])
    units = {(r["doc_id"], r["source"], r["unit"]): r for r in mixing.mix(docs, stages.MIX_WEIGHTS, stages.MIX_SHARE, stages.MIX_MOST).collect()}
    out = stages.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and out.where(" or ".join(f"{c} <> 'x'" for c in CLASH)).count() == 0
    keyed = out.withColumn("unit_", mixing.unit_key(F.col("doc_id"), F.col("text")))
    got = Counter((r["doc_id"], r["source"], r["unit_"]) for r in keyed.collect())
    assert got == Counter({k: r["copies"] for k, r in units.items() if r["copies"]})
    assert sum(r["n_rows"] for r in units.values()) == len(rows)
    again = stages.mix_sources(spark, docs.repartition(5), "").groupBy("doc_id", "text", "source").count()
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.groupBy("doc_id", "text", "source").count().collect()))


def test_sharding_stage_keeps_documents(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = stages.shard(spark, docs, "")
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in out.collect()) == Counter((i, t, "en", "s") for i, t in ROWS)
    for _, g in out.toPandas().groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_many_rejected_rows_are_not_sent_to_all_executors(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(stages.F, "broadcast", lambda df: sent.append(1) or df)
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id bigint, text string, source string")
    keyed = stages._keyed(docs)
    rejected = spark.range(500_001).select(F.col("id").alias("_row")).unionByName(keyed.where("text is null").select("_row"))
    got = Counter((r["doc_id"], r["text"]) for r in stages._without(keyed, rejected, docs).collect())
    assert got == Counter((i, t) for i, t in ROWS if t is not None) and not sent
