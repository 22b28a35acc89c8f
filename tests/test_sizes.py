"""What larger tables showed: rounding, rows held by one task, plans."""

from pyspark.sql import functions as F

from foliospark.functions import numbers
from foliospark.plans.queries import QUERIES


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_a_loss_just_below_a_half_is_rounded_down_as_in_sql(spark, tmp_path):
    spark.range(19997, 20000).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(QUERIES["training_history"](spark, str(tmp_path)).where("run = 3"), "epoch", "loss") == [(4999, 0.0001)]
    halves = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (None,)], "x double")
    assert rows(halves, numbers.rounded(F.col("x"), 0), numbers.rounded(F.col("x"), 2)) == [(3.0, 2.5), (-3.0, -2.5), (0.0, 0.13), (None, None)]


def test_a_page_of_words_gives_the_lines_of_its_words(spark):
    from foliospark.operators import layout
    from foliospark.sources import views

    sf = "/root/testdata/sf0.001"
    pages, words = layout.cluster_pages(views.page_words(spark, sf)), layout.cluster_lines(views.words(spark, sf))
    key = lambda df: df.groupBy(*layout.PAGE).agg(F.sum(F.xxhash64("word_ordinal", "line_no", "x0", "text").cast("decimal(38,0)")).alias("s"))
    assert key(pages.select(*layout.PAGE, F.inline("words"))).exceptAll(key(words)).count() == 0
    assert layout.page_blocks(pages).exceptAll(layout.line_blocks(words)).count() == 0


def test_words_are_placed_and_clustered_without_a_shuffle_of_words(spark):
    for name in ("cluster_lines", "block_agg", "sort_words", "scan_digital_page", "approx_word_boxes"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 2 and "_lambda" not in plan and "collect_list" not in plan, name  # documents for texts and for page counts
    toks = spark.createDataFrame([(["ab", "", "c"],), ([],), (None,)], "t array<string>")
    from foliospark.functions.text import starts

    assert rows(toks.select(F.coalesce(starts(F.col("t")), F.array().cast("array<int>")))) == [([0, 3, 4],), ([],), ([],)]


def written(path):
    return {d.name.split("=")[1]: "\n".join(f.read_text().rstrip("\n") for f in sorted(d.glob("part-*"))) for d in path.glob("document_id=*")}


def test_a_payload_is_written_by_lines_of_a_page_at_most(spark, tmp_path):
    import json

    from foliospark.plans.model import Model
    from foliospark.sources import files

    m = Model.of(spark, "/root/testdata/sf0.001")
    files.write_toon_lines(m.payload_lines, f"{tmp_path}/t")
    files.write_toon_lines(m.payload_lines.withColumn("line", F.lit("x")), f"{tmp_path}/t")  # kept: already written
    whole = {r["document_id"]: json.loads(r["toon"]) for r in m.payloads.collect()}
    got = written(tmp_path / "t")
    assert {d: json.loads(t) for d, t in got.items()} == whole
    pages = m.pages.count()
    assert sum(line.lstrip(",").startswith('{"page_number":') for t in got.values() for line in t.split("\n")) == pages


def test_chunks_are_written_to_few_files(spark, tmp_path):
    import json

    from foliospark.sources import files

    ks = spark.range(400).select(F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("document_id"), F.concat(F.lit("ch_"), F.lpad((F.col("id") / 20).cast("int").cast("string"), 3, "0")).alias("chapter_id"), F.col("id").alias("chunk_no"), F.lit("t").alias("text"))
    files.write_chunks(ks.repartition(8), f"{tmp_path}/k")
    got = {d: [json.loads(x) for x in t.split("\n")] for d, t in written(tmp_path / "k").items()}
    assert {d: [(r["chapter_id"], r["chunk_no"]) for r in v] for d, v in got.items()} == {f"d{p}": [(f"ch_{i // 20:03d}", i) for i in range(p, 400, 2)] for p in (0, 1)}
    assert len(list((tmp_path / "k").rglob("part-*"))) <= 2 * 4
    plan = QUERIES["sink_chunks_jsonl"](spark, "/root/testdata/sf0.001")
    assert len(plan.inputFiles()) <= 20 * 4


def test_audits_read_no_text_of_chunks(spark):
    plan = QUERIES["anti_orphan_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    sorts = [line for line in plan.split("\n") if "Exchange hashpartitioning(document_id" in line or "Project [" in line and "_i" in line]
    assert sorts and not any("text#" in line for line in sorts)


def test_only_candidates_meet_their_chapter(spark):
    from foliospark.operators import structure

    r = spark.createDataFrame([("d", 1, 1, "BODY", "1.1 One"), ("d", 1, 2, "BODY", "plain"), ("d", 1, 3, "SUBHEADING", "Two")], "document_id string, page_number bigint, reading_order bigint, type string, text string")
    pages = r.select("document_id", "page_number").distinct()
    got = structure.section_candidates(r, structure.detect_chapters(r, pages), pages)
    assert sorted(rows(got, "title")) == [("1.1 One",), ("Two",)]
    joins = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1:]
    assert "RLIKE" in joins[0]  # below the join


def test_tokens_are_counted_without_regexp_count(spark):
    from foliospark.functions import text

    t = spark.createDataFrame([(" a  b\tc ",), ("",), (" \n",), (None,), ("one",)], "t string")
    count = t.select(text.token_count(F.col("t")).alias("n"), F.size(text.tokens(F.col("t"))).alias("m"))
    assert [(r["n"], r["m"]) for r in count.collect()][:3] == [(3, 3), (0, 0), (0, 0)] and all(r["n"] == r["m"] for r in count.collect())
    plan = QUERIES["extraction_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan and "regexp_extract_all" not in plan
