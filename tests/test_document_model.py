"""The fixed examples of the document model, with exact results."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.functions import geometry, text
from foliospark.operators import audit, chunk, digital, layout, manifest, quality, recognition, structure
from foliospark.plans.model import Model
from foliospark.sources import files

P = "document_id string, page_number bigint, "


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_page_quality_thresholds(spark):
    good = "Mechanics of materials studies how solid bodies carry loads without failing. " * 4
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0, 0, good), ("d", 2, 612.0, 792.0, 1, ""), ("d", 3, 612.0, 792.0, 1, "T h i s i s b a d"), ("d", 4, 612.0, 792.0, 0, None)], P + "width double, height double, image_count bigint, raw_text string")
    q = {r["page_number"]: r for r in quality.page_quality(pages).collect()}
    assert q[1]["text_quality_score"] >= 0.70 and q[1]["route"] == "DIGITAL_TEXT"
    assert q[2]["text_quality_score"] == 0 and q[2]["route"] == "SCANNED_OR_IMAGE_ONLY" and not q[2]["text_layer_available"]
    assert q[3]["text_quality_score"] < 0.70 and q[3]["route"] == "POOR_TEXT_LAYER"
    assert q[4]["text_character_count"] == 0
    p = quality.profile(quality.page_quality(pages)).first()
    assert (p["page_count"], p["text_layer_pages"], p["poor_text_pages"], p["zero_text_pages"], p["image_pages"]) == (4, 1, 1, 2, 2)


def test_layout_types(spark):
    blocks = spark.createDataFrame(
        [("d", 1, 0, "MECHANICS", 10.0, 72.0, 20.0, 200.0, 32.0), ("d", 1, 1, "Introduction", 18.0, 72.0, 100.0, 300.0, 120.0), ("d", 1, 2, "Body text of a page", 11.0, 72.0, 140.0, 540.0, 152.0), ("d", 1, 3, "12", 10.0, 300.0, 760.0, 310.0, 770.0),
         ("d", 1, 4, "Figure 1: beam", 11.0, 72.0, 200.0, 300.0, 212.0), ("d", 1, 5, "F = (m + a)", 11.0, 72.0, 230.0, 300.0, 242.0), ("d", 1, 6, "  ", 11.0, 72.0, 250.0, 300.0, 262.0)],
        P + "ord bigint, text string, avg_font_size double, x0 double, y0 double, x1 double, y1 double",
    )
    got = dict(rows(layout.classify_blocks(blocks), "ord", "type"))
    assert got == {0: "HEADER", 1: "HEADING", 2: "BODY", 3: "PAGE_NUMBER", 4: "CAPTION", 5: "EQUATION"}


def regions_of(spark, rs):
    return spark.createDataFrame([("d", p, n, f"r{n:03d}", t, x, *b) for p, n, t, x, b in rs], P + "region_no bigint, region_id string, type string, text string, x0 double, y0 double, x1 double, y1 double").withColumn("confidence", F.lit(0.95))


def test_two_column_reading_order(spark):
    r = regions_of(spark, [
        (1, 5, "BODY", "right 1", (320.0, 150.0, 540.0, 200.0)), (1, 1, "HEADER", "head", (72.0, 20.0, 540.0, 30.0)), (1, 2, "HEADING", "title", (72.0, 80.0, 540.0, 110.0)),
        (1, 3, "BODY", "left 1", (72.0, 150.0, 290.0, 200.0)), (1, 4, "BODY", "left 2", (72.0, 220.0, 290.0, 260.0)), (1, 6, "PAGE_NUMBER", "1", (300.0, 760.0, 310.0, 770.0)),
    ])
    got = [x[0] for x in sorted(rows(layout.reading_order(r), "text", "reading_order"), key=lambda x: x[1])]
    assert got == ["head", "title", "left 1", "left 2", "right 1", "1"]


def test_strict_order_drops_regions_beside_wide_ones(spark):
    r = regions_of(spark, [(1, 1, "HEADING", "wide", (72.0, 100.0, 540.0, 200.0)), (1, 2, "BODY", "beside", (72.0, 150.0, 290.0, 160.0)), (1, 3, "BODY", "left", (72.0, 300.0, 290.0, 310.0)), (1, 4, "BODY", "right", (320.0, 300.0, 540.0, 310.0))])
    assert {x[0] for x in rows(layout.reading_order(r), "text")} == {"wide", "left", "right"}
    assert {x[0] for x in rows(layout.reading_order(r, strict=False), "text")} == {"wide", "beside", "left", "right"}


def structure_pages(spark):
    lines = [(1, "Chapter 1: Introduction", "HEADING"), (1, "1.1 Scope", "SUBHEADING"), (2, "1.2 Units", "SUBHEADING"), (2, "plain words", "BODY"), (3, "CHAPTER II", "HEADING"), (3, "2.1 Loads", "SUBHEADING")]
    r = spark.createDataFrame([("d", p, i, i, t, x) for i, (p, x, t) in enumerate(lines, 1)], P + "region_no bigint, reading_order bigint, type string, text string")
    return r, r.select("document_id", "page_number").distinct()


def test_chapters_and_sections(spark):
    r, pages = structure_pages(spark)
    ch = structure.detect_chapters(r, pages)
    assert rows(ch.orderBy("chapter_no"), "chapter_id", "number", "title", "page_start", "page_end") == [("ch_001", 1, "Introduction", 1, 2), ("ch_002", 2, "Chapter 2", 3, 3)]
    s = structure.detect_sections(r, ch, pages)
    assert rows(s.orderBy("section_id"), "section_id", "title", "page_start", "page_end") == [("ch_001_s001", "1.1 Scope", 1, 1), ("ch_001_s002", "1.2 Units", 2, 2), ("ch_002_s001", "2.1 Loads", 3, 3)]
    assert rows(structure.active_sections(pages, ch, s).orderBy("page_number"), "section_id") == [("ch_001_s001",), ("ch_001_s002",), ("ch_002_s001",)]


def test_no_chapters_falls_back_to_one(spark):
    r = spark.createDataFrame([("d", 4, 1, 1, "BODY", "words"), ("d", 7, 1, 1, "BODY", "words")], P + "region_no bigint, reading_order bigint, type string, text string")
    ch = structure.detect_chapters(r, r.select("document_id", "page_number"))
    assert rows(ch, "chapter_id", "page_start", "page_end", "confidence", "detection_method") == [("ch_001", 4, 7, 0.5, "fallback_single_chapter")]


def test_chunks_split_and_overlap(spark):
    words = " ".join(["w"] * 30)
    us = spark.createDataFrame([("d", "ch_001", 1, i, f"r{i:03d}", "ch_001_s001", words, 30) for i in (1, 2, 3)], "document_id string, chapter_id string, page_number bigint, reading_order bigint, region_id string, section_id string, text string, tokens bigint")
    c = chunk.build_chunks(chunk.assign_chunks(us, 20, 50, 5)).orderBy("chunk_no")
    # 30 + 30 > 50 closes with one unit (nothing carried) each time.
    assert rows(c, "chunk_id", "token_count", "section_id") == [(f"ch_001_chk_{i:04d}", 30, "ch_001_s001") for i in (1, 2, 3)]
    c = chunk.build_chunks(chunk.assign_chunks(us, 20, 60, 5)).orderBy("chunk_no")
    assert [(r["token_count"], list(r["source_regions"])) for r in c.collect()] == [(60, ["r001", "r002"]), (60, ["r002", "r003"])]


def test_audit_good_and_bad(spark):
    r, pages = structure_pages(spark)
    ch = structure.detect_chapters(r, pages)
    s = structure.detect_sections(r, ch, pages)
    ks = "document_id string, chapter_id string, chunk_id string, page_start bigint, page_end bigint, token_count bigint"
    good = spark.createDataFrame([("d", "ch_001", "a", 1, 2, 90), ("d", "ch_002", "b", 3, 3, 90)], ks)
    m = audit.metrics(pages, pages, r, ch, s, good).first().asDict()
    assert all(m[k] == 1.0 for k in m if k.endswith(("hierarchy", "numbering", "integrity", "order", "alignment"))) and m["empty_chapter_rate"] == 0
    bad = spark.createDataFrame([("d", "ch_009", "a", 1, 9, 90), ("d", None, "b", 3, 3, 90)], ks)
    p = audit.parent_child(pages, ch, bad).first()
    assert (p["orphan_chunks"], p["invalid_parent_refs"], p["score"]) == (1, 1, 0.3)
    assert audit.page_boundaries(pages, pages, ch, bad).first()["boundary_violations"] == 1
    said = [x[0] for x in rows(audit.recommendations(audit.metrics(pages, pages, r, ch, s, bad)).orderBy("position"), "recommendation")]
    assert len(said) == 2 and said[0].startswith("Review orphan")


def test_boxes(spark):
    d = spark.createDataFrame([([-12.98, -8.0, 650.92, 792.0],), ([1.0, 2.0, 3.0],)], "b array<double>")
    assert [r[0] for r in d.select(geometry.valid_box(F.col("b"))).collect()] == [[0.0, 0.0, 650.92, 792.0], None]


@pytest.mark.parametrize(("numeral", "value"), [("XIV", 14), ("mcmxciv", 1994), ("7", 7), ("IIX", 10), ("abc", 100), ("?", 1)])
def test_roman(spark, numeral, value):
    assert spark.range(1).select(text.roman_value(F.lit(numeral))).first()[0] == value


def test_greedy_decoding(spark):
    v = recognition.VOCABULARY
    steps = [0, v.index("M"), v.index("M"), 0, v.index("O"), v.index("S"), v.index("S"), 0]
    data = [(0, t, [10.0 if i == k else 0.0 for i in range(len(v))]) for t, k in enumerate(steps)]
    r = recognition.greedy_decode(spark.createDataFrame(data, "sample bigint, t bigint, logits array<float>")).first()
    assert r["text"] == "MOS" and r["confidence"] > 0.9
    assert len(v) == 115


def test_error_rates_are_over_the_corpus(spark):
    p = spark.createDataFrame([("a", "the cat", "the cat"), ("b", "on a mat", "on mat"), ("c", "ü", "u")], "path string, ref string, hyp string")
    r = recognition.error_rates(p).first()
    assert (r["samples"], r["cer"], r["wer"]) == (3, round(3 / 16, 5), round(2 / 6, 5))


def test_history(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 0.5, 1.0), (0, 2, 0.9, 0.2, 1.0), (0, 3, 0.8, 0.2, 1.0), (0, 4, 0.7, 0.04, 0.5), (0, 5, 0.6, 0.1, 0.5)], "run bigint, epoch bigint, loss double, cer double, wer double")
    h = recognition.history(e, 0.05).orderBy("epoch")
    assert rows(h, "is_best", "stopped") == [(True, False), (True, False), (False, False), (True, False), (False, True)]
    assert rows(recognition.best_epoch(e), "epoch") == [(4,)]


def test_uploads(spark):
    u = spark.createDataFrame([(None, 1, "%PDF", 1), ("a.txt", 1, "%PDF", 1), ("a.pdf", 0, "", 1), ("a.PDF", 5, "PK", 1), ("a.pdf", files.MAX_BYTES + 1, "%PDF", 1), ("a.pdf", 5, "%PDF", None), ("a.pdf", 5, "%PDF", 0), ("a.pdf", 5, "%PDF-1.4", 3)], "filename string, size bigint, head string, page_count bigint")
    assert rows(files.upload_verdict(u), "reject_reason", "status_code") == [("no_file", 400), ("extension", 400), ("empty", 400), ("magic", 400), ("too_large", 413), ("unreadable", 400), ("no_pages", 400), (None, 202)]


def test_safe_key():
    assert files.safe_key("/store", "a/b") == "/store/a/b"
    with pytest.raises(ValueError):
        files.safe_key("/store", "../etc/passwd")


def test_partial_run_and_resume(spark):
    pages = spark.createDataFrame([("d", n) for n in range(1, 5)], "document_id string, page_number bigint")
    r = manifest.page_range(pages, 2, 3)
    assert sorted(rows(r)) == [("d", 2, True), ("d", 3, True)]
    assert not manifest.page_range(pages).first()["is_partial_run"]
    assert sorted(rows(manifest.not_cached(pages, pages.where("page_number = 1")))) == [("d", 2), ("d", 3), ("d", 4)]
    assert manifest.not_cached(pages, pages, force=True).count() == 4


def test_one_bad_file_does_not_stop_the_rest(spark):
    fs = spark.createDataFrame([("a", bytearray(b"x y")), ("b", bytearray(b""))], "path string, content binary")

    def parser(data):
        if not data:
            raise ValueError("empty")
        return [{"page_number": 1, "raw_text": data.decode()}]

    got = {r["path"]: r for r in files.parse_documents(fs, parser, "page_number bigint, raw_text string").collect()}
    assert got["a"]["raw_text"] == "x y" and got["b"]["error"] == "empty"


def test_manifest_lines(spark):
    d = spark.createDataFrame([("a.png\thello\tx",), ("# no",), ("",), ("b.png",)], "value string")
    assert rows(files.parse_manifest(d, "/base")) == [("/base/a.png", "hello\tx"), ("/base/b.png", "")]


def test_white_space_of_unicode_counts(spark):
    blocks = spark.createDataFrame(
        [("d", 1, 0, "\t\u2003\n", 11.0, 72.0, 200.0, 300.0, 212.0), ("d", 1, 1, "Page 3\t", 10.0, 72.0, 760.0, 300.0, 770.0), ("d", 1, 2, "\u00a0words\u3000here\u2009", 11.0, 72.0, 230.0, 300.0, 242.0)],
        P + "ord bigint, text string, avg_font_size double, x0 double, y0 double, x1 double, y1 double",
    )
    assert dict(rows(layout.classify_blocks(blocks), "ord", "type")) == {1: "PAGE_NUMBER", 2: "BODY"}
    t = blocks.where("ord = 2").select(text.strip(F.col("text")), text.token_count(F.col("text"))).first()
    assert tuple(t) == ("words\u3000here", 2)
    every = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert sorted(every) == sorted(text.SPACES)


def test_lines_open_at_their_first_word(spark):
    ws = [(1, 10.0, 5.0, "b"), (2, 13.5, 1.0, "a"), (3, 13.6, 0.0, "c"), (4, 17.0, 9.0, "d"), (5, 17.2, 2.0, "e"), (6, 10.0, 7.0, "f")]
    d = spark.createDataFrame([("d", 1, i, t, top, x, x + 1, top + 8, "Times", 11.0) for i, top, x, t in ws], P + "word_ordinal bigint, text string, top double, x0 double, x1 double, bottom double, fontname string, size double")
    got = dict(rows(layout.cluster_lines(d), "word_ordinal", "line_no"))
    assert got == {1: 1, 2: 1, 6: 1, 3: 2, 4: 2, 5: 3}
    assert sorted(rows(layout.line_blocks(layout.cluster_lines(d)), "line_no", "text")) == [(1, "a b f"), (2, "c d"), (3, "e")]


def test_digital_parts_are_put_inside_the_page(spark):
    w = spark.createDataFrame([("d", 1, None, -3.0, 5.0, 120.0, 9.456, 0.0, 100.0, 50.0), ("d", 1, "x", 20.0, 60.0, 10.0, 40.0, 11.239, 100.0, 50.0)], P + "text string, x0 double, top double, x1 double, bottom double, size double, width double, height double")
    assert rows(digital.page_words(w), "text", "x0", "top", "x1", "bottom", "size") == [("", 0.0, 5.0, 100.0, 9.46, None), ("x", 20.0, 50.0, 20.0, 50.0, 11.24)]


def test_pages_from_content_by_route(spark):
    good = "Mechanics of materials studies how solid bodies carry loads without failing. " * 4
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0, 0, good), ("d", 2, 612.0, 792.0, 1, "")], P + "width double, height double, image_count bigint, raw_text string")
    words = spark.createDataFrame([("d", p, i, t, 100.0, 72.0 + 40 * i, 100.0 + 40 * i, 110.0, "Times", 11.0) for p in (1, 2) for i, t in enumerate(["two", "words"])], P + "word_ordinal bigint, text string, top double, x0 double, x1 double, bottom double, fontname string, size double")
    boxes = spark.createDataFrame([("d", p, 20, 400, 200, 20) for p in (1, 2)], P + "x bigint, y bigint, w bigint, h bigint")
    none = "document_id string, page_number bigint, doc_id bigint, x0 double, y0 double, x1 double, y1 double"
    said = []
    m = Model.from_content(pages, words, boxes, spark.createDataFrame([], none + ", data array<array<string>>"), spark.createDataFrame([], none), progress=lambda *a: said.append(a))
    assert sorted(rows(m.ordered, "page_number", "text")) == [(1, "two words"), (2, "[Scanned text line 1]")]
    assert m.chunks.count() == 1 and said[-1] == ("chunks", 5, 5) and len(said) == 5
    assert m.labels.count() == 2


def test_reports_say_what_was_found(spark):
    r, pages = structure_pages(spark)
    ch = structure.detect_chapters(r, pages).withColumn("number", F.lit(1))
    s = structure.detect_sections(r, structure.detect_chapters(r, pages), pages).withColumn("section_id", F.lit("same"))
    ks = spark.createDataFrame([("d", None, 1, "c1", 1, 1, 60), ("d", "ch_001", 2, "c2", 1, 9, 60)], "document_id string, chapter_id string, chunk_no bigint, chunk_id string, page_start bigint, page_end bigint, token_count bigint")
    made = audit.details(pages, pages, r, ch, s, ks)
    m = made.select("document_id", *[F.col(at).alias(n) for n, at in audit.METRICS.items()])
    found = audit.messages(made, pages, ch, s)
    assert "Duplicate chapter numbers found: ['1']" in [x[0] for x in rows(found, "message")]
    files_ = dict(rows(audit.reports(made, audit.recommendations(m), found), "name", "content"))
    assert set(files_) == {"structural_validation.json", "chapter_audit.json", "section_audit.json", "chunk_audit.json", "reading_order_audit.json", "structural_validation.md"}
    md = files_["structural_validation.md"]
    assert md.startswith("# Structural Validation Report — d\n\n## Structural Summary\n") and "- Duplicate Section IDs: 1\n" in md and "- **[WARNING]** Found 1 chunks without a parent chapter ID.\n" in md
    assert json.loads(files_["chunk_audit.json"])["misaligned_chunks"] == 1
