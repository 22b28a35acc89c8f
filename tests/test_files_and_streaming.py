"""Round trips through files, and streaming ingestion."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import manifest
from foliospark.plans.model import Model
from foliospark.sources import files, views
from foliospark.sources.service import Service
from foliospark.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_pages_and_payload_round_trip(spark, tmp_path):
    m = Model.of(spark, SF)
    some = m.ordered.where("page_number <= 2")
    files.write_pages(some, f"{tmp_path}/pages")
    back = files.read_pages(spark, f"{tmp_path}/pages")
    assert back.count() == some.select("document_id", "page_number").distinct().count()
    assert back.select(F.sum(F.size("regions"))).first()[0] == some.count()
    assert back.where("_corrupt is not null or page_id is null").count() == 0
    toons = manifest.toon_payload(m.manifest, m.chapters, m.sections, m.chunks, some)
    files.write_toon(toons, f"{tmp_path}/toon")
    files.write_toon(toons.withColumn("toon", F.lit("{}")), f"{tmp_path}/toon")  # kept: already written
    kept = spark.read.text(f"{tmp_path}/toon").withColumnRenamed("value", "toon")
    assert kept.count() == toons.count() and manifest.validate_toon(kept, m.manifest).where("not valid").count() == 0
    files.append_errors(spark.createDataFrame([(1, "x")], "page int, error string"), f"{tmp_path}/errors")
    files.append_errors(spark.createDataFrame([(2, "y")], "page int, error string"), f"{tmp_path}/errors")
    assert spark.read.json(f"{tmp_path}/errors").count() == 2


def test_store_listing_and_ids(spark, tmp_path):
    for n in ("b/2.bin", "a/1.bin"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    assert [r[0] for r in files.list_keys(spark, str(tmp_path)).collect()] == ["a/1.bin", "b/2.bin"]
    assert [r[0] for r in files.list_keys(spark, str(tmp_path), "b/").collect()] == ["b/2.bin"]
    assert all(len(r["document_id"]) == 20 for r in files.content_ids(files.scan_files(spark, str(tmp_path))).collect())


def test_object_store(spark, tmp_path):
    s = files.Store(spark, str(tmp_path))
    s.put("a/1.bin", b"\x00\xff old")
    s.put("a/1.bin", b"\x00\xff")
    s.put_json("/a/2.json", {"é": [1]})
    assert s.get("a/1.bin") == b"\x00\xff" and s.get_json("a/2.json") == {"é": [1]}
    assert (tmp_path / "a" / "2.json").read_text() == '{\n  "é": [\n    1\n  ]\n}'
    assert [r[0] for r in s.keys("a/").collect()] == ["a/1.bin", "a/2.json"]
    assert s.exists("a/1.bin") and s.delete("a/1.bin") and not s.exists("a/1.bin") and not s.delete("a/1.bin") and not s.delete("a")
    with pytest.raises(FileNotFoundError):
        s.get("a/1.bin")
    with pytest.raises(ValueError):
        s.put("../x", b"")


def test_service(spark, tmp_path):
    s = Service(spark, str(tmp_path))
    asked = spark.createDataFrame([("a.pdf",), ("z.pdf",)], "document_id string")
    assert {r["status"] for r in s.status(asked).collect()} == {"not_found"}
    s.submit(spark.createDataFrame([("a.pdf", 5, "%PDF", 2), ("b.txt", 5, "%PDF", 2)], "filename string, size bigint, head string, page_count bigint"))
    assert {(r["document_id"], r["status"]) for r in s.status(asked).collect()} == {("a.pdf", "queued"), ("z.pdf", "not_found")}


def test_streaming_equals_batch(spark, tmp_path):
    pages = views.quality_pages(spark, SF).drop("doc_id")
    pages.write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{n} {t}" for n, t in pages.dtypes)
    ingest.score_pages(ingest.read_pages_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    from foliospark.operators.quality import page_quality

    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(page_quality(pages)).count() == 0 and spark.read.parquet(f"{tmp_path}/out").count() == pages.count()


def test_yaml_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# top\na:\n  b: 1  # one\n  c: [x, 2.5]\n  d:\n  - 1\n  - two\ne: 'x # y'\nf: ~\ng:\n  h: true\n")
    got = files.read_config(spark, str(tmp_path / "c.yaml"))
    assert got["a"] == {"b": 1, "c": ["x", 2.5], "d": [1, "two"]} and got["f"] is None and got["g"] == {"h": True}
    (tmp_path / "c.json").write_text('{"vocab": ["<blank>", "a"]}')
    assert files.read_vocabulary(spark, str(tmp_path / "c.json"), []) == ["<blank>", "a"]
    assert files.read_vocabulary(spark, str(tmp_path / "none.json"), ["x"]) == ["x"]
