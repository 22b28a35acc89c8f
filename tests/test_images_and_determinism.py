import numpy as np
from pyspark.sql import functions as F

from foliospark.functions import images
from foliospark.plans.model import Model
from foliospark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_image_steps():
    rgb = np.zeros((100, 50, 3), np.uint8)
    rgb[..., 0] = 100
    g = images.gray(rgb)
    assert g.shape == (100, 50) and g[0, 0] == 30
    assert images.crop_border(g).shape == (96, 48)
    b = images.pad_batch([np.zeros((32, 33)), np.zeros((32, 40))])
    assert b.shape == (2, 32, 40) and b[0, 0, 39] == 1.0


def test_recogniser_is_pluggable(spark):
    d = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", bytearray(b""))], "path string, image binary")
    got = {r["path"]: (r["text"], r["confidence"]) for r in images.recognize(d, lambda: lambda batch: [(x.decode(), 0.9) for x in batch]).collect()}
    assert got == {"a": ("xyz", 0.9), "b": ("", 0.9)}


def test_results_do_not_depend_on_partitions(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, QUERIES["chunk_agg"](spark, SF).collect()), key=str)

    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_steps_can_be_replaced(spark):
    m = Model.of(spark, SF)
    m.steps.order = lambda r: r.withColumn("reading_order", F.col("region_no"))
    assert m.ordered.where("reading_order <> region_no").count() == 0
