"""Token-bounded chunks of a chapter's text, with one unit of overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, token_count
from .layout import FURNITURE
from .structure import active_sections

CHAPTER = ["document_id", "chapter_id"]


def units(regions: DataFrame, pages: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """Regions that are not furniture or blank, with their chapter, section, tokens and order key."""
    active = active_sections(pages, chapters, sections)
    r = regions.where(~F.col("type").isin(*FURNITURE)).where(strip(F.col("text")) != "")
    return r.join(active, ["document_id", "page_number"]).select(*CHAPTER, "page_number", "reading_order", "region_id", "section_id", strip(F.col("text")).alias("text"), token_count(F.col("text")).alias("tokens"))


def assign_chunks(us: DataFrame, least: int = 300, most: int = 800, overlap: int = 50) -> DataFrame:
    """The units with unit_no (from 0 in their chapter), chunk_no (from 1) and whether they are also carried into the next chunk.

    A chunk closes before a unit that would take it over `most`, or that is in another section, once it has `least` tokens. If it has two units or
    more, its last one also opens the next chunk. The fold sees only (order, tokens, section) of one chapter and gives the places of the splits;
    units are dealt by chapter once, for their number, their split and their chunk.
    """
    key = F.struct("page_number", "reading_order", "region_id", "tokens", F.coalesce("section_id", F.lit("")).alias("sec"))
    u = us.groupBy(*CHAPTER).agg(F.array_sort(F.collect_list(key)).alias("us"))
    kind = "struct<i:int,tokens:bigint,n:int,last:bigint,sec:string,splits:array<struct<at:int,carried:boolean>>>"
    start = F.expr(f"cast(named_struct('i', 0, 'tokens', 0L, 'n', 0, 'last', 0L, 'sec', '', 'splits', cast(array() as array<struct<at:int,carried:boolean>>)) as {kind})")

    def step(acc: Column, x: Column) -> Column:
        split = (acc["i"] > 0) & (acc["tokens"] >= least) & ((acc["tokens"] + x["tokens"] > most) | (x["sec"] != acc["sec"]))
        carry = split & (acc["n"] > 1) if overlap > 0 else F.lit(False)
        kept, n = F.when(carry, acc["last"]).when(split, F.lit(0)).otherwise(acc["tokens"]), F.when(carry, 1).when(split, 0).otherwise(acc["n"])
        splits = F.when(split, F.concat(acc["splits"], F.array(F.struct(acc["i"].alias("at"), carry.alias("carried"))))).otherwise(acc["splits"])
        return F.struct((acc["i"] + 1).alias("i"), (kept + x["tokens"]).alias("tokens"), (n + 1).alias("n"), x["tokens"].alias("last"), x["sec"].alias("sec"), splits.alias("splits")).cast(kind)

    splits = u.select(*CHAPTER, F.aggregate("us", start, step, lambda a: a["splits"]).alias("_splits"))
    at = F.row_number().over(Window.partitionBy(*CHAPTER).orderBy("page_number", "reading_order", "region_id")) - 1
    rows = us.withColumn("_at", at).join(splits, CHAPTER)
    chunk_no = F.size(F.filter("_splits", lambda s: s["at"] <= F.col("_at"))) + 1
    carried = F.exists("_splits", lambda s: (s["at"] == F.col("_at") + 1) & s["carried"])
    return rows.select(*us.columns, F.col("_at").cast("long").alias("unit_no"), chunk_no.cast("long").alias("chunk_no"), carried.alias("carried"))


def chunk_members(assigned: DataFrame) -> DataFrame:
    """Units of each chunk, carried ones in both."""
    both = F.when(F.col("carried"), F.array(F.col("chunk_no"), F.col("chunk_no") + 1)).otherwise(F.array(F.col("chunk_no")))
    return assigned.withColumn("chunk_no", F.explode(both)).drop("carried")


def build_chunks(assigned: DataFrame) -> DataFrame:
    m = chunk_members(assigned)
    part = F.struct("unit_no", "region_id", "text", "section_id")
    c = m.groupBy(*CHAPTER, "chunk_no").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.sum("tokens").alias("token_count"))
    return c.select(
        *CHAPTER, "chunk_no", F.concat(F.col("chapter_id"), F.format_string("_chk_%04d", "chunk_no")).alias("chunk_id"), F.element_at("p", -1)["section_id"].alias("section_id"), "page_start", "page_end",
        F.transform("p", lambda x: x["region_id"]).alias("source_regions"), "token_count", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"),
    )


def chunk(regions: DataFrame, pages: DataFrame, chapters: DataFrame, sections: DataFrame, least: int = 300, most: int = 800, overlap: int = 50) -> DataFrame:
    return build_chunks(assign_chunks(units(regions, pages, chapters, sections), least, most, overlap))
