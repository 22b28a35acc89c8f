"""The whole document model as a chain of DataFrames, each step replaceable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, chunk, digital, layout, manifest, ocr, quality, structure
from ..sources import files, views
from ..sources.stage import stage

Step = Callable[..., DataFrame]


@dataclass
class Steps:
    """The parts of the chain; pass others to replace them."""

    analyze: Step = quality.page_quality
    digital: Step = digital.page_words
    scanned: Step = ocr.baseline_blocks
    detect: Step = layout.detect_regions
    order: Step = layout.reading_order
    normalize: Step = layout.normalize
    chapters: Step = structure.detect_chapters
    sections: Step = structure.detect_sections
    chunks: Step = chunk.chunk
    audit: Step = audit.metrics
    payload: Step = manifest.toon_payload
    payload_lines: Step = manifest.toon_lines
    overlay: Step = files.overlay_labels


STAGES = ("pages", "ordered", "chapters", "sections", "chunks")


@dataclass
class Model:
    """blocks, tables, images: content with coordinates by document_id and page_number. Everything else follows on first use.

    Regions, chapters, sections and chunks are stages: each is computed once, and what follows reads it.
    """

    blocks: DataFrame
    tables: DataFrame
    images: DataFrame
    steps: Steps = field(default_factory=Steps)
    chunk_tokens: tuple[int, int, int] = (300, 800, 50)
    #: Called with a stage's name, how many are done and how many there are, after each.
    progress: Callable[[str, int, int], None] | None = None
    done: list[str] = field(default_factory=list)

    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        out = stage(df)
        if name not in self.done:
            self.done.append(name)
            if self.progress:
                self.progress(name, len(self.done), len(STAGES))
        return out

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **kw) -> Model:
        sheets = stage(views.sheets(spark, sf_dir))
        return cls(views.blocks(spark, sf_dir, sheets), views.tables(spark, sf_dir, sheets), views.images(spark, sf_dir, sheets), **kw)

    @classmethod
    def from_content(cls, pages: DataFrame, words: DataFrame, boxes: DataFrame, tables: DataFrame, images: DataFrame, steps: Steps | None = None, factor: tuple[float, float] = (1.0, 1.0), **kw) -> Model:
        """Blocks from the words of digital pages (in page units), and from the line boxes of all others (in pixels), as the analysis routes each page."""
        steps = steps or Steps()
        routed = steps.analyze(pages).select(*layout.PAGE, "route")
        routed = stage(routed)
        of = lambda df, digital_: df.join(routed.where((F.col("route") == "DIGITAL_TEXT") == digital_).select(*layout.PAGE), layout.PAGE, "left_semi")
        sized = of(words, True).join(pages.select(*layout.PAGE, "width", "height"), layout.PAGE)
        read = layout.line_blocks(layout.cluster_lines(steps.digital(sized)))
        seen = steps.scanned(ocr.numbered_lines(of(boxes, False)), *factor)
        columns = [*layout.PAGE, F.col("line_no").cast("long").alias("ord"), "text", "avg_font_size", "x0", "y0", "x1", "y1"]
        return cls(stage(read.select(*columns).unionByName(seen.select(*columns))), tables, images, steps, **kw)

    @property
    def labels(self) -> DataFrame:
        return self.steps.overlay(self.ordered)

    @cached_property
    def pages(self) -> DataFrame:
        return self._stage("pages", self.blocks.select("document_id", "page_number").distinct())

    @cached_property
    def regions(self) -> DataFrame:
        return self.steps.detect(self.blocks, self.tables, self.images)

    @cached_property
    def ordered(self) -> DataFrame:
        return self._stage("ordered", self.steps.normalize(self.steps.order(self.regions)))

    @cached_property
    def chapters(self) -> DataFrame:
        return self._stage("chapters", self.steps.chapters(self.ordered, self.pages))

    @cached_property
    def sections(self) -> DataFrame:
        return self._stage("sections", self.steps.sections(self.ordered, self.chapters, self.pages))

    @cached_property
    def chunks(self) -> DataFrame:
        return self._stage("chunks", self.steps.chunks(self.ordered, self.pages, self.chapters, self.sections, *self.chunk_tokens))

    @cached_property
    def manifest(self) -> DataFrame:
        return manifest.manifest(self.pages, self.pages.limit(0), self.chapters, self.sections, self.chunks)

    @cached_property
    def payloads(self) -> DataFrame:
        return self.steps.payload(self.manifest, self.chapters, self.sections, self.chunks, self.ordered)

    @cached_property
    def payload_lines(self) -> DataFrame:
        return self.steps.payload_lines(self.manifest, self.chapters, self.sections, self.chunks, self.ordered)

    @property
    def _audited(self) -> tuple[DataFrame, ...]:
        return self.pages, self.pages, self.ordered, self.chapters, self.sections, self.chunks

    @cached_property
    def details(self) -> DataFrame:
        return stage(audit.details(*self._audited))

    @cached_property
    def messages(self) -> DataFrame:
        return audit.messages(self.details, self.pages, self.chapters, self.sections)

    @cached_property
    def reports(self) -> DataFrame:
        made = self.details
        m = made.select("document_id", *[F.col(at).alias(name) for name, at in audit.METRICS.items()])
        return audit.reports(made, audit.recommendations(m), self.messages)

    @cached_property
    def audit(self) -> DataFrame:
        return self.steps.audit(self.pages, self.pages, self.ordered, self.chapters, self.sections, self.chunks)


class Damaged(Model):
    """The model with planted structural errors, for the audit. They are planted while the sound stages are read, so that an audit reads only the columns it needs: no text is written or sorted again."""

    @cached_property
    def _sound(self) -> Model:
        return Model(self.blocks, self.tables, self.images, self.steps, self.chunk_tokens)

    @cached_property
    def ordered(self) -> DataFrame:
        ro = F.when(F.col("region_no") % 29 == 0, 1).otherwise(F.col("reading_order")).cast("long")
        return self._sound.ordered.where("page_number % 3 <> 0 or type <> 'HEADING'").withColumn("reading_order", ro)

    @cached_property
    def chapters(self) -> DataFrame:
        no = F.col("chapter_no")
        number = F.when(no % 7 == 0, F.col("number") - 1).when(no % 5 == 0, F.col("number") + 5).otherwise(F.col("number"))
        return self._sound.chapters.withColumns({"number": number, "page_end": F.when(no % 9 == 0, F.col("page_start") - 1).otherwise(F.col("page_end"))})

    @cached_property
    def sections(self) -> DataFrame:
        i = F.row_number().over(Window.partitionBy("document_id").orderBy("chapter_id", "section_no"))
        s = self._sound.sections.withColumn("_i", i)
        return s.select(
            "document_id", "chapter_id", "section_no", F.when(F.col("_i") % 6 == 0, "dup").otherwise(F.col("section_id")).alias("section_id"), "title",
            (F.col("page_start") - F.when(F.col("_i") % 4 == 0, 1).otherwise(0)).alias("page_start"), (F.col("page_end") + F.when(F.col("_i") % 5 == 0, 4).otherwise(0)).alias("page_end"),
        )

    @cached_property
    def chunks(self) -> DataFrame:
        c = self._sound.chunks.withColumn("_i", F.row_number().over(Window.partitionBy("document_id").orderBy("chapter_id", "chunk_no")))
        ch = F.when(F.col("_i") % 11 == 0, F.lit(None).cast("string")).when(F.col("_i") % 13 == 0, "ch_999").otherwise(F.col("chapter_id"))
        return c.select("document_id", ch.alias("chapter_id"), "chunk_no", "chunk_id", "section_id", "page_start", (F.col("page_end") + F.when(F.col("_i") % 5 == 0, 7).otherwise(0)).alias("page_end"), "source_regions", (F.col("token_count") % 97).alias("token_count"), "text")


def profile_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(quality.page_quality(views.quality_pages(spark, sf_dir)))
