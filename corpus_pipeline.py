"""Training-data pipeline over documents. STAGES: (name, function of (spark, docs, sf_dir)); each stage's result is written and reread as the next one's docs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import common, stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
    ("sharding", stages.shard),
]

#: The learnt and hashed stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet below the shared checkpoint folder. A stage's input is removed once its result is written; the last result stays."""
    at = f"{common.checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:
            common.remove(spark, f"{at}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
