"""From raw documents to packed training sequences.

Each stage takes the documents that the one before kept, written as Parquet and read
again, and hands on rows with the same columns; the last returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import jaccard, langid, mixing, packing, quality
from quantloom.llm.staging import discard, stage
from quantloom.llm.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that are boilerplate of their source. Columns of docs
    that are named like the rules' own come back as they were."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    judged = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("_"), *others).alias("_others"))
    # The row number keeps the optimizer from copying the rules' expressions into the filter.
    kept = quality.quality(judged).withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    back = {c: F.col(f"_others.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "source": F.col("source")}
    if "n_chars" in back:
        changed = ~F.col("kept_text").eqNullSafe(F.col("text"))
        back["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(back["n_chars"])
    return kept.select(*(back[c].alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; a text that is null or has no letter goes."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group that links join. Rows without an id take part: they are
    the last of their group, and those that no link joins stay."""
    return jaccard.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, whole each time."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; every document that comes in is in them, a repeated one as often as it does."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
#: Language scores and tokenizer ids are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences from the table documents. What a stage wrote is deleted when the next one has written; an empty table
    gives no pieces."""
    docs, written = table(spark, sf_dir, "documents"), None
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{number}")
            if written is not None:
                discard(written)
            written = docs
    return docs
