"""Readers of the corpus tables; only the asked columns are scanned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_mod(doc_id: str, n: int):
    """crc32 of the id's text, modulo n: the fold of a row."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))
