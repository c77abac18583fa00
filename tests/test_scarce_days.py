"""Ties of rounding in scarce_days: means of breadth are multiples of small fractions, so some lie half-way at the last digit."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quantloom.plans import catalog, lab_queries

SF = "/root/testdata/sf0.01"


def test_ties_round_as_in_sql(spark):
    values = [0.5103125, 0.5016875, 0.4492125, 0.5146875, 0.1, 0.0, -0.5103125, 1 / 3, None]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double").orderBy("i")
    assert [r.y for r in rows.select(lab_queries.scaled_round(F.col("x"), 6).alias("y")).collect()] == want


def test_scarce_days_with_ties(spark):
    """Five of these days' means are ties at the sixth digit."""
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES["scarce_days"]).df().sort_values("moment").reset_index(drop=True)
    got = catalog.QUERIES["scarce_days"](spark, SF).toPandas().sort_values("moment").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, rtol=1e-9, atol=1e-9)
