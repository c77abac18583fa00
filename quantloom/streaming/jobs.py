"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import shared_folder


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_bars(trades: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """OHLCV by window; a window is final, and its state dropped, once the watermark passes it.
    Trades later than that are left out (the batch twin has no such limit)."""
    when = F.struct("ts", "event_id")
    return (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", when).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", when).alias("close"),
            F.sum("amount").alias("volume"), F.count("*").alias("trades"),
        )
        .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "trades")
    )


def sliding_sums(trades: DataFrame, width: str = "1 hour", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w")).agg(F.sum("amount").alias("volume"), F.count("*").alias("trades"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))


# Deviations that warn, half as many more are critical; the share of rows whose loss, and of nulls whose presence, is reported.
WARN, DROP, NULLS = 3.0, 0.8, 0.5
ANOMALY = "key string, call long, kind string, severity string, value double, score double"


class RunningAnomaly(StatefulProcessor):
    """Keeps of each key the number, mean and squared deviations of all values so far, and a running number of values a call.

    A call is what has one value of ``call``. Its values are judged against those of the calls before, once these are more than ten, and its number
    against the running one; then both take it in. Calls of one batch come in their order; rows that come later for a call
    are a call of their own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double, rate double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, mean, m2, rate = self.state.get() if self.state.exists() else (0, 0.0, 0.0, None)
        found = []
        for call, values in pd.concat(list(rows)).sort_values(["call", "at"], kind="stable").groupby("call")["value"]:
            deviation = (m2 / n) ** 0.5 if n > 1 else 0.0
            if n > 10 and deviation > 0:
                score = (values - mean).abs() / deviation
                found += [(key[0], call, "zscore", "critical" if z >= 1.5 * WARN else "warning", v, z) for v, z in zip(values, score, strict=True) if z >= WARN]
            if rate and len(values) < rate * (1 - DROP):
                found.append((key[0], call, "volume_drop", "critical", float(len(values)), rate))
            rate = float(len(values)) if rate is None else 0.9 * rate + 0.1 * len(values)
            # Two sets of moments make one: no value is kept.
            own, k = float(values.mean()), len(values)
            m2 += float(((values - own) ** 2).sum()) + (own - mean) ** 2 * n * k / (n + k)
            mean += (own - mean) * k / (n + k)
            n += k
        self.state.update((n, mean, m2, rate))
        yield pd.DataFrame(found, columns=["key", "call", "kind", "severity", "value", "score"])

    def close(self) -> None:
        pass


def anomalies(values: DataFrame) -> DataFrame:
    """values (key, call, at, value) as a stream; see RunningAnomaly. Needs the RocksDB state store; see state_in_rocksdb()."""
    return values.groupBy("key").transformWithStateInPandas(statefulProcessor=RunningAnomaly(), outputStructType=ANOMALY, outputMode="append", timeMode="None")


def null_spikes(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, nulls, total, severity) of the columns that are null in more than a share NULLS of a key's rows, critical above four fifths."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    share = F.col("nulls") / F.col("total")
    return counted.unpivot([*keys, "total"], columns, "column", "nulls").where(share > NULLS).withColumn("severity", F.when(share > 0.8, "critical").otherwise("warning"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes_sink(path: str):
    """A foreachBatch function that writes each batch into a folder of its own below ``path``: one that is delivered twice replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def run_to_end(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Reads a stream to the end of what is there, and gives back the table in the shared folder that it wrote: in append mode all rows, in update mode the newest of each
    key, in complete mode those of the last batch. Nothing passes through the driver, and progress is in a checkpoint beside the table."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        job = stream.writeStream.foreachBatch(changes_sink(f"{path}/rows")).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    epochs = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # there was nothing to read
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(epochs).parquet(f"{path}/rows")
    if mode == "update":
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("epoch")))
        rows = rows.withColumn("_newest", newest).where("_newest = 1").drop("_newest")
    elif mode == "complete":
        last = rows.agg(F.max("epoch").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("epoch") == F.col("_last")).drop("_last")
    return rows.drop("epoch")


def upsert_sink(path: str, keys: list[str], on: str):
    """A foreachBatch function that keeps the newest row of each key in a Parquet table; a batch that is
    delivered twice changes nothing. Each version is a folder of its own, so readers never see half of one."""

    def write(batch: DataFrame, epoch: int) -> None:
        from ..operators.temporal import latest

        spark = batch.sparkSession
        before = f"{path}/v={epoch - 1}"
        rows = batch
        if epoch > 0:
            rows = spark.read.parquet(before).unionByName(batch)
        latest(rows, keys, on).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write
