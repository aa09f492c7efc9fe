"""Rule audits of streams: an extension; the compiled expressions hold no state, so they run on micro-batches as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabforge.operators import rules
from tabforge.plans.rules import CompiledRules


def audited_stream(stream: DataFrame, compiled: CompiledRules, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's audit as Parquet by batch: a batch that runs again replaces its own folder only."""

    def each(batch: DataFrame, number: int) -> None:
        rules.audit(batch, compiled).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, folder: str) -> DataFrame:
    """(rule_id, violations) over all batches."""
    return spark.read.parquet(folder).groupBy("rule_id").agg(F.sum("violations").alias("violations"))


def windowed_violations(stream: DataFrame, compiled: CompiledRules, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, end, n, dropped): rows and dropped rows by event-time window, with a watermark for late ones."""
    flagged = stream.withColumn("__drop", rules.drops(compiled))
    return flagged.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.count_if("__drop").alias("dropped")).select("window.start", "window.end", "n", "dropped")


def accept_stream(stream: DataFrame, compiled: CompiledRules, index: str, folder: str, checkpoint: str, wanted: int) -> StreamingQuery:
    """Accepts valid candidates of a stream, in batches, until ``wanted`` are there; each batch writes its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        have = spark.read.parquet(folder).where(F.col("batch") < number).count() if exists else 0
        valid = rules.validated(batch, compiled).where("__violations = 0").drop("__violations")
        valid.orderBy(index).limit(max(0, wanted - have)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
