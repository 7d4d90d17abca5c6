"""Streaming forms of the stages: the same column functions over file streams, with durable state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import fingerprint
from ..operators.relational import not_done


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Append until the source is used up, exactly once, from where the checkpoint left off."""
    return df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dedup_stream(df: DataFrame, text: str = "text", opening: bool = False, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Drop rows whose text (or opening) was seen. With a watermark (column, delay) the state is forgotten after the delay; without one it grows."""
    rows = df.withColumn("_fp", fingerprint(F.col(text)) if opening else F.sha2(F.col(text), 256))
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["_fp"])
    else:
        rows = rows.dropDuplicates(["_fp"])
    return rows.drop("_fp")


def run_batches(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "id", kind: str = "parquet") -> StreamingQuery:
    """Micro-batches through ``transform`` into a sink; keys that the sink has are left out, so a batch that runs again adds nothing."""

    def one(batch: DataFrame, number: int) -> None:
        from ..sinks.files import written

        done = written(batch, path, kind)
        rows = batch if done is None or key not in done.columns else not_done(batch, done, key)
        transform(rows.dropDuplicates([key])).write.mode("append").format(kind).save(path)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_stream(df: DataFrame, key: str, text: str, most_bytes: int, marker: str | None = None) -> DataFrame:
    """Whole files of a stream cut into documents by lines, bytes and marker; no state is kept between files."""
    from ..operators.chunking import split_by_bytes

    return df.select(key, F.posexplode(split_by_bytes(F.col(text), most_bytes, marker)).alias("part", "text"))


def window_counts(df: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of event-time windows with late rows allowed."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
