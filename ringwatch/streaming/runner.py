"""Open table files as a stream and drain a stream into a table."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.session import shared_folder


def open_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema of what is there now.

    The path may be one file or a folder. A plain path has to be a folder, so it is given as a
    pattern that matches only itself.
    """
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run everything that is available into a Parquet table and return the table.

    To let a failed run go on, call again with the same `out` and `checkpoint`; without them every
    call has new folders beside the checkpoints and starts from the beginning.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/progress"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], progress: str) -> None:
    query = (
        stream.writeStream.foreachBatch(work).option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_batches(stream: DataFrame, name: str, work: Callable[[DataFrame], DataFrame], out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run `work` on every batch by itself, so that it can read other tables as they are by then.

    A batch has a folder of its own, which a repeated run of the batch overwrites.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/progress"

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run_batches(stream, one, checkpoint)
    return spark.read.parquet(out)


def drain_in_time(stream: DataFrame, name: str, late_by: str = "1 hour", out: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drain a stream (with event time `ts`) into a table of the rows in time and a side table of late ones.

    A row is late if it lies behind the newest event of the batches before its own by more than the
    allowed delay. Each batch writes how far its events go; the batches before are read from there,
    so a repeated batch is split as it was the first time. Both tables have the number of the batch.
    """
    from ringwatch.streaming.feeds import split_late

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out, checkpoint = out or f"{base}/out", checkpoint or f"{base}/progress"

    def one(batch: DataFrame, number: int) -> None:
        newest = None
        if number:
            newest = spark.read.parquet(f"{out}/newest").where(F.col("batch") < number).agg(F.max("ts")).first()[0]
        in_time, late = split_late(batch, newest, late_by)
        in_time.write.mode("overwrite").parquet(f"{out}/in_time/batch={number}")
        late.write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{out}/newest/batch={number}")

    _run_batches(stream, one, checkpoint)
    return spark.read.parquet(f"{out}/in_time"), spark.read.parquet(f"{out}/late")
