"""Session defaults and the shared checkpoint folder."""

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "ringwatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one is made up only for a local master."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ringwatch-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there on."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return _without_estimate(df.checkpoint(eager=True))


def _without_estimate(written: DataFrame) -> DataFrame:
    """A written table under no estimate of its size, if the one it has is past all bounds.

    A checkpoint keeps Spark's estimate, for a join the product of both sides. Over rounds of joins
    with the result of the last one its digits grow exponentially, to more than the driver holds.
    """
    plan = written._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() < 2**63:
            return written
    except ValueError:  # too many digits for a number of Python
        pass
    spark = written.sparkSession
    # what is not known counts as 2 ** 63 - 1 bytes, so no join is planned otherwise than by the estimate
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written._jdf.queryExecution().toRdd(), plan.schema(), False), spark)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that no table refers to any more.

    Spark deletes them when the driver's heap is collected, which a long row of small steps hardly
    causes, so that all of their files would lie on the disks till the end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
