"""Append-only case log as Parquet, one folder per day."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("time_utc", T.TimestampType()),
        T.StructField("account", T.LongType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("band", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("ring", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

# What an incomplete log row is filled with.
FILL = {"ground_truth": "unknown", "ring": "—", "action": "reviewed"}


def append(rows: DataFrame, path: str, session: str) -> None:
    """Add rows; (seq, session, row) orders the log across writers.

    `seq` is the microsecond of the event, `row` the place of a row in its append, so rows of one
    append never tie. Columns of the log that are missing are null or filled; others are refused.
    """
    has = set(rows.columns)
    unknown = has - {f.name for f in SCHEMA.fields}
    if unknown:
        raise ValueError(f"not in the case log: {', '.join(sorted(unknown))}")
    ready = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in SCHEMA.fields if f.name not in has})
    ready = ready.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in FILL.items()})
    if "time_utc" not in has:
        ready = ready.withColumn("time_utc", F.current_timestamp())
    ready = ready.withColumns(
        {
            "session": F.lit(session),
            "seq": F.unix_micros("time_utc"),
            "row": F.monotonically_increasing_id(),
            "day": F.to_date("time_utc"),
            "probability": F.bround(F.col("probability").cast("double"), 4),
        }
    )
    ready.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA.fields]).write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def newest_first(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path).orderBy(F.desc("seq"), F.desc("session"), F.desc("row"))


def count(spark: SparkSession, path: str) -> int:
    return scan(spark, path).count()
