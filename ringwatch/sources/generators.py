"""Generated feeds for demos and tests; every value follows from row number and seed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwatch.functions.hashing import normal, uniform


def _pick(u, options: list[tuple[str, float]]):
    """Choose by cumulative share."""
    out, total = None, 0.0
    for name, share in options:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return out.otherwise(options[-1][0])


def _lognormal(seed, mean: float, spread: float):
    return F.round(F.exp(F.lit(mean) + F.lit(spread) * normal(seed, "id")), 2)


def sample_transactions(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """Payments between few accounts; the first five are drained, near-limit amounts."""
    planted = F.array(*[F.lit(float(v)) for v in (49500, 49000, 99000, 9500, 195000)])
    kinds = [("PAYMENT", 0.5), ("TRANSFER", 0.2), ("CASH_OUT", 0.2), ("DEBIT", 0.1)]
    first = F.col("id") < 5
    rows = spark.range(n).select(
        "id",
        (F.floor(uniform(f"{seed}s", "id") * 29) + 1).cast("int").alias("step"),
        _pick(uniform(f"{seed}t", "id"), kinds).alias("type"),
        F.when(first, F.get(planted, F.col("id").cast("int"))).otherwise(_lognormal(f"{seed}m", 9, 1.2)).alias("amount"),
        F.concat(F.lit("A"), (F.floor(uniform(f"{seed}o", "id") * 82) + 9000).cast("string")).alias("nameOrig"),
        _lognormal(f"{seed}b", 10, 1).alias("oldbalanceOrg"),
        F.concat(F.lit("M"), (F.floor(uniform(f"{seed}d", "id") * 59) + 1).cast("string")).alias("nameDest"),
        _lognormal(f"{seed}x", 8, 1).alias("oldbalanceDest"),
        _lognormal(f"{seed}y", 8, 1).alias("newbalanceDest"),
    )
    left = F.greatest(F.col("oldbalanceOrg") - F.col("amount"), F.lit(0.0))
    return rows.withColumn("newbalanceOrig", F.when(first, 0.0).otherwise(left)).drop("id")


def sample_rails(spark: SparkSession, n: int = 120, seed: int = 3) -> DataFrame:
    rails = [("UPI", 0.4), ("IMPS", 0.3), ("CARD", 0.2), ("NEFT", 0.1)]
    kinds = [("TRANSFER", 1 / 3), ("CASH_OUT", 1 / 3), ("PAYMENT", 1 / 3)]
    return spark.range(n).select(
        F.concat(F.lit("A"), (F.floor(uniform(f"{seed}o", "id") * 82) + 9000).cast("string")).alias("nameorig"),
        _lognormal(f"{seed}m", 9, 1.2).alias("amount"),
        _pick(uniform(f"{seed}c", "id"), rails).alias("channel"),
        _pick(uniform(f"{seed}t", "id"), kinds).alias("type"),
    )


def sample_tickets(spark: SparkSession, seed: int = 7) -> DataFrame:
    """Five regulator tickets on fixed accounts."""
    rows = [
        (9003, "UPI fraud", "HIGH"),
        (9007, "investment scam", "HIGH"),
        (9011, "phishing", "MEDIUM"),
        (4500, "card fraud", "LOW"),
        (9021, "loan scam", "HIGH"),
    ]
    df = spark.createDataFrame(rows, "beneficiary_account bigint, category string, severity string")
    number = F.floor(uniform(seed, "beneficiary_account") * 9000000) + 1000000
    return df.withColumn("ticket_id", F.concat(F.lit("NCRP"), number.cast("string")))
