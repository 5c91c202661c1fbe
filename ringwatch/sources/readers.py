"""Read snapshots, feeds, matrices and labelled sets."""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwatch import constants as K


@dataclass(frozen=True)
class LabelledSet:
    """Where the label of a known data set is, and which columns are not features."""

    target: str
    drop: tuple[str, ...] = ()
    step: str | None = None


LABELLED_SETS = {
    "baf": LabelledSet("fraud_bool", step="month"),
    "ieee": LabelledSet("isFraud", drop=("TransactionID",)),
    "ulb": LabelledSet("Class"),
    "paysim": LabelledSet("isFraud", drop=("isFlaggedFraud", "nameOrig", "nameDest"), step="step"),
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, limit: int | None = None) -> DataFrame:
    """A feed file; without a schema the types are inferred by one extra pass."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.limit(limit) if limit else df


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType | None = None, target: str = K.SNAPSHOT_TARGET
) -> DataFrame:
    """Account snapshot whose first column, named or not, is the account id."""
    df = read_csv(spark, path, schema)
    first = df.columns[0]
    df = df.withColumnRenamed(first, "account_id").withColumn("account_id", F.col("account_id").cast("bigint"))
    return df.withColumn(target, F.col(target).cast("int")) if target in df.columns else df


def save_schema(df: DataFrame) -> str:
    return df.schema.json()


def load_schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_labelled(spark: SparkSession, name: str, path: str, fmt: str = "csv") -> tuple[DataFrame, LabelledSet]:
    """A known labelled set; the target is found without regard to case."""
    spec = LABELLED_SETS[name]
    df = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    actual = next((c for c in df.columns if c.lower() == spec.target.lower()), None)
    if actual is None:
        raise ValueError(f"{name} has no column {spec.target}")
    return df.withColumnRenamed(actual, spec.target), spec


def read_money_flows(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Accounts, alerts and transactions of a planted money-flow set in library names."""
    accounts = read_csv(spark, f"{folder}/accounts.csv")
    alerts = read_csv(spark, f"{folder}/alerts.csv")
    txns = read_csv(spark, f"{folder}/transactions.csv")
    ends = [F.col("SENDER_ACCOUNT_ID").alias("sender"), F.col("RECEIVER_ACCOUNT_ID").alias("receiver")]
    return {
        "accounts": accounts.select(F.col("ACCOUNT_ID").alias("id"), F.col("IS_FRAUD").alias("is_fraud")),
        "alerts": alerts.select(
            F.col("ALERT_ID").alias("alert_id"), F.col("ALERT_TYPE").alias("alert_type"), *ends,
            *([F.col("TX_AMOUNT").alias("amount")] if "TX_AMOUNT" in alerts.columns else []),
        ),
        "transactions": txns.select(*ends, F.col("IS_FRAUD").alias("is_fraud")),
    }


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
