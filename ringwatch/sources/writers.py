"""Write matrices, predictions, lists and metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def predictions(scored: DataFrame, dataset: str, probability: str = "score", label: str = "label") -> DataFrame:
    """account_id, risk_score, band, probability, actual_label, dataset."""
    return scored.select(
        "account_id",
        "risk_score",
        "band",
        F.bround(probability, 6).alias("probability"),
        F.col(label).alias("actual_label"),
        F.lit(dataset).alias("dataset"),
    )


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.write.mode("overwrite").partitionBy("dataset").parquet(path)


def write_list(df: DataFrame, path: str, order: list | None = None) -> None:
    """A watchlist or alert list as CSV, sorted across the part files when an order is given."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    if "dataset" not in rows.columns:
        raise ValueError("metrics rows need a dataset column")
    rows.write.mode("append").json(path)
