"""Reason codes: what moved the score of each account, and alert records built on them.

Linear models are attributed exactly: coefficient times distance from the feature mean.
Tree ensembles are attributed along the decision path (the change of the node mean at every
split is credited to its feature); this is an approximation and not a Shapley value.
"""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwatch.functions import policy
from ringwatch.functions.labels import human_label, readable_value
from ringwatch.operators.hygiene import percentile_note
from ringwatch.operators.longform import to_long
from ringwatch.operators.metrics import with_score_and_band


def linear_contributions(df: DataFrame, features: list[str], model: PipelineModel, identity: str) -> DataFrame:
    """(identity, feature, value, contribution) for a scaled logistic pipeline.

    The scaler's mean is the population mean, so the scaled value is the distance from it; a
    missing value counts as the imputed median.
    """
    rows = linear_table(features, model)
    table = df.sparkSession.createDataFrame(rows, "feature string, med double, mean double, std double, coef double")
    scaled = (F.coalesce("value", "med") - F.col("mean")) / F.col("std")
    return (
        to_long(df, features, [identity])
        .join(table, "feature")
        .select(identity, "feature", "value", F.when(F.col("std") > 0, scaled * F.col("coef")).otherwise(0.0).alias("contribution"))
    )


def linear_table(features: list[str], model: PipelineModel) -> list[tuple[str, float, float, float, float]]:
    """(feature, median, mean, deviation, coefficient) of a scaled logistic pipeline."""
    imputer, scaler, learner = model.stages[0], model.stages[-2], model.stages[-1]
    medians = imputer.surrogateDF.first()
    return [
        (c, float(medians[c]), float(m), float(s), float(w))
        for c, m, s, w in zip(features, scaler.mean.toArray(), scaler.std.toArray(), learner.coefficients.toArray())
    ]


def linear_drivers(df: DataFrame, table: list[tuple[str, float, float, float, float]], identity: str, k: int = 6) -> DataFrame:
    """(identity, rank, feature, value, contribution): the k strongest contributions of each row.

    All of a row's contributions are built, sorted and cut inside the row, so nothing is shuffled
    and only k rows per account come out. `table` is that of `linear_table` or any fixed one.
    """
    names, *numbers = zip(*table)
    medians, means, deviations, weights = (F.array(*[F.lit(float(x)) for x in xs]) for xs in numbers)
    labels = F.array(*[F.lit(n) for n in names])

    def driver(value, i):
        scaled = (F.coalesce(value, F.get(medians, i)) - F.get(means, i)) / F.nullif(F.get(deviations, i), F.lit(0.0))
        moved = F.coalesce(scaled * F.get(weights, i), F.lit(0.0))
        return F.struct(
            (-F.abs(moved)).alias("order"), F.get(labels, i).alias("feature"), value.alias("value"), moved.alias("contribution")
        )

    values = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    best = F.slice(F.array_sort(F.transform(values, driver)), 1, k)
    return df.select(identity, F.posexplode(best).alias("_at", "d")).select(
        identity, (F.col("_at") + 1).alias("rank"), "d.feature", "d.value", "d.contribution"
    )


def _tree_arrays(model: PipelineModel) -> tuple[list[dict], list[float]]:
    """Nodes of each tree in depth-first order, as plain arrays."""
    learner = model.stages[-1]

    def leaf_mean(node) -> tuple[float, float]:
        """Mean prediction and weight below a node."""
        impurity = node.impurityStats()
        return node.prediction(), float(impurity.count())

    trees, weights = [], [float(w) for w in learner.treeWeights]
    for tree in learner.trees:
        out = {"feature": [], "threshold": [], "left": [], "right": [], "mean": []}

        def walk(node) -> int:
            i = len(out["feature"])
            for key in out:
                out[key].append(0)
            if node.subtreeDepth() == 0:
                out["feature"][i], out["mean"][i] = -1, leaf_mean(node)[0]
                return i
            out["feature"][i] = node.split().featureIndex()
            out["threshold"][i] = node.split().threshold()
            out["left"][i] = walk(node.leftChild())
            out["right"][i] = walk(node.rightChild())
            nl, nr = leaf_mean(node.leftChild())[1], leaf_mean(node.rightChild())[1]
            ml, mr = out["mean"][out["left"][i]], out["mean"][out["right"][i]]
            out["mean"][i] = (nl * ml + nr * mr) / max(nl + nr, 1e-12)
            return i

        walk(tree._call_java("rootNode"))
        trees.append(out)
    return trees, weights


def tree_contributions(
    df: DataFrame, features: list[str], model: PipelineModel, identity: str, k: int | None = None
) -> DataFrame:
    """(identity, feature, value, contribution) for a boosted-tree pipeline, by decision path.

    With `k` only the k strongest of each account leave the task, with their rank.
    The node table is as large as the model and travels with the task; rows stay where they are.
    """
    trees, weights = _tree_arrays(model)
    imputer = model.stages[0]
    medians = imputer.surrogateDF.first()
    fill = [float(medians[c]) for c in features]
    cols = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(features)]
    id_type = df.schema[identity].dataType.simpleString()
    places = {c: i for i, c in enumerate(sorted(features))}

    def attribute(batches):
        import numpy as np
        import pandas as pd

        by_name = np.array([places[c] for c in features])

        for pdf in batches:
            raw = pdf[[f"c{i}" for i in range(len(features))]].to_numpy(dtype=float)
            x = np.where(np.isnan(raw), np.array(fill), raw)
            credit = np.zeros_like(x)
            for tree, w in zip(trees, weights):
                f, t, l, r, m = (np.array(tree[k]) for k in ("feature", "threshold", "left", "right", "mean"))
                at = np.zeros(len(x), dtype=int)
                while True:
                    live = np.nonzero(f[at] >= 0)[0]
                    if not len(live):
                        break
                    node = at[live]
                    goes_left = x[live, f[node]] <= t[node]
                    nxt = np.where(goes_left, l[node], r[node])
                    credit[live, f[node]] += w * (m[nxt] - m[node])
                    at[live] = nxt
            n, wide = x.shape
            if k is not None:
                # by size, then by name
                best = np.lexsort((np.tile(by_name, (n, 1)), -np.abs(credit)), axis=1)[:, :k]
                rows = np.repeat(np.arange(n), best.shape[1])
                value = pd.Series(raw[rows, best.ravel()]).astype(object)
                yield pd.DataFrame(
                    {
                        identity: pdf[identity].to_numpy()[rows],
                        "rank": np.tile(np.arange(1, best.shape[1] + 1), n),
                        "feature": np.array(features, dtype=object)[best.ravel()],
                        "value": value.where(value.notna(), None),
                        "contribution": credit[rows, best.ravel()],
                    }
                )
                continue
            yield pd.DataFrame(
                {
                    identity: np.repeat(pdf[identity].to_numpy(), wide),
                    "feature": np.tile(np.array(features, dtype=object), n),
                    "value": pd.Series(raw.ravel()).astype(object).where(~np.isnan(raw.ravel()), None),
                    "contribution": credit.ravel(),
                }
            )

    rank = "rank int, " if k is not None else ""
    schema = f"{identity} {id_type}, {rank}feature string, value double, contribution double"
    return df.select(identity, *cols).mapInPandas(attribute, schema)


def top_drivers(contributions: DataFrame, identity: str, k: int = 6, stats: DataFrame | None = None) -> DataFrame:
    """The k strongest drivers of each account, with direction, readable value and context.

    Contributions that carry their rank already (`linear_drivers`, `tree_contributions` with k) are
    only cut; others are ranked by a window per account.
    """
    if "rank" not in contributions.columns:
        order = Window.partitionBy(identity).orderBy(F.desc(F.abs("contribution")), "feature")
        contributions = contributions.withColumn("rank", F.row_number().over(order))
    top = contributions.where(F.col("rank") <= k)
    if stats is not None:
        # one row per feature: bounded by the schema
        top = top.join(F.broadcast(stats), "feature", "left").withColumn("context", percentile_note(F.col("value")))
    else:
        top = top.withColumn("context", F.lit(""))
    return top.select(
        identity,
        "rank",
        "feature",
        human_label(F.col("feature")).alias("label"),
        "value",
        readable_value(F.col("feature"), F.col("value").cast("string")).alias("value_readable"),
        "contribution",
        F.when(F.col("contribution") > 0, "raises risk").otherwise("lowers risk").alias("direction"),
        "context",
    )


def alert_records(
    scored: DataFrame, drivers: DataFrame, identity: str, threshold: float = 0.5, score: str = "score", k: int = 5
) -> DataFrame:
    """One record per flagged account with its action and its positive drivers in rank order."""
    flagged = with_score_and_band(scored.where(F.col(score) >= threshold), score)
    up = drivers.where("contribution > 0").groupBy(identity).agg(
        F.slice(
            F.array_sort(F.collect_list(F.struct("rank", "label", "value_readable", "contribution", "context"))), 1, k
        ).alias("top_drivers")
    )
    return flagged.join(up, identity, "left").select(
        identity,
        "risk_score",
        "band",
        F.bround(score, 4).alias("probability"),
        policy.band_action(F.col("band")).alias("recommended_action"),
        "top_drivers",
    )


def watchlist_reasons(scored: DataFrame, drivers: DataFrame, identity: str, k: int = 3) -> DataFrame:
    """Accounts with their k strongest drivers that raise the risk, as one text."""
    part = F.concat("label", F.lit("="), "value_readable")
    text = drivers.where((F.col("contribution") > 0) & (F.col("rank") <= k)).groupBy(identity).agg(
        F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("r")
    )
    reasons = F.array_join(F.transform("r", lambda s: s["t"]), " | ")
    return scored.join(text, identity, "left").withColumn("top_reasons", F.coalesce(reasons, F.lit(""))).drop("r")


def reports(scored: DataFrame, drivers: DataFrame, identity: str, n_features: int, score: str = "score") -> DataFrame:
    """Investigation report text per account; `scored` also carries n_missing."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "label", "value_readable", "context", "contribution")))
    all_drivers = drivers.groupBy(identity).agg(listed.alias("d"))

    def line(s):
        note = F.when(s["context"] != "", F.concat(F.lit(" — "), s["context"])).otherwise("")
        return F.concat(s["label"], F.lit(": "), s["value_readable"], note)

    up = F.slice(F.filter("d", lambda s: s["contribution"] > 0), 1, 5)
    down = F.slice(F.filter("d", lambda s: s["contribution"] < 0), 1, 2)
    numbered = F.transform(up, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), line(s)))
    dashed = F.transform(down, lambda s: F.concat(F.lit("  - "), line(s)))
    none = F.array(F.lit("  - No positive risk drivers; score is low."))
    banded = with_score_and_band(scored, score).join(all_drivers, identity, "left")
    head = F.array(
        F.concat(F.lit("INVESTIGATION REPORT — Account #"), F.col(identity).cast("string")),
        F.lit("=" * 56),
        F.format_string("Risk Score : %d/100  (%s)", "risk_score", "band"),
        F.format_string("Calibrated probability of mule activity : %.1f%%", F.col(score) * 100),
        F.concat(F.lit("Recommended action : "), policy.band_action(F.col("band"))),
        F.lit(""),
        F.lit("WHY THIS ACCOUNT WAS FLAGGED (top risk drivers):"),
    )
    soft = F.when(
        F.size(down) > 0, F.concat(F.array(F.lit(""), F.lit("MITIGATING FACTORS (these lowered the score):")), dashed)
    ).otherwise(F.array().cast("array<string>"))
    tail = F.array(
        F.lit(""),
        F.lit("CONFIDENCE & CAVEATS:"),
        F.format_string(
            "  - Score derived from %d populated features; %d were blank for this account.",
            F.lit(n_features) - F.col("n_missing"), F.col("n_missing"),
        ),
    )
    body = F.when(F.size(up) > 0, numbered).otherwise(none)
    return banded.select(identity, F.array_join(F.concat(head, body, soft, tail), "\n").alias("report"))


